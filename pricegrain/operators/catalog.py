"""Relational operators of the catalogue: joins, aggregates, windows, upserts and linkage by code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hot import find_blocks, running_last

EMPTY = ["", " "]


def present(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) != "", F.lit(False))


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (in a partial aggregate, so hot keys combine early)."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def last_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def price_figures(listings: DataFrame) -> DataFrame:
    """product_id, least and largest positive price, and the number of all listings."""
    real = F.when(F.col("current_price") != 0, F.col("current_price"))
    return listings.filter("product_id is not null").groupBy("product_id").agg(
        F.min(real).alias("low"), F.max(real).alias("high"), F.count(F.lit(1)).alias("n")
    )


def denormalise(products: DataFrame, listings: DataFrame) -> DataFrame:
    """Every product with the figures of its listings; none: null prices and 0."""
    figures = price_figures(listings).withColumnRenamed("product_id", "id")
    return products.select("id", "min_price", "max_price", "listing_count").join(figures, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def resolve_store(items: DataFrame, stores: DataFrame) -> DataFrame:
    """store_id by chain and name, else the chain's first store by id; null for an unknown chain."""
    exact = stores.groupBy("chain", F.col("name").alias("store_name")).agg(F.min("id").alias("exact_id"))
    chain = stores.groupBy("chain").agg(F.min("id").alias("chain_id"))
    return items.join(exact, ["chain", "store_name"], "left").join(chain, "chain", "left").withColumn("store_id", F.coalesce("exact_id", "chain_id")).drop("exact_id", "chain_id")


def upsert(snapshot: DataFrame, batch: DataFrame, keys: list[str], fields: list[str], stamp: str) -> DataFrame:
    """The next snapshot: rows of the batch win over older rows of the same key; new keys are added.

    Result: keys, fields, stamp and action (kept, updated, inserted). Of several batch rows with a key the last
    by stamp and fields counts. Rows with a null in a key never meet another row: they are kept or inserted.
    """
    news = last_per(batch.select(*keys, *fields, stamp), keys, [F.col(stamp), *map(F.col, fields)])
    left = snapshot.select(*keys, *[F.col(c).alias(f"_{c}") for c in [*fields, stamp]], F.lit(True).alias("_old"))
    right = news.select(*keys, *fields, stamp, F.lit(True).alias("_new"))
    both = left.join(right, keys, "full")
    newer = F.col("_new").isNotNull() & (F.col("_old").isNull() | F.col(f"_{stamp}").isNull() | (F.col(stamp) > F.col(f"_{stamp}")))
    action = F.when(F.col("_old").isNull(), "inserted").when(newer, "updated").otherwise("kept")
    return both.select(*keys, *[F.when(newer, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in [*fields, stamp]], action.alias("action"))


def link_by_code(listings: DataFrame, products: DataFrame, listing_code: str, product_code: str) -> DataFrame:
    """listing_id, product_id of unlinked listings whose code is a product's; the smallest id of several."""
    targets = products.filter(present(product_code)).groupBy(F.col(product_code).alias("code")).agg(F.min("id").alias("product_id"))
    open_ = listings.filter(F.col("product_id").isNull() & present(listing_code)).select(F.col("id").alias("listing_id"), F.col(listing_code).alias("code"))
    return open_.join(targets, "code").select("listing_id", "product_id")


def link_or_create(listings: DataFrame, products: DataFrame) -> DataFrame:
    """Unlinked listings with an EAN: the product of that EAN, else a new one per EAN, numbered on from the largest id.

    New products take name and id order from the smallest listing id of their EAN. Numbering ranks EANs by that
    id within ranges of ids, so no task holds all of them.
    """
    targets = products.filter(present("ean")).groupBy(F.col("ean").alias("store_ean")).agg(F.min("id").alias("known"))
    open_ = listings.filter(F.col("product_id").isNull() & present("store_ean")).select("id", "store_ean", "store_product_name")
    missing = open_.join(targets, "store_ean", "left_anti").groupBy("store_ean").agg(F.min("id").alias("first"), F.min_by("store_product_name", "id").alias("name"))
    numbered = row_numbers(missing, "first", "number")
    top = products.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).head()["top"]
    made = numbered.select("store_ean", (F.col("number") + top).alias("made"), "name")
    return open_.join(targets, "store_ean", "left").join(made, "store_ean", "left").select(
        F.col("id").alias("listing_id"), F.coalesce("known", "made").alias("product_id"), F.col("made").isNotNull().alias("created"),
        F.when(F.col("made").isNotNull(), F.col("name")).alias("name"),
    )


def row_numbers(df: DataFrame, order: str, name: str, width: int = 100_000) -> DataFrame:
    """Consecutive numbers from 1 by a unique integer column, ranked inside ranges of `width` and lifted by the counts before.

    The ranges' counts are the only thing ordered in one task: one row for each range that occurs.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_at", inside).join(before, "_range").withColumn(name, F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")


def as_of(observations: DataFrame, probes: DataFrame, key: str, time: str, value: str, at: str) -> DataFrame:
    """Each probe with the last value of its key not later than its time `at`.

    Observations and probes are ordered together inside (key, block); hot keys are cut into blocks of time.
    """
    blocks = find_blocks(observations, key, time)
    seen = observations.select(F.col(key), F.col(time).alias("_t"), F.lit(0).alias("_kind"), F.col("id").alias("_id"), F.struct(F.col(value).alias("v")).alias("_v"), F.lit(None).cast("long").alias("probe_id"))
    asked = probes.select(F.col(key), F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.col("probe_id").alias("_id"), F.lit(None).cast(seen.schema["_v"].dataType).alias("_v"), "probe_id")
    both = blocks.place(seen.unionByName(asked), "_t", "_id")
    filled = running_last(both, blocks, ["_t", "_kind", "_id"], F.col("_v"), "_last")
    return filled.filter("probe_id is not null").select("probe_id", key, F.col("_t").alias(at), F.col("_last.v").alias(value))


def most_frequent(df: DataFrame, column: str):
    """The most frequent non-null value, of ties the least; null for an empty table."""
    top = df.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).head()
    return top[0] if top else None


def product_page(products: DataFrame, listings: DataFrame, price: tuple | None = None, category: int | None = None, brand: str | None = None, store: int | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """One page of products by lowest price (null last) and id, of a price range, category, brand and store where given."""
    rows = products
    if price is not None:
        rows = rows.filter(F.col("min_price").between(*price))
    if category is not None:
        rows = rows.filter(F.col("category_id") == category)
    if brand is not None:
        rows = rows.filter(F.col("brand") == brand)
    if store is not None:
        rows = rows.join(listings.filter(F.col("store_id") == store).select(F.col("product_id").alias("id")), "id", "left_semi")
    return rows.select("id", "name", "min_price").orderBy(F.asc_nulls_last("min_price"), "id").offset((page - 1) * size).limit(size)


def insert_ignore(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The target with the rows of the source whose key it does not have; of equal keys in the source the first."""
    fresh = first_per(source, [key], [F.col(c).cast("string") for c in source.columns if c != key])
    return target.select(*source.columns).unionByName(fresh.join(target.select(key), key, "left_anti").select(*source.columns))


def seed_rows(spark, tree: dict[str, list[str]]) -> DataFrame:
    """(id, name, parent_id) of a two-level tree: the roots first, then their children in order."""
    roots = {name: i for i, name in enumerate(tree, 1)}
    rows = [(i, name, None) for name, i in roots.items()]
    rows += [(k, child, roots[root]) for k, (root, child) in enumerate(((r, c) for r, cs in tree.items() for c in cs), len(roots) + 1)]
    return spark.createDataFrame(rows, "id int, name string, parent_id int")


def seed_if_empty(target: DataFrame, seed: DataFrame) -> DataFrame:
    """The seed where the target has no rows, else the target."""
    return seed.select(*target.columns) if target.isEmpty() else target
