"""Whole flows over the catalogue: batch ingest with history, propagation, linkage in stages, feeds, copies, seeds, the daily run."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import specs as S
from ..functions import text as T
from ..session import written
from . import catalog as C
from . import linkage as L

#: Fields of a listing that a newer item overwrites; url and old_price stay as they were.
OVERWRITTEN = ["store_product_name", "current_price", "unit_price", "unit_label", "in_stock", "store_ean", "store_manufacturer_ref", "image_url", "category_path"]
#: Columns of a product that names fill where they are empty, and the lengths they are cut to.
FILLED = {"volume": 20, "color": 50, "weight": 20, "dimensions": 50, "pack_size": 30, "finish": 30}


def ingest(listings: DataFrame, stores: DataFrame, items: DataFrame, now: datetime, hours: int = 12) -> DataFrame:
    """The next snapshot of listings after one batch of items, with action and changed.

    Items have item_id (order of arrival), store_chain, store_name, store_sku, store_product_url and the overwritten
    fields. An item's store is that of chain and name, else the chain's first; items of unknown chains are dropped. An
    empty sku becomes the end of the URL, else `unknown`. Of items of one (store, sku) the first counts, since the later
    ones look fresh. A listing written less than `hours` before `now` is kept as it is, any other takes the item's
    fields; a new key becomes a row. action is kept, updated or inserted; changed rows add their price to the history:
    inserted ones, and updated ones whose price before was empty, 0 or another. Listings without sku meet no item.
    """
    url_end = F.nullif(F.right(F.coalesce("store_product_url", F.lit("")), F.lit(50)), F.lit(""))
    placed = C.resolve_store(items.withColumnRenamed("store_chain", "chain"), stores).filter("store_id is not null")
    placed = placed.withColumn("store_sku", F.coalesce(F.nullif("store_sku", F.lit("")), url_end, F.lit("unknown")))
    fields = ["store_product_url", *OVERWRITTEN]
    news = C.first_per(placed.select("store_id", "store_sku", "item_id", *fields), ["store_id", "store_sku"], [F.col("item_id")])
    news = news.select("store_id", "store_sku", F.struct(*fields).alias("new"))
    old = listings.select("store_id", "store_sku", F.struct("id", "product_id", "old_price", "last_scraped_at", *fields).alias("old"))
    both = old.join(news, ["store_id", "store_sku"], "full")
    stamp = F.lit(now).cast("timestamp")
    fresh = F.coalesce(stamp - F.expr(f"interval {hours} hours") < F.col("old.last_scraped_at"), F.lit(False))
    inserted = F.col("old").isNull()
    taken = F.col("new").isNotNull() & (inserted | ~fresh)
    before = F.nullif("old.current_price", F.lit(0).cast("decimal(10,2)"))
    price_moved = ~F.coalesce(before == F.col("new.current_price"), before.isNull() & F.col("new.current_price").isNull())
    return both.select(
        "store_id", "store_sku", "old.id", "old.product_id", "old.old_price",
        F.when(inserted, F.col("new.store_product_url")).otherwise(F.col("old.store_product_url")).alias("store_product_url"),
        *[F.when(taken, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in OVERWRITTEN],
        F.when(taken, stamp).otherwise(F.col("old.last_scraped_at")).alias("last_scraped_at"),
        F.when(inserted, "inserted").when(taken, "updated").otherwise("kept").alias("action"),
        (taken & (inserted | price_moved)).alias("changed"),
    )


def spec_columns(name: Column) -> list[Column]:
    return [F.substring(S.field(name, c), 1, n).alias(c) for c, n in FILLED.items()]


def propagate(products: DataFrame, items: DataFrame) -> DataFrame:
    """id, brand, description and the filled columns of every product after the items of its listings came in.

    Items have product_id, item_id (order of arrival), product_name, manufacturer and description. Brand and
    description are taken where they are empty, from the first item that has one; so are the columns read from the
    item's name, cut to their lengths. What is filled stays.
    """
    named = ["manufacturer", "description"]
    rows = items.filter("product_id is not null").select(F.col("product_id").alias("id"), "item_id", *named, *spec_columns(F.col("product_name")))
    first = lambda c: F.min_by(c, F.when(F.nullif(c, F.lit("")).isNotNull(), F.col("item_id"))).alias(f"new_{c}")
    found = rows.groupBy("id").agg(*[first(c) for c in [*named, *FILLED]])
    fill = lambda old, new: F.coalesce(F.nullif(old, F.lit("")), F.col(f"new_{new}"), F.col(old)).alias(old)
    return products.join(found, "id", "left").select("id", fill("brand", "manufacturer"), fill("description", "description"), *[fill(c, c) for c in FILLED])


def link_all(listings: DataFrame, products: DataFrame) -> DataFrame:
    """(listing_id, product_id, rule) of all unlinked listings by EAN, then reference, then name.

    An EAN that no product has makes one (rule ean_new), whose reference later listings can meet; a reference makes
    none (rule ref); what is left goes by name (rule name, or name_new with the negated listing id as product).
    """
    by_ean = written(C.link_or_create(listings, products))
    fresh = by_ean.filter("created").join(listings.select(F.col("id").alias("listing_id"), "store_manufacturer_ref"), "listing_id")
    made = fresh.groupBy(F.col("product_id").alias("id")).agg(F.min_by("store_manufacturer_ref", "listing_id").alias("manufacturer_ref"))
    left = listings.join(by_ean.select(F.col("listing_id").alias("id")), "id", "left_anti")
    by_ref = written(C.link_by_code(left, products.select("id", "manufacturer_ref").unionByName(made), "store_manufacturer_ref", "manufacturer_ref"))
    rest = left.join(by_ref.select(F.col("listing_id").alias("id")), "id", "left_anti")
    names = products.select("id", "name").unionByName(by_ean.filter("created").groupBy(F.col("product_id").alias("id")).agg(F.first("name").alias("name")))
    by_name = L.greedy(rest, names)
    return (
        by_ean.select("listing_id", "product_id", F.when(F.col("created"), "ean_new").otherwise("ean").alias("rule"))
        .unionByName(by_ref.withColumn("rule", F.lit("ref")))
        .unionByName(by_name.select("listing_id", "product_id", F.when(F.col("made"), "name_new").otherwise("name").alias("rule")))
    )


def relink(listings: DataFrame, products: DataFrame) -> DataFrame:
    """(listing_id, was, product_id, rule) of the listings that contradict their product, detached and linked anew by `link_all`.

    As in the reference semantics EAN and reference ignore what the names say, so a listing may come back to the
    product it was detached from.
    """
    bad = written(L.incompatible(listings, products).withColumnRenamed("product_id", "was"))
    kept = listings.join(bad.select(F.col("listing_id").alias("id"), F.lit(True).alias("bad")), "id", "left")
    freed = kept.withColumn("product_id", F.when(F.col("bad").isNull(), F.col("product_id"))).drop("bad")
    linked = link_all(freed, products)
    return bad.join(linked, "listing_id", "left").select("listing_id", "was", "product_id", F.coalesce("rule", F.lit("none")).alias("rule"))


def import_feed(listings: DataFrame, stores: DataFrame, feed: DataFrame, chain: str, store_name: str | None = None) -> DataFrame:
    """The listings of the chain's first store (made if there is none, id one above the largest) after a feed came in.

    Feed rows (`row`, the order, and the twelve feed fields) without name or price are skipped. A row with a sku meets
    the listing of that sku: another price replaces the listing's; of several rows of one sku the last price stays,
    and of a new sku the first row is the listing. A row without sku is always a new listing. Names are cut to 255,
    skus to 50, EANs to 13. action is kept, updated or inserted; the price history is not written. Prices are rounded to
    cents and keep the digits of the feed's own type, so one that the listings' column has no room for comes out as it is;
    store_id is long, or decimal where one above the largest id is more than a long holds.
    """
    found = stores.filter(F.col("chain") == chain).agg(F.min("id")).head()[0]
    store = int(found if found is not None else (stores.agg(F.max("id")).head()[0] or 0) + 1)
    own_id = F.lit(store).cast("long") if store < 2**63 else F.lit(Decimal(store)).cast("decimal(20,0)")
    cut = lambda c, n: F.substring(c, 1, n)
    rows = feed.filter("name is not null and price is not null").select(
        "row", cut("name", 255).alias("name"), F.nullif(cut("sku", 50), F.lit("")).alias("sku"), F.nullif(cut("ean", 13), F.lit("")).alias("ean"), F.round("price", 2).alias("price")
    )
    keyed = rows.filter("sku is not null").groupBy("sku").agg(F.min_by(F.struct("name", "ean"), "row").alias("first"), F.max_by("price", "row").alias("price"))
    own = listings.filter(F.col("store_id") == own_id).select("id", F.col("store_sku").alias("sku"), "store_product_name", "store_ean", "current_price")
    both = own.join(keyed, "sku", "full")
    new = F.col("id").isNull()
    moved = F.col("price").isNotNull() & ~F.col("price").eqNullSafe(F.col("current_price"))
    met = both.select(
        "id", "sku", F.when(new, F.col("first.name")).otherwise(F.col("store_product_name")).alias("name"), F.when(new, F.col("first.ean")).otherwise(F.col("store_ean")).alias("ean"),
        F.when(moved, F.col("price")).otherwise(F.col("current_price")).alias("price"), F.when(new, "inserted").when(moved, "updated").otherwise("kept").alias("action"),
    )
    bare = rows.filter("sku is null").select(F.lit(None).cast("long").alias("id"), "sku", "name", "ean", "price", F.lit("inserted").alias("action"))
    return met.unionByName(bare).withColumn("store_id", own_id)


def copy_rows(target: DataFrame, source: DataFrame, key: str, casts: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(next target, quarantine): source rows cast to the target's types and added where their key is not there.

    A row whose value does not survive its cast, or without a key, goes to the quarantine with the column's name; of
    rows with one key the first by their text stays.
    """
    value = lambda c: F.col(c).try_cast(casts[c]) if c in casts else F.col(c)
    lost = [F.when(F.col(c).isNotNull() & value(c).isNull(), F.lit(c)) for c in casts]
    marked = source.withColumn("_why", F.coalesce(*lost, F.when(F.col(key).isNull(), F.lit(key)), F.lit("")))
    good = marked.filter("_why = ''").select(*[value(c).alias(c) for c in target.columns])
    return C.insert_ignore(target, good, key), marked.filter("_why != ''").withColumnRenamed("_why", "reason")


def copy_report(target: DataFrame, source: DataFrame, key: str, casts: dict[str, str]) -> DataFrame:
    """One row of counts that must add up: before, read, added, ignored, quarantined, after."""
    after, bad = copy_rows(target, source, key, casts)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = [n(target, "before"), n(source, "read"), n(bad, "quarantined"), n(after, "after")]
    all_ = counts[0]
    for c in counts[1:]:
        all_ = all_.unionByName(c, allowMissingColumns=True)
    one = all_.agg(*[F.sum(c).alias(c) for c in ("before", "read", "quarantined", "after")])
    return one.withColumn("added", F.col("after") - F.col("before")).withColumn("ignored", F.col("read") - F.col("quarantined") - F.col("added"))


def daily_run(listings: DataFrame, products: DataFrame, categories: DataFrame) -> dict[str, DataFrame]:
    """The stages after a day's items are in: link, categorise, slugs, figures, brands; each a table by id."""
    linked = written(link_all(listings, products))
    now = listings.join(linked.select(F.col("listing_id").alias("id"), F.col("product_id").alias("found")), "id", "left")
    now = now.withColumn("product_id", F.coalesce("product_id", "found")).drop("found")
    made = now.join(products.select(F.col("id").alias("product_id")), "product_id", "left_anti").filter("product_id is not null")
    fresh = made.groupBy(F.col("product_id").alias("id")).agg(F.min_by("store_product_name", "id").alias("name"))
    everything = written(products.select("id", "name", "category_id", "brand").unionByName(fresh, allowMissingColumns=True))
    return {
        "links": linked,
        "categories": L.categorize(everything, now, categories),
        "slugs": L.assign_slugs(everything.select("id", "name")),
        "figures": C.price_figures(now),
        "brands": everything.filter("brand is null").select("id", T.extract_brand(F.col("name")).alias("brand")).filter("brand is not null"),
        "products": everything,
    }


def run_summary(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, n: the rows each stage of a run wrote."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in stages.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def shard(df: DataFrame, order: str, shards: int) -> DataFrame:
    """Adds at (place by `order`, from 0) and shard: contiguous chunks of n // shards rows, at least one, the last with the rest."""
    size = max(1, df.count() // shards)
    return C.row_numbers(df, order, "_k").withColumn("at", F.col("_k") - 1).withColumn("shard", F.least(F.floor(F.col("at") / size), F.lit(shards - 1))).drop("_k")
