"""Problem 4: versions of changing attributes as insert-only satellites with lead-based end dates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hot import Blocks, carry, find_blocks


def observations(history: DataFrame, listings: DataFrame) -> DataFrame:
    """key, t, kind, id, price of all observations of listings; of history rows with equal time all are still in."""
    seen = history.filter("scraped_at is not null and price is not null and listing_id is not null").select(
        F.col("listing_id").alias("key"), F.col("scraped_at").alias("t"), F.lit(0).alias("kind"), "id", "price"
    )
    snapshot = listings.filter("id is not null and current_price is not null and last_scraped_at is not null").select(
        F.col("id").alias("key"), F.col("last_scraped_at").alias("t"), F.lit(1).alias("kind"), "id", F.col("current_price").alias("price")
    )
    return seen.unionByName(snapshot)


def satellite(obs: DataFrame, attributes: list[str], hot_rows: int | None = None, blocks: Blocks | None = None) -> DataFrame:
    """Insert-only satellite of one group of attributes that change at about the same rate.

    `obs` has key, t, kind, id and the attributes. Of observations of a key with equal t and kind the one with
    the largest id counts; of equal t, kind 0 comes before kind 1. A row is appended if it is the key's first or
    its hash over the attributes differs from that of the observation before. Result: key, t, kind, id,
    hash_diff and the attributes. Rows without key or t are no observations; nulls in attributes are values;
    repeated rows add nothing; an empty table gives no rows. A hot key is cut into blocks of time: the last
    hash of the block before is compared across, so that no task orders all rows of a key.
    """
    obs = obs.filter("key is not null and t is not null").select("key", "t", "kind", "id", *attributes)
    blocks = blocks or find_blocks(obs, "key", "t", hot_rows)
    obs = blocks.place(obs, "t", "id").withColumn("hash_diff", F.xxhash64(*attributes))
    order = Window.partitionBy("key", "block").orderBy("t", "kind", "id")

    def kept(rows: DataFrame) -> DataFrame:
        same_next = F.coalesce((F.lead("t").over(order) == F.col("t")) & (F.lead("kind").over(order) == F.col("kind")), F.lit(False))
        return rows.withColumn("kept", ~same_next)

    rows = kept(obs)
    before = F.last(F.when(F.col("kept"), F.col("hash_diff")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).filter("kept")
    if blocks.hot:
        ends = kept(obs.filter(blocks.is_hot())).filter("kept").groupBy("key", "block").agg(F.max_by("hash_diff", F.struct("t", "kind", "id")).alias("end"))
        over = Window.partitionBy("key").orderBy("block")
        carried = ends.select("key", "block", F.lag("end").over(over).alias("carried"))
        rows = carry(rows, blocks, carried, ["carried"]).withColumn("before", F.coalesce("before", "carried"))
    return rows.filter("before is null or before != hash_diff").select("key", "t", "kind", "id", "hash_diff", *attributes)


def append(existing: DataFrame, obs: DataFrame, attributes: list[str], hot_rows: int | None = None) -> DataFrame:
    """Rows to append to a satellite for later observations; existing rows are never changed.

    Observations not later than the key's last row are ignored (send late rows through `satellite` again).
    """
    last = existing.groupBy("key").agg(F.max(F.struct("t", "kind", "id", "hash_diff")).alias("last"))
    at = F.struct("t", "kind", "id")
    later = obs.join(last, "key", "left").filter(F.col("last").isNull() | (at > F.struct("last.t", "last.kind", "last.id"))).select(obs.columns)
    news = satellite(later, attributes, hot_rows)
    first = news.groupBy("key").agg(F.min(at).alias("first"))
    known = first.join(last, "key").select("key", "first", F.col("last.hash_diff").alias("known"))  # one row a key
    same = (at == F.col("first")) & (F.col("hash_diff") == F.col("known"))
    return news.join(known, "key", "left").filter(~F.coalesce(same, F.lit(False))).select("key", "t", "kind", "id", "hash_diff", *attributes)


def periods(rows: DataFrame, attributes: list[str | Column], hot_rows: int | None = None) -> DataFrame:
    """View of a satellite with the period of each version: valid_from, valid_to (exclusive, null for the current one)."""
    blocks = find_blocks(rows, "key", "t", hot_rows)
    rows = blocks.place(rows, "t", "id")
    order = Window.partitionBy("key", "block").orderBy("t", "kind", "id")
    out = rows.withColumn("valid_to", F.lead("t").over(order))
    if blocks.hot:
        starts = rows.filter(blocks.is_hot()).groupBy("key", "block").agg(F.min("t").alias("start"))
        over = Window.partitionBy("key").orderBy("block")
        out = carry(out, blocks, starts.select("key", "block", F.lead("start").over(over).alias("carried")), ["carried"])
        out = out.withColumn("valid_to", F.coalesce("valid_to", "carried"))
    return out.select("key", F.col("t").alias("valid_from"), "valid_to", "kind", "id", *attributes)


def price_versions(history: DataFrame, listings: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """The price satellite of all listings (the fast-changing group), from history and snapshot."""
    blocks = find_blocks(history, "listing_id", "scraped_at", hot_rows)
    return satellite(observations(history, listings), ["price"], hot_rows, replace(blocks, key="key"))


#: The attributes of a listing that change slowly.
SLOW = ["store_product_name", "unit_label", "in_stock", "category_path", "image_url"]


def listing_details(*snapshots: DataFrame) -> DataFrame:
    """The satellite of the slow-changing attributes, from snapshots of the listings."""
    obs = [s.select(F.col("id").alias("key"), F.col("last_scraped_at").alias("t"), F.lit(1).alias("kind"), "id", *SLOW) for s in snapshots]
    rows = obs[0]
    for o in obs[1:]:
        rows = rows.unionByName(o)
    return satellite(rows, SLOW)
