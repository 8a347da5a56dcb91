"""Structured Streaming over item events: windows, keyed change detection and the freshness rule."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.hot import carry, find_blocks
from ..session import shared_folder

def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(spark.read.parquet(f"{folder}/events.parquet").schema).parquet(f"{folder}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("day"), "event_type", "n", "total")


def sliding(stream: DataFrame, width: str = "1 day", step: str = "12 hours", late: str = "1 hour") -> DataFrame:
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """user_id, start and n of the runs of a user's events that are at most `gap` apart."""
    rows = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), "n")


def once(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key's first row within the watermark; the state of older keys is dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def fresh(stream: DataFrame, hours: int = 12) -> DataFrame:
    """user_id, event_id of events that come at least `hours` after the user's last accepted one, kept as state across batches.

    Inside a micro-batch rows are ordered by time and id; a late row is held against the last accepted time and skipped.
    """
    span = hours * 3_600_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        due, out = (state.get[0] if state.exists else -(2**62)), []
        for event, t in zip(rows["event_id"].tolist(), rows["t"].tolist(), strict=True):
            if t >= due:
                out.append((key[0], event))
                due = t + span
        state.update((due,))
        yield pd.DataFrame(out, columns=["user_id", "event_id"])

    keyed = stream.filter("ts is not null").select("user_id", "event_id", F.unix_micros("ts").alias("t")).groupBy("user_id")
    return keyed.applyInPandasWithState(run, "user_id long, event_id long", "due long", "append", GroupStateTimeout.NoTimeout)


def changes(stream: DataFrame) -> DataFrame:
    """user_id, event_id, value where the value differs from the user's one before, kept as state across batches.

    Inside a micro-batch rows are ordered by time and id; rows without a value are no observations.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        out = []
        for event, value in zip(rows["event_id"].tolist(), rows["value"].tolist(), strict=True):
            if last is None or value != last:
                out.append((key[0], event, value))
                last = value
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "value"])

    keyed = stream.filter("value is not null").select("user_id", "event_id", "ts", "value").groupBy("user_id")
    return keyed.applyInPandasWithState(run, "user_id long, event_id long, value double", "last double", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there (availableNow), writing each batch as a table, and returns its rows."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out{'' if mode == 'complete' else f'/b={epoch}'}")

    started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(sink).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


def _exits(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    """For rows sorted by (listing_id, block, t): which row is the last accepted one of the block if a given one is the first.

    The last accepted row before a block is older than its first row, so only rows up to `span` after that, and the
    next one, can be the first accepted. A block is held in memory, a bounded number of rows.
    """

    def of_block(key: tuple, times: list[int]) -> pd.DataFrame:
        t = np.unique(np.array(times, dtype=np.int64))
        following = np.searchsorted(t, t + span).tolist()
        out = t.tolist()
        for i in range(len(out) - 1, -1, -1):
            if following[i] < len(out):
                out[i] = out[following[i]]
        n = min(len(out), int(np.searchsorted(t, t[0] + span)) + 1)
        return pd.DataFrame({"listing_id": pd.array([key[0]] * n, dtype="Int64"), "block": key[1], "entry": t[:n], "exit": out[:n]})

    current, times = None, []
    for batch in batches:
        for listing, block, t in zip(batch["listing_id"].tolist(), batch["block"].tolist(), batch["t"].tolist(), strict=True):
            if (listing, block) != current:
                if times:
                    yield of_block(current, times)
                current, times = (listing, block), []
            times.append(t)
    if times:
        yield of_block(current, times)


def _handed_on(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    """For the rows of `_exits` sorted by (listing_id, block, entry): the last accepted time before each block of a listing."""
    listing = block = last = None
    entered = False
    for batch in batches:
        out = []
        for key, at, entry, leave in zip(*(batch[c].tolist() for c in ("listing_id", "block", "entry", "exit")), strict=True):
            if key != listing:
                listing, block, last = key, None, None
            if at != block:
                block, entered = at, False
                if last is not None:
                    out.append((listing, block, last))
            if not entered and (last is None or entry >= last + span):
                last, entered = leave, True
        yield pd.DataFrame(out, columns=["listing_id", "block", "before"])


def accepted(history: DataFrame, hours: int = 12, hot_rows: int | None = None) -> DataFrame:
    """listing_id, id of rows accepted when one within `hours` after the last accepted row of its listing is skipped.

    Rows are ordered by time and id; those without a time or listing are none. A hot listing is cut into blocks of
    time: what a block does to the last accepted time is found for each block apart, handed on over the blocks, and
    then each block is read from the time that reaches it, so that no task reads all rows of a listing.
    """
    span = hours * 3_600_000_000
    rows = history.filter("scraped_at is not null and listing_id is not null").select("listing_id", "id", "scraped_at")
    blocks = find_blocks(rows, "listing_id", "scraped_at", hot_rows)
    rows = blocks.place(rows, "scraped_at", "id").select("listing_id", "block", F.unix_micros("scraped_at").alias("t"), "id")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "listing_id long, block int"
    if blocks.hot:
        hot = rows.filter(blocks.is_hot()).repartition(tasks, "listing_id", "block").sortWithinPartitions("listing_id", "block", "t")
        exits = hot.select("listing_id", "block", "t").mapInPandas(lambda b: _exits(b, span), f"{kind}, entry long, exit long")
        ordered = exits.repartition(tasks, "listing_id").sortWithinPartitions("listing_id", "block", "entry")
        rows = carry(rows, blocks, ordered.mapInPandas(lambda b: _handed_on(b, span), f"{kind}, before long"), ["before"])
    else:
        rows = rows.withColumn("before", F.lit(None).cast("long"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, due = None, 0
        for batch in batches:
            out = []
            before = batch["before"].fillna(-(2**62)).astype("int64").tolist()
            for listing, block, t, i, at in zip(*(batch[c].tolist() for c in ("listing_id", "block", "t", "id")), before, strict=True):
                if (listing, block) != current:
                    current, due = (listing, block), at + span
                if t >= due:
                    out.append((listing, i))
                    due = t + span
            yield pd.DataFrame(out, columns=["listing_id", "id"])

    each = rows.repartition(tasks, "listing_id", "block").sortWithinPartitions("listing_id", "block", "t", "id")
    return each.mapInPandas(fold, "listing_id long, id long")
