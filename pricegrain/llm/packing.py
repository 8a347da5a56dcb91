"""Problem 9: items of varying length placed in containers of fixed capacity."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_small, written

CAPACITY = 2_048
OPEN = 64
#: Containers' worth of items that one part packs, and parts whose last open containers are merged together.
PART_CONTAINERS, MERGED_PARTS = 1_024, 32


class Windows:
    """A fixed number of open containers; best fit, and the fullest is closed when none fits."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.made = capacity, limit, 0
        self.open: list[tuple[int, int]] = []  # (room left, container), ascending

    def place(self, size: int) -> tuple[int, int]:
        """(container, offset in it) of the next item."""
        k = bisect_left(self.open, (size, -1))
        if k < len(self.open):
            room, container = self.open.pop(k)
        else:
            if len(self.open) >= self.limit:
                self.open.pop(0)  # the least room: the fullest
            room, container = self.capacity, self.made
            self.made += 1
        insort(self.open, (room - size, container))
        return container, self.capacity - room


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, windows: int = OPEN, part_containers: int = PART_CONTAINERS) -> DataFrame:
    """(key, piece, container, offset, length) of every item: bounded-space online packing.

    An item longer than the capacity is cut into full pieces and a rest; no other item is cut. In each part
    a fixed number of windows is open: a piece goes where it fits best; if it fits nowhere, the fullest window
    is emitted and a new one opened. The windows still open at the end, at most `windows` a part, are then
    merged: groups of parts place them as items, largest first, where they fit best.

    Items without size or of size 0 or less come out with null container and offset and length 0. Nothing is
    dropped: equal rows are placed each for itself. The number of parts follows from the total size and
    `part_containers`; part and order come from a hash of the key, so the containers depend on the items alone, and a
    task that runs again places its items alike. `sizes` is read once.
    """
    rows, total = written(
        sizes.select(F.col(key).alias("_key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size")),
        {"n": F.sum(F.greatest("_size", F.lit(0)))},
    )
    parts = max(1, -(-(total["n"] or 0) // (capacity * part_containers)))
    kind = rows.schema["_key"].dataType.simpleString()
    last = F.ceil(F.col("_size") / capacity) - 1
    pieces = rows.filter("_size > 0").select("_key", "_size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("_key", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("_size") - F.col("piece") * capacity).cast("int").alias("length"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, part = Windows(capacity, windows), TaskContext.get().partitionId()
        for batch in batches:
            placed = [state.place(n) for n in batch["length"].tolist()]
            yield pd.DataFrame({"_key": batch["_key"], "piece": batch["piece"], "part": part, "container": [c for c, _ in placed], "offset": [o for _, o in placed], "length": batch["length"]})
        if state.open:  # what is still open, as rows without an item
            yield pd.DataFrame({"_key": None, "piece": None, "part": part, "container": [c for _, c in state.open], "offset": None, "length": [capacity - r for r, _ in state.open]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, group = Windows(capacity, MERGED_PARTS * windows + 1), None
        for batch in batches:
            out = []
            for g, part, container, n in zip(*(batch[c].tolist() for c in ("group", "part", "container", "length")), strict=True):
                if g != group:
                    state, group = Windows(capacity, MERGED_PARTS * windows + 1), g
                into, shift = state.place(n)
                out.append((part, container, f"{g}-{into}", shift))
            yield pd.DataFrame(out, columns=["part", "container", "into", "shift"])

    # hash partitioning by item is the part; a number of partitions that is asked for is not coalesced
    order = [F.xxhash64("_key", "piece", F.lit(1)), F.col("_key"), F.col("piece"), F.col("length")]
    spread = pieces.repartition(parts, "_key", "piece").sortWithinPartitions(*order)
    placed = written(spread.mapInPandas(place, f"_key {kind}, piece int, part int, container int, offset int, length int"))
    left = placed.filter("piece is null").select("part", "container", "length", F.floor(F.col("part") / MERGED_PARTS).alias("group"))
    left = left.repartition(-(-parts // MERGED_PARTS), "group").sortWithinPartitions("group", F.desc("length"), "part", "container")
    moved = written(left.mapInPandas(merge, "part int, container int, into string, shift int"))
    target = join_small(placed.filter("piece is not null"), moved, ["part", "container"])
    name = F.coalesce(F.concat(F.lit("m"), "into"), F.concat(F.lit("c"), "part", F.lit("-"), "container"))
    out = target.select(F.col("_key").alias(key), "piece", name.alias("container"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"), "length")
    none = rows.filter("_size <= 0").select(F.col("_key").alias(key), F.lit(0).alias("piece"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("offset"), F.lit(0).alias("length"))
    return out.unionByName(none)


def audit(packed: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, items without size, containers over the capacity, pieces that leave a gap or overlap, and items cut though they fit."""
    before = F.lag(F.col("offset") + F.col("length"), 1, 0).over(Window.partitionBy("container").orderBy("offset", "length"))
    pieces = packed.withColumn("gap", F.col("container").isNotNull() & (F.col("offset") != before))
    items = pieces.groupBy(key).agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("pieces"), F.count_if("gap").alias("gaps"))
    by_item = items.agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("n") == 0).alias("empty"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"),
        F.count_if((F.col("pieces") > 1) & (F.col("n") <= capacity)).alias("cut"),
    )
    full = packed.filter("container is not null").groupBy("container").agg(F.sum("length").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("over"))
    names = ["items", "empty", "gaps", "cut", "over"]
    both = by_item.unionByName(full, allowMissingColumns=True)
    return both.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, placed length, and the share of the containers' room that is used."""
    used = packed.filter("container is not null").groupBy("container").agg(F.sum("length").alias("n"))
    return used.agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("used"))
