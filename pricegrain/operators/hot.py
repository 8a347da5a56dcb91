"""Splitting of hot keys into blocks along an order, and neighbours across the blocks.

A key that holds many rows (found by one sketch pass) has its rows cut into blocks of time at quantiles of its own
times, so that one stray date moves no cut. What must see the neighbouring row is computed inside each (key, block);
only the edge rows of the blocks of hot keys, a bounded number, are compared across blocks. A null key is a key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, written

#: A key is hot from this share of the rows on, or from HOT_ROWS rows on if that is less.
HOT_SHARE = 1 / 500
HOT_ROWS = 2_000_000
#: At most so many keys are hot; beyond HOT_KEYS * HOT_ROWS rows a key is hot from that part of all rows on.
HOT_KEYS = 5_000
#: Rows of a hot key that one block should hold, and most blocks of a key (beyond, its blocks are larger).
BLOCK_ROWS = 50_000
MOST_BLOCKS = 1_000
_GROUP = 32  # cuts looked through at once: first the groups of cuts, then the cuts of one group


@dataclass(frozen=True)
class Blocks:
    """Hot keys, each with the times at which it is cut; every other key is block 0."""

    key: str
    kind: str
    hot: tuple  # of (key, ascending cuts in microseconds)

    def is_hot(self) -> Column:
        values = [k for k, _ in self.hot if k is not None]
        known = F.coalesce(F.col(self.key).isin(values), F.lit(False)) if values else F.lit(False)
        return known | F.col(self.key).isNull() if len(values) < len(self.hot) else known

    def _with_cuts(self, df: DataFrame) -> DataFrame:
        """Adds `_cuts`, groups of cuts of a hot key (null for the others), from a broadcast table of bounded size."""
        rows = [(k, [list(cuts[i : i + _GROUP]) for i in range(0, len(cuts), _GROUP)]) for k, cuts in self.hot]
        table = df.sparkSession.createDataFrame(rows, f"_hot {self.kind}, _cuts array<array<bigint>>")
        return df.join(F.broadcast(table), F.col(self.key).eqNullSafe(F.col("_hot")) & self.is_hot(), "left").drop("_hot")

    def place(self, df: DataFrame, time: str | Column, spread: str) -> DataFrame:
        """Adds `block`; rows of a hot key without a time are spread over its blocks by the column `spread`."""
        if not self.hot:
            return df.withColumn("block", F.lit(0))
        micros = F.unix_micros(time)
        groups = F.size(F.filter("_cuts", lambda g: F.element_at(g, 1) <= F.col("_micros")))
        inside = F.size(F.filter(F.get("_cuts", groups - 1), lambda c: c <= F.col("_micros")))
        by_time = F.when(groups > 0, (groups - 1) * _GROUP + inside).otherwise(0)
        by_hash = F.pmod(F.xxhash64(spread), F.size(F.flatten("_cuts")) + 1).cast("int")
        block = F.when(F.col("_cuts").isNull(), 0).when(F.col("_micros").isNull(), by_hash).otherwise(by_time)
        return self._with_cuts(df.withColumn("_micros", micros)).withColumn("block", block).drop("_cuts", "_micros")

    def each_block(self, df: DataFrame) -> DataFrame:
        """Rows by key, repeated for every block of a hot key (a bounded number of keys and blocks)."""
        if not self.hot:
            return df.withColumn("block", F.lit(0))
        last = F.coalesce(F.size(F.flatten("_cuts")), F.lit(0))
        return self._with_cuts(df).withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0))))).drop("_cuts")


def find_blocks(df: DataFrame, key: str, time: str, min_rows: int | None = None) -> Blocks:
    """Hot keys of `df` by one pass with a heavy-hitter sketch, and their cuts by a pass over the hot keys' rows.

    No key under `min_rows` rows is hot. The sketches only decide how the work is spread, never what comes out.
    """
    min_rows = BLOCK_ROWS if min_rows is None else min_rows
    kind = df.schema[key].dataType.simpleString()
    least = F.greatest(F.lit(min_rows), F.least(F.col("n") * HOT_SHARE, F.greatest(F.lit(HOT_ROWS), F.col("n") / HOT_KEYS)))
    seen = df.agg(F.expr(f"approx_top_k({key}, {HOT_KEYS}, {4 * HOT_KEYS})").alias("top"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("none"))
    found = seen.select(F.filter("top", lambda x: x["item"].isNotNull() & (x["count"] >= least)).alias("top"), F.when(F.col("none") >= least, F.col("none")).alias("none")).head()
    counts = {x["item"]: x["count"] for x in found["top"] or []} | ({None: found["none"]} if found["none"] else {})
    if not counts:
        return Blocks(key, kind, ())
    number = {k: min(MOST_BLOCKS, max(8, math.ceil(n / BLOCK_ROWS))) for k, n in counts.items()}
    grid = max(number.values())
    hot = Blocks(key, kind, tuple((k, ()) for k in counts))
    shares = ",".join(str(i / grid) for i in range(1, grid))
    rows = df.filter(hot.is_hot()).groupBy(key).agg(F.expr(f"percentile_approx(unix_micros({time}), array({shares}), 2000)").alias("cuts")).collect()
    cut = {r[key]: sorted({r["cuts"][round(i * grid / number[r[key]]) - 1] for i in range(1, number[r[key]])}) for r in rows if r["cuts"]}
    return Blocks(key, kind, tuple((k, tuple(c)) for k, c in cut.items() if c))


def carry(rows: DataFrame, blocks: Blocks, carried: DataFrame, columns: list[str]) -> DataFrame:
    """`rows` with the columns that a table by (key, block) of the hot keys' blocks has for them."""
    small = written(carried.select(F.col(blocks.key).alias("_key"), F.col("block").alias("_block"), *columns))
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    same = F.col(blocks.key).eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block"))
    return rows.join(small, same, "left").drop("_key", "_block")


def running_last(rows: DataFrame, blocks: Blocks, order: list[str], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Adds the last non-null `value` of the row's key up to the row (or before it), across the blocks of a hot key.

    `rows` has the key, `block` and the columns of `order`. For hot keys the last value of each block is found by a
    partial aggregate and handed on over the key's blocks, a number that is bounded.
    """
    frame = Window.partitionBy(blocks.key, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.withColumn("_value", value).withColumn(name, F.last("_value", ignorenulls=True).over(frame))
    if blocks.hot:
        hot = rows.filter(blocks.is_hot()).withColumn("_value", value)
        ends = hot.groupBy(blocks.key, "block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"))
        over = Window.partitionBy(blocks.key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(blocks.key, "block", F.last("_end", ignorenulls=True).over(over).alias("_carried"))
        out = carry(out, blocks, carried, ["_carried"]).withColumn(name, F.coalesce(name, "_carried")).drop("_carried")
    return out.drop("_value")


def with_previous(df: DataFrame, key: str, time: str, tie: str, value: str, name: str, min_rows: int | None = None) -> DataFrame:
    """Adds the value of the key's row before this one, as a struct of one field `v`; null for the first row."""
    blocks = find_blocks(df, key, time, min_rows)
    return running_last(blocks.place(df, time, tie), blocks, [time, tie], F.struct(F.col(value).alias("v")), name, inclusive=False).drop("block")
