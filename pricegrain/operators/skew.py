"""Problem 1: exact per-key figures when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Weighted values that one range of values should hold, and least and most ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 500_000, 32, 4_096


def weighted_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """_k, _v and _w, the rows with that key and value: written, since it is read more than once."""
    rows = df.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return written(rows.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_w")))


def profile(weighted: DataFrame, key: str, quantiles: dict[str, float]) -> DataFrame:
    """The figures of `key_profile` from weighted values."""
    kind = weighted.schema["_v"].dataType.simpleString()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, weighted.count() // RANGE_ROWS))
    steps = ",".join(str(i / ranges) for i in range(1, ranges))
    cuts = sorted(set(weighted.agg(F.expr(f"percentile_approx(_v, array({steps}), {10 * ranges})")).head()[0] or []))
    # a range is found by its group of cuts first, then inside the group
    size = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    literal = F.array(*[F.array(*[F.lit(c).cast(kind) for c in g]) for g in groups]) if cuts else None
    if cuts:
        full = F.size(F.filter(literal, lambda g: F.element_at(g, 1) < F.col("_v")))
        rank = F.when(full > 0, (full - 1) * size + F.size(F.filter(F.get(literal, full - 1), lambda c: c < F.col("_v")))).otherwise(0)
    else:
        rank = F.lit(0)
    weighted = weighted.withColumn("_r", F.when(F.col("_v").isNull(), -1).otherwise(rank))
    known = F.col("_v").isNotNull()
    by_range = weighted.groupBy("_k", "_r").agg(
        F.sum("_w").alias("_n"),
        F.count("_v").alias("_d"),
        F.sum(F.when(known, F.col("_w")).otherwise(0)).alias("_m"),
        F.max(F.when(known, F.col("_w"))).alias("_top"),
    )
    by_key = Window.partitionBy("_k")
    below = by_range.select(
        "_k", "_r",
        F.sum("_m").over(by_key.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)).alias("_below"),
        F.sum("_m").over(by_key).alias("_all"),
        F.sum("_n").over(by_key).alias("_rows"),
        F.sum("_d").over(by_key).alias("_values"),
        F.max("_top").over(by_key).alias("_most"),
    )
    inside = Window.partitionBy("_k", "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    r, b = weighted.withColumn("_cum", F.sum("_w").over(inside)).alias("r"), below.alias("b")
    placed = r.join(b, F.col("r._k").eqNullSafe(F.col("b._k")) & (F.col("r._r") == F.col("b._r"))).select(
        F.col("r._k").alias("_k"), "_v", "_w", "_all", "_rows", "_values", "_most",
        (F.col("_cum") + F.coalesce(F.col("_below"), F.lit(0))).alias("_to"),
    )
    picked = [F.min(F.when(known & (F.col("_to") >= q * F.col("_all")), F.col("_v"))).alias(name) for name, q in quantiles.items()]
    return placed.groupBy(F.col("_k").alias(key)).agg(
        F.max("_rows").alias("n_rows"),
        F.max("_all").alias("n_known"),
        F.max("_values").alias("n_values"),
        F.min(F.when(known & (F.col("_w") == F.col("_most")), F.col("_v"))).alias("mode"),
        *picked,
    )


def key_profile(df: DataFrame, key: str, value: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Rows, non-null values, distinct values, mode and exact quantiles of `value` for every `key`.

    Value-frequency compression: rows are first counted by (key, value), which the map side combines, so a
    hot key shrinks to its distinct values before any exchange. These weighted values, written once, are summed
    again by (key, range of value), the ranges being global cuts at approximate quantiles of the weighted values, as
    many as their number asks for; running weights are kept inside a range and lifted by the weight of the key's
    lower ranges, so no task holds all values of a key.

    Quantiles are discrete: the least value whose cumulated weight reaches q of the non-null rows. The mode
    is the most frequent non-null value, of ties the least. A null key is a key of its own; nulls of `value`
    count in n_rows only; a key with nulls only has n_values 0 and null mode and quantiles; an empty table
    gives no rows. Columns of `df` other than key and value are not touched.
    """
    return profile(weighted_values(df, key, value), key, quantiles if quantiles is not None else {"p50": 0.5, "p90": 0.9})


def heavy_keys(df: DataFrame, key: str, value: str, share: float = 0.05) -> DataFrame:
    """The profiles of the non-null keys that hold at least `share` of all rows of `df`."""
    weighted = weighted_values(df, key, value)
    total = weighted.agg(F.sum("_w")).head()[0] or 0
    return profile(weighted, key, {"p50": 0.5, "p90": 0.9}).filter(F.col(key).isNotNull() & (F.col("n_rows") >= F.lit(share) * total))
