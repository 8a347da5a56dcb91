"""Sinks: versioned snapshots, backups that never overwrite, and the run report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole versions of a snapshot folder (those whose write ended), ascending."""
    fs, at = _file_system(spark, folder)
    if not fs.exists(at):
        return []
    names = [x.getPath() for x in fs.listStatus(at)]
    done = [p.getName() for p in names if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def write_snapshot(df: DataFrame, folder: str) -> int:
    """Writes the next version; the one that is read stays until the new one is whole."""
    found = versions(df.sparkSession, folder)
    version = (found[-1] if found else 0) + 1
    df.write.mode("overwrite").parquet(f"{folder}/v={version}")
    return version


def read_snapshot(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of a snapshot, the last by default."""
    return spark.read.parquet(f"{folder}/v={version or versions(spark, folder)[-1]}")


def write_backup(df: DataFrame, path: str) -> None:
    """JSON lines; fails if the path exists."""
    df.write.mode("errorifexists").json(path)


def report(df: DataFrame, counts: dict[str, str]) -> DataFrame:
    """One row with the number of rows for which each condition holds."""
    return df.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in counts.items()])
