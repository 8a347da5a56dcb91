"""Session settings, table access and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its counted rows are at most this.
BROADCAST_ROWS = 100_000


def session(name: str = "pricegrain", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, last key wins in maps)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a folder of parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on local[...] one of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(shared_folder, "own", None)
        if not folder:
            folder = shared_folder.own = "file://" + tempfile.mkdtemp(prefix="pricegrain-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, counts: dict[str, Column] | None = None):
    """The same rows with their lineage cut: written as a table to the shared folder and read again.

    Parquet rather than checkpoint(): columnar and compressed, and without the constraints a checkpointed plan
    keeps, which grow with every round of an iteration. The tables are removed when the driver ends. With `counts`,
    aggregates observed while writing, the result is (rows, {name: value}).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    seen = Observation()
    (df.observe(seen, *[c.alias(n) for n, c in counts.items()]) if counts else df).write.parquet(path)
    if not _tables:
        atexit.register(_remove, spark)
    _tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    return (out, seen.get) if counts else out


_tables: list[str] = []


def _remove(spark: SparkSession) -> None:
    try:
        jvm = spark._jvm
        for path in _tables:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone
        pass


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least as many partitions as there are cores, for costly work on each row.

    Input that is split enough already, as any large table is, is not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a table expected to be small: broadcast after its rows were counted, else an ordinary join.

    `small` should be cheap to evaluate twice (a written table).
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return df.join(small, on, how)


def cents(price: str | Column) -> Column:
    """A decimal price as whole cents."""
    return (F.col(price) if isinstance(price, str) else price).cast("decimal(20,2)").__mul__(100).cast("long")
