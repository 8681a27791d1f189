"""Session set-up and the shared folder for checkpoints and tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "touchline", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on. On a cluster, leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder path below the checkpoint folder the session names.

    Only a local session without that setting gets a temporary folder, since every
    executor must be able to reach the path.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str, within: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For rows that several branches of a plan need: without it Spark would run everything
    below them, page parsing included, once per branch. The table survives the loss of
    executors, and its size tells the planner whether it may be broadcast. The path is added
    to ``within``, for a caller that can tell when the table is no longer needed.
    """
    path = shared_dir(df.sparkSession, purpose)
    if within is not None:
        within.append(path)
    with passing_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """For writes: their shuffle files go when they end, not when the driver's heap is next collected.

    A frame that is run twice within it would shuffle twice.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


@contextmanager
def staging(spark: SparkSession) -> Iterator[list[str]]:
    """A list for ``staged``, whose tables are removed when the block ends."""
    paths: list[str] = []
    try:
        yield paths
    finally:
        for path in paths:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is never broadcast.

    For tables whose rows were counted and are too many, or have no bound. Spark guesses the size
    of what is generated or aggregated from the files below, many times too small, and would send
    it to the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Exchange with a fixed task count.

    These rows are few bytes but much work, so adaptive execution must not merge their
    tasks. It also pins what was computed before it: a projection right below a broadcast
    join is evaluated once per joined pair. Spark drops an exchange on the very columns
    the rows are already partitioned by, so name them in another order.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *columns)
