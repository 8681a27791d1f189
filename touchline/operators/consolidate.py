"""One row per (league, fixture, date) with the latest score of each source."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline import schemas
from touchline.session import passing_shuffles

SOURCES = ("bbc", "fishy")
KEY = ["league", "name", "date"]


def consolidate_scores(results: DataFrame) -> DataFrame:
    """Latest score per source, by arrival order; works on batch and streaming rows.

    ``created_at`` is the first arrival and ``updated_at`` the last of either source. All
    aggregates merge, so Spark combines them before the shuffle and a fixture with very
    many versions costs its task little.
    """
    arrival = F.struct("fetched_at", "page_id", "pos")
    latest = [
        (F.when(F.col("source") == s, F.struct(arrival.alias("o"), F.col("score").alias("s"))), s)
        for s in SOURCES
    ]
    return (
        results.groupBy(*KEY)
        .agg(
            F.min("fetched_at").alias("created_at"),
            F.max("fetched_at").alias("updated_at"),
            *[F.max(version).alias(s) for version, s in latest],
        )
        .select(*_flat())
    )


def merge_events(events: DataFrame) -> DataFrame:
    """Merge rows of one key from several batches; merging a row twice changes nothing."""
    return (
        events.groupBy(*KEY)
        .agg(
            F.min("created_at").alias("created_at"),
            F.max("updated_at").alias("updated_at"),
            *[
                F.max(
                    F.when(
                        F.col(f"{s}_order").isNotNull(),
                        F.struct(F.col(f"{s}_order").alias("o"), F.col(f"{s}_score").alias("s")),
                    )
                ).alias(s)
                for s in SOURCES
            ],
        )
        .select(*_flat())
    )


def _flat() -> list:
    return [
        *KEY,
        *[F.col(f"{s}.s").alias(f"{s}_score") for s in SOURCES],
        "created_at",
        "updated_at",
        *[F.col(f"{s}.o").alias(f"{s}_order") for s in SOURCES],
    ]


#: A table is a folder of plain Parquet: ``rows``, and ``marks`` with the dates purged up to.
_ROWS, _MARKS = "rows", "marks"
_PARTITIONS = ["year", "writer", "batch"]


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The Parquet table at ``path``; empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        # Known to be empty when planned, unlike rows from Python.
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).limit(0)


def _unexpired(rows: DataFrame, mark: str | None) -> DataFrame:
    """Rows not dated before ``mark``; rows without a date never expire."""
    return rows if mark is None else rows.filter(F.coalesce(F.col("date") >= mark, F.lit(True)))


def upsert_events(batch: DataFrame, batch_id: int, path: str, writer: str = "main") -> None:
    """Add one batch of consolidated rows to the table at ``path``.

    The batch overwrites the partitions of its writer and number, so a replay replaces what
    its first run wrote; each stream needs a writer name of its own. Earlier batches are not
    read, so the cost is that of the batch, however large the table. Rows dated before the
    low-water mark of the table are left out, be they late or replayed.
    """
    _store(_unexpired(batch, low_water(batch.sparkSession, path)), batch_id, path, writer)


def _store(rows: DataFrame, batch_id: int, path: str, writer: str) -> None:
    # Led by a sign, so that values that are empty or look like none survive.
    keyed = rows.withColumns({
        "year": F.concat(F.lit("="), F.coalesce(F.substring("date", 1, 4), F.lit(""))),
        "writer": F.lit(f"={writer}"), "batch": F.lit(batch_id).cast("bigint"),
    })
    # Few files a batch however many leagues; in them a league is a range, which readers skip to.
    with passing_shuffles(rows.sparkSession):
        (
            keyed.hint("rebalance", "year").sortWithinPartitions(*_PARTITIONS, "league", "date")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(*_PARTITIONS).parquet(f"{path}/{_ROWS}")
        )


def read_events(spark: SparkSession, path: str, leagues: list[str] | None = None) -> DataFrame:
    """Current rows of the table; naming leagues reads only the row groups that hold them.

    Partitions of purged years are not read. A table without batches is empty.
    """
    mark = low_water(spark, path)
    kinds = [T.StringType(), T.StringType(), T.LongType()]
    stored_as = T.StructType([*schemas.EVENTS, *map(T.StructField, _PARTITIONS, kinds)])
    stored = read_or_empty(spark, f"{path}/{_ROWS}", stored_as)
    if leagues is not None:
        stored = stored.filter(F.col("league").isin(leagues))
    if mark is not None:
        stored = stored.filter((F.col("year") == "=") | (F.col("year") >= f"={mark[:4]}"))
    return merge_events(_unexpired(stored, mark))


def low_water(spark: SparkSession, path: str) -> str | None:
    """The date before which rows are purged; null if there was no purge. It only rises."""
    return read_or_empty(spark, f"{path}/{_MARKS}", "mark string").agg(F.max("mark")).first()[0]


def purge_events(spark: SparkSession, path: str, before: str) -> None:
    """Expire all rows dated before the ISO date ``before``, for good.

    The mark is all that is written: readers skip the partitions of earlier years and the
    earlier rows of its own year, and writers leave such rows out, so neither a late page nor
    a replayed batch brings them back, not even one that began before the purge. Their files
    go with the next ``rewrite_events``. A mark below an earlier one has no effect.
    """
    mark = date.fromisoformat(before).isoformat()
    spark.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("append").parquet(f"{path}/{_MARKS}")


def rewrite_events(spark: SparkSession, path: str, new_path: str) -> None:
    """A new table at ``new_path`` with the current rows of ``path``, merged, and its mark.

    The old table stays as it is, so its readers are not disturbed; writers move to the new
    one when the job is done. Purged rows are in the new table no more.
    """
    mark = low_water(spark, path)
    if mark is not None:
        purge_events(spark, new_path, mark)
    _store(read_events(spark, path), 0, new_path, "rewritten")


def events_for_league(spark: SparkSession, path: str, code: str) -> DataFrame:
    return read_events(spark, path, [code])


def all_events(spark: SparkSession, path: str) -> DataFrame:
    return read_events(spark, path)


def count_by_league(events: DataFrame) -> DataFrame:
    return events.groupBy("league").agg(F.count("*").alias("count"))
