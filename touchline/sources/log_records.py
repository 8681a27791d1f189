"""Whole log records: continuation lines joined to the line they continue.

A line's place is (batch, file, block, line): the micro-batch that read it, its file, the offset
of its split and its number in the split. Heads are carried from split to split and from file
to file, so a record may be cut by any border. A stream keeps the lines of the last record of
each log, whose end is not known yet, and puts them before those of the next batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.operators.carry import carry_forward
from touchline.operators.consolidate import read_or_empty
from touchline.session import shuffled, staged, staging
from touchline.sources.logs import is_head, parse_log_lines
from touchline.streaming.jobs import start, writer_of

_PLACE = ["batch", "file", "block", "line"]
_LINES = "log string, value string, batch bigint, file string, block bigint, line bigint"
RECORDS = (
    "log string, time string, level string, pids array<string>, modules array<string>, message string,"
    " is_continuation boolean, lines bigint"
)


def _located(lines: DataFrame) -> DataFrame:
    """Lines of text files with their log, which is the folder, and their file and split."""
    path = F.col("_metadata.file_path")
    return lines.select(
        "value", F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("log"), path.alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.unix_millis("_metadata.file_modification_time").alias("modified"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines already in the logs with their places; the files of a log follow by path."""
    located = _located(spark.read.text(path)).drop("modified")
    return located.select(
        "log", "value", F.lit(0).cast("bigint").alias("batch"), "file", "block",
        F.monotonically_increasing_id().alias("line"),
    )


def stream_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Lines of files as they arrive; the files of a log follow by time, as the source takes them."""
    return _located(spark.readStream.option("maxFilesPerTrigger", max_files).text(path))


def _headed(lines: DataFrame) -> DataFrame:
    """``lines`` with the place of the head of their record; null before a log's first head."""
    return carry_forward(
        lines, ["log"], _PLACE, is_head(F.col("value")), F.struct(*_PLACE), F.struct(*_PLACE[:3]), "head"
    )


def _joined(headed: DataFrame) -> DataFrame:
    """One row per record; lines without a head stay rows of their own."""
    texts = F.transform(
        F.array_sort(F.collect_list(F.struct(*_PLACE, "value"))), lambda line: line["value"]
    )
    whole = headed.filter("head is not null").groupBy("log", "head").agg(texts.alias("texts"))
    alone = headed.filter("head is null").select("log", "head", F.array("value").alias("texts"))
    parsed = parse_log_lines(
        whole.unionByName(alone).withColumn("first", F.get("texts", F.lit(0))), "first"
    )
    rest = F.expr("slice(texts, 2, greatest(size(texts) - 1, 0))")
    return parsed.select(
        "log", "time", "level", "pids", "modules",
        F.array_join(F.concat(F.array("message"), rest), "\n").alias("message"),
        "is_continuation", F.size("texts").cast("bigint").alias("lines"),
    )


def log_records(lines: DataFrame) -> DataFrame:
    """Records of ``lines`` (see ``read_lines``) as ``RECORDS``.

    The fields are those of the first line; the message goes on with the lines that continue
    it, however the log was cut. Lines before the first head of a log are records of their
    own with the flag set. A log may have any size, since heads are carried from split to
    split; a record is one value.
    """
    return _joined(_headed(lines))


def follow_records(
    lines: DataFrame, out: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Store the records of a stream of lines below ``out``, each once it is complete.

    A record is complete when the next one of its log begins. The lines of each log's last
    record are kept per batch, and begin the next batch; a replayed batch reads those of the
    batch before it and replaces what it wrote.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, writer = batch.sparkSession, writer_of(batch)
        with staging(spark) as within:
            arrived = batch.select(
                "log", "value", F.lit(batch_id).cast("bigint").alias("batch"),
                F.concat(F.lpad(F.col("modified").cast("string"), 15, "0"), F.lit(" "), "file").alias("file"),
                "block", F.monotonically_increasing_id().alias("line"),
            )
            lines = staged(_headed(_open(spark, out, writer, batch_id).unionByName(arrived)), "lines", within)
            last = shuffled(lines.groupBy("log").agg(F.max("head").alias("head")).filter("head is not null"))
            # Met by log and head: by log alone, all lines of a log would be in one task.
            headed, record = lines.filter("head is not null"), ["log", "head"]
            # Without a head, lines continue nothing and are complete.
            complete = headed.join(last, record, "left_anti").unionByName(lines.filter("head is null"))
            _write(_joined(complete), f"{out}/records", writer, batch_id)
            _write(headed.join(last, record, "left_semi").drop("head"), f"{out}/open", writer, batch_id)

    return start(lines, store, "append", checkpoint, interval)


def _write(rows: DataFrame, path: str, writer: str, batch_id: int) -> None:
    keyed = rows.withColumns({"writer": F.lit(f"={writer}"), "stored": F.lit(batch_id).cast("bigint")})
    (
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("writer", "stored").parquet(path)
    )


def _open(spark: SparkSession, out: str, writer: str | None = None, before: int | None = None) -> DataFrame:
    """Lines of the records left open by the last batch of each writer, or of the one before a batch."""
    kept = read_or_empty(spark, f"{out}/open", f"{_LINES}, writer string, stored bigint")
    if writer is not None:
        kept = kept.filter((F.col("writer") == f"={writer}") & (F.col("stored") < before))
    last = kept.groupBy("writer").agg(F.max("stored").alias("stored"))
    return kept.join(last, ["writer", "stored"]).drop("writer", "stored")


def read_records(spark: SparkSession, out: str) -> DataFrame:
    """Records that a stream has stored, and those it still holds open, as far as they go."""
    stored = read_or_empty(spark, f"{out}/records", f"{RECORDS}, writer string, stored bigint")
    return stored.drop("writer", "stored").unionByName(log_records(_open(spark, out)))
