"""Per-league JSON documents ``{"league": .., "count": .., "events": [..]}``.

A league may hold more events than fit in one value, so a document is a sequence of text
lines: an opening line, one line per event, a closing line. Joined in order they are one
valid JSON document; no task ever holds a whole league.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import staged

OPENING, EVENT, CLOSING = 0, 1, 2
_ORDER = ["league_part", "part", "date", "name"]


def league_feed(events: DataFrame, codes: DataFrame) -> DataFrame:
    """(league, part, date, name, line) of the documents of the requested leagues.

    Lines are in document order by (part, date, name). Missing scores are left out; a
    league without events gets an empty list.
    """
    wanted = codes.select(F.col("code").alias("league")).distinct()
    # Counted and listed, so written once; events are aggregated or read only here.
    chosen = staged(events.join(wanted, "league", "left_semi"), "feed")
    per_league = chosen.groupBy("league").agg(
        F.count("*").alias("count"), F.min(F.struct("date", "name")).alias("first")
    )
    none = F.lit(None).cast("string")
    opening = F.concat(
        F.lit('{"league":'), _quoted("league"), F.lit(',"count":'),
        F.coalesce("count", F.lit(0)).cast("string"), F.lit(',"events":['),
    )
    frame = wanted.join(per_league.select("league", "count"), "league", "left").select(
        "league",
        F.inline(
            F.array(
                F.struct(F.lit(OPENING).alias("part"), opening.alias("line")),
                F.struct(F.lit(CLOSING).alias("part"), F.lit("]}").alias("line")),
            )
        ),
    ).select("league", "part", none.alias("date"), none.alias("name"), "line")
    record = F.to_json(
        F.struct(
            "league", "name", "date", "bbc_score", "fishy_score",
            F.unix_millis("created_at").alias("created_at"),
            F.unix_millis("updated_at").alias("updated_at"),
        )
    )
    is_first = F.struct("date", "name").eqNullSafe(F.col("first"))
    lines = chosen.join(per_league.select("league", "first"), "league").select(
        "league", F.lit(EVENT).alias("part"), "date", "name",
        F.concat(F.when(is_first, "").otherwise(","), record).alias("line"),
    )
    return frame.unionByName(lines)


def _quoted(column: str):
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(F.col(column).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def write_league_feed(feed: DataFrame, path: str) -> None:
    """Text files per league whose lines, in file order, are the documents.

    Range partitioning sorts across tasks and splits a large league over several files. Folders
    are named by a sign and the code, so that the empty code has one as well.
    """
    (
        feed.withColumn("league_part", F.concat(F.lit("="), "league"))
        .repartitionByRange(*_ORDER)
        .sortWithinPartitions(*_ORDER)
        .select("league_part", "line")
        .write.mode("overwrite")
        .partitionBy("league_part")
        .text(path)
    )


def read_league_feeds(spark: SparkSession, path: str) -> DataFrame:
    """(league, file, value): the lines of all documents with the file each came from."""
    feed = spark.read.schema("value string, league_part string").text(path)
    return feed.select(
        F.substring("league_part", 2, 1 << 30).alias("league"),
        F.col("_metadata.file_name").alias("file"), "value",
    )


def read_league_feed(spark: SparkSession, path: str, code: str) -> DataFrame:
    """Lines of one league's document, from its folder only, with the file each came from."""
    return read_league_feeds(spark, path).where(F.col("league") == code).drop("league")
