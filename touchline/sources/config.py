"""League list and team dictionaries from JSON files."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import schemas
from touchline.functions.text import normalized

log = logging.getLogger(__name__)


def read_leagues(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the league list file in file order; empty if missing or undecodable."""
    return decode_leagues(_whole_files(spark, path))


def read_entities(spark: SparkSession, path: str, leagues: DataFrame) -> DataFrame:
    """Dictionary of every listed league from the folder's ``<code>.json`` files."""
    return decode_entities(_whole_files(spark, f"{path.rstrip('/')}/*.json"), leagues)


def missing_dictionaries(spark: SparkSession, path: str, leagues: DataFrame) -> DataFrame:
    """(league, reason) of the listed leagues without a usable dictionary file."""
    return missing_files(_whole_files(spark, f"{path.rstrip('/')}/*.json"), leagues)


def missing_files(files: DataFrame, leagues: DataFrame) -> DataFrame:
    """The same from (path, value) rows."""
    wanted = leagues.select(F.col("code").alias("league")).distinct()
    reason = F.when(F.col("value").isNull(), "file missing").when(
        F.col("entries").isNull(), "not decodable"
    )
    return (
        wanted.join(_by_stem(files), "league", "left")
        .select("league", reason.alias("reason"))
        .filter("reason is not null")
    )


def decode_leagues(files: DataFrame) -> DataFrame:
    """League rows from (path, value) rows that hold one JSON array each."""
    return files.select(
        F.posexplode(_decoded("value", schemas.LEAGUE_ENTRY.simpleString())).alias("league_idx", "e")
    ).select("e.*", "league_idx")


def decode_entities(files: DataFrame, leagues: DataFrame) -> DataFrame:
    """Alias rows from (path, value) rows; the file stem names the league.

    Position 0 of an entity is its name, its other names follow in file order.
    """
    codes = leagues.select(F.col("code").alias("league")).distinct()
    names = F.concat(
        F.array("e.name"), F.coalesce("e.altNames", F.array().cast("array<string>"))
    )
    return (
        _by_stem(files)
        .join(codes, "league", "left_semi")
        .select("league", F.posexplode("entries").alias("entity_pos", "e"))
        .select(
            "league", "entity_pos", F.col("e.name").alias("entity"),
            F.posexplode(names).alias("alias_pos", "alias"),
        )
        .filter(F.col("alias").isNotNull())
        .select(
            "league", "entity_pos", "alias_pos", "entity", "alias",
            normalized(F.col("alias")).alias("alias_norm"),
        )
    )


def _by_stem(files: DataFrame) -> DataFrame:
    return files.select(
        F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("league"),
        "value",
        _decoded("value", schemas.ENTITY_ENTRY.simpleString()).alias("entries"),
    )


def _decoded(value: str, entry: str) -> Column:
    """The JSON array, or null where the text is not one.

    The JSON reader takes a lone object for an array of one, so the first sign is looked at.
    It has no size limit of its own, other than that of a string.
    """
    return F.when(
        F.startswith(F.ltrim(F.col(value), F.lit(" \t\r\n\ufeff")), F.lit("[")),
        F.from_json(value, f"array<{entry}>", {"mode": "PERMISSIVE"}),
    )


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    try:
        files = spark.read.text(path, wholetext=True)
        return files.select(F.col("_metadata.file_path").alias("path"), "value")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("nothing to read at %s", path)
        return spark.createDataFrame([], "path string, value string")
