"""Abbreviation keys whose length follows their count.

Short and long forms meet on the first characters of the short form. Where too many names of
a league share such a key, its node is opened: the short forms below it give the continuations
that occur, the long forms are walked on by each, and those that cannot follow drop out. Nodes
are opened until each holds few names, so a text is compared with few of them; a short form
that ends at a node needs no comparison, since all long forms there follow it to its end.
Only prefixes that occur on the short side are ever opened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import abbrev
from touchline.functions.text import letters
from touchline.session import staged

#: Names of one league under one key, at most; a key with more is opened.
KEY_NAMES = 1000
#: Characters by which an opened key grows.
STEP = 2

_NODE = ["league", "prefix"]


def open_keys(
    shorts: DataFrame, longs: DataFrame, names: str, bound: int, within: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Keys below the crowded nodes that both tables start from.

    ``shorts`` (league, s, prefix, place) and ``longs`` (league, l, prefix, place, at) stand at
    nodes with more than ``bound`` names; ``names`` tells which of the two tables has the names.
    Returns shorts with ``whole`` (the key is all of it) and longs with ``whole`` (some short
    form ends there) and ``leaf`` (the node holds no more names than the bound). Each node is
    a key that is not opened further or at which a short form ends.
    """
    short_keys, long_keys = [], []
    while True:
        ahead = shorts.filter("length(s) > length(prefix)").withColumn(
            "more", F.expr(f"substring(s, length(prefix) + 1, {STEP})")
        )
        ways = ahead.select(*_NODE, "more").distinct()
        moved = longs.join(ways, _NODE).select(
            "league", "l", F.concat("prefix", "more").alias("prefix"), "place",
            F.expr(abbrev.walk("at", "more", "l")).alias("at"),
        ).filter("size(at) > 0")
        longs = staged(moved, "long-forms", within)
        shorts = staged(
            ahead.select("league", "s", F.concat("prefix", "more").alias("prefix"), "place"), "short-forms", within
        )
        counted = shorts if names == "shorts" else longs
        nodes = staged(
            counted.groupBy(*_NODE).agg(F.count("*").alias("n"))
            .join(shorts.filter("s = prefix").select(*_NODE).distinct().withColumn("w", F.lit(True)), _NODE, "left")
            .select(*_NODE, F.coalesce("w", F.lit(False)).alias("whole"), (F.col("n") <= bound).alias("leaf")),
            "nodes", within,
        )
        # Short forms at a node without long forms match nothing; semi joins leave them out.
        at_nodes = shorts.join(nodes.drop("whole"), _NODE).withColumn("whole", F.expr("s = prefix"))
        short_keys.append(at_nodes.filter("leaf or whole"))
        placed = longs.join(nodes, _NODE)
        long_keys.append(placed.filter("leaf or whole"))
        shorts = at_nodes.filter("not leaf and not whole").select(shorts.columns)
        longs = placed.filter("not leaf").select(longs.columns)
        if shorts.isEmpty() or longs.isEmpty():
            return reduce(DataFrame.unionByName, short_keys), reduce(DataFrame.unionByName, long_keys)


def adapted(
    index: DataFrame, probes: DataFrame, bound: int, within: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``index`` and ``probes`` with longer keys in place of those that hold too many names.

    Index rows are (league, kind, key, weight, total, value, place), probes (league, x, kind,
    key, weight, total); the weight is the set of letters of what is to be verified. Keys of the kinds ``head`` (the text abbreviates a name) and
    ``reverse`` (a name abbreviates the text) with a value to verify hold at most ``bound``
    names afterwards.
    """
    key = ["league", "kind", "key"]
    index, probes = staged(index, "index", within), staged(probes, "probes", within)
    verified = index.filter("kind in ('head', 'reverse') and value is not null")
    crowded = staged(verified.groupBy(*key).count().filter(F.col("count") > bound).select(key), "crowded", within)
    if crowded.isEmpty():
        return index, probes
    hot, asking = verified.join(crowded, key), probes.join(crowded, key)
    start = F.expr(abbrev.walk("array(1)", "substring(key, 2)", "l")).alias("at")
    none = F.lit(None).cast("bigint").alias("place")

    def rows(table: DataFrame, text: str, name: str, kind: str, place) -> DataFrame:
        return table.filter(F.col("kind") == kind).select("league", F.col(text).alias(name), F.col("key"), place)

    prefix = F.col("key").alias("prefix")
    forward = open_keys(
        rows(asking, "x", "s", "head", none).select("league", "s", prefix, "place"),
        rows(hot, "value", "l", "head", F.col("place")).select("league", "l", prefix, "place", start),
        "longs", bound, within,
    )
    reverse = open_keys(
        rows(hot, "value", "s", "reverse", F.col("place")).select("league", "s", prefix, "place"),
        rows(asking, "x", "l", "reverse", none).select("league", "l", prefix, "place", start),
        "shorts", bound, within,
    )

    def indexed(table: DataFrame, kind: str, value) -> DataFrame:
        return table.withColumn("value", value).select(
            "league", F.lit(kind).alias("kind"), F.col("prefix").alias("key"),
            F.coalesce(F.expr(letters("value")), F.lit(0)).alias("weight"), F.lit(0).alias("total"), "value", "place",
        )

    def probing(table: DataFrame, kind, text: str) -> DataFrame:
        return table.select(
            "league", F.col(text).alias("x"), kind.alias("kind"), F.col("prefix").alias("key"),
            F.expr(letters(text)).alias("weight"), F.lit(0).alias("total"),
        )

    no_value = F.lit(None).cast("string")
    first = forward[1].filter("whole").groupBy(*_NODE).agg(F.min("place").alias("place"))
    more_index = [
        indexed(forward[1].filter("leaf"), "head", F.col("l")), indexed(first, "short", no_value),
        indexed(reverse[0], "reverse", F.when(~F.col("whole"), F.col("s"))),
    ]
    more_probes = [
        probing(forward[0], F.when(F.col("whole"), "short").otherwise("head"), "s"),
        probing(reverse[1], F.lit("reverse"), "l"),
    ]
    opened = crowded.withColumn("opened", F.lit(True))
    kept_index = index.join(opened, key, "left").filter("opened is null or value is null").drop("opened")
    # Whole names may still stand at an opened key of the kind ``reverse``.
    kept_probes = probes.join(opened, key, "left").filter("opened is null or kind = 'reverse'").drop("opened")
    return (
        reduce(DataFrame.unionByName, more_index, kept_index.select(index.columns)),
        reduce(DataFrame.unionByName, more_probes, kept_probes.select(probes.columns)),
    )
