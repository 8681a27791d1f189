"""Token keys by rarity, for names that agree on three or more tokens.

Where one or two shared tokens prove a hit, their key does so by itself. What is left shares at
least three, so each side may leave its two most common tokens out: the rarest shared one has
two more shared ones after it on both sides, and is kept on both. A token that nearly every name
of a league has is then a key of few names only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import staged

#: Shared tokens up to which a key proves a hit without comparing the names.
PROVEN = 2


def rarest(
    index: DataFrame, probes: DataFrame, within: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``index`` and ``probes`` without the two most common tokens of each text.

    Index rows are (league, kind, key, weight, total, value, place), probes (league, x, kind,
    key, weight, total); only rows of the kind ``rare`` change. Tokens are ordered by the number
    of names of the league that have them, ties by the token. Tokens of a text that no name
    has match nothing and are left out.
    """
    index, probes = staged(index, "index", within), staged(probes, "probes", within)
    rare = F.col("kind") == "rare"
    counts = index.filter(rare).groupBy("league", "key").agg(F.count("*").alias("names"))

    def kept(rows: DataFrame, text: str, *more) -> DataFrame:
        ranked = rows.filter(rare).join(counts, ["league", "key"]).groupBy("league", text)
        return ranked.agg(
            F.array_sort(F.collect_set(F.struct("names", "key"))).alias("ranked"), *more
        ).filter(F.size("ranked") > PROVEN).withColumn(
            "key", F.explode(F.expr(f"slice(ranked, 1, size(ranked) - {PROVEN})").getField("key"))
        ).withColumns({"kind": F.lit("rare"), "weight": F.lit(0), "total": F.lit(0)})

    return (
        index.filter(~rare).unionByName(
            kept(index, "value", F.min("place").alias("place")).select(index.columns)
        ),
        probes.filter(~rare).unionByName(kept(probes, "x").select(probes.columns)),
    )
