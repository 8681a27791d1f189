"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import staged


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of those."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(
        F.explode(F.expr("array(struct(a, m as b), struct(b as a, m as b))")).alias("l")
    )
    return moved.select("l.*").where("a > b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (two columns ``a``, ``b`` of one orderable type).

    The root is the smallest node of the component. Rounds of large and small stars halve
    what is left to do; each round is a table in the shared folder, so lineage stays short
    and lost executors cost one round at most. No task holds a component: minima combine on
    the map side, and joins with a hot node have one row on the other side, so adaptive
    execution can split them. Links with a null end or both ends alike are left out; an
    empty table gives an empty result.
    """
    down = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = staged(down.distinct(), "links")
    seen = None
    while True:
        count, sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if count == 0 or (count, sign) == seen:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        seen = (count, sign)
        large = staged(_large_star(now).distinct(), "links")
        now = staged(_small_star(large).distinct(), "links")
