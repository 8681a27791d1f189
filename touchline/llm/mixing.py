"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import staged

#: Sweeps over all marginals in one job, and jobs at most.
SWEEPS = 6
MOST_JOBS = 15
TOLERANCE = 1e-10
#: Cells, as counted, whose sweeps run in one task; more are exchanged for each marginal.
FEW_CELLS = 50_000


def words(text: Column) -> Column:
    """Tokens of a text: runs of characters other than the ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _value(dimension: Column) -> Column:
    """A null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), dimension.cast("string")), F.lit(""))


def _targets(cells: DataFrame, names: list[str], targets: dict[str, DataFrame | float]) -> DataFrame:
    """``cells`` with the wanted token sum of each of its values, in each dimension."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for name in names:
        sums = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("s"))
        wanted = targets[name]
        if isinstance(wanted, DataFrame):
            given = wanted.select(_value(F.col("value")).alias(name), F.col("weight").cast("double").alias("g"))
            sums = sums.join(given.groupBy(name).agg(F.sum("g").alias("g")), name, "left").select(
                name, "s", F.when(F.col("s") > 0, F.coalesce("g", F.lit(0.0))).otherwise(0.0).alias("g")
            )
        else:
            sums = sums.select(name, "s", F.when(F.col("s") > 0, F.pow("s", F.lit(float(wanted)))).otherwise(0.0).alias("g"))
        sums = staged(sums, "marginal")
        weight = sums.agg(F.sum("g")).first()[0] or 0.0
        if weight <= 0:
            sums, weight = sums.withColumn("g", F.col("s")), max(float(total), 1.0)
        cells = cells.join(sums.select(name, (F.col("g") / weight * total).alias(f"{name}_target")), name)
    return cells


def rake(cells: DataFrame, names: list[str]) -> DataFrame:
    """``cells`` (names, tokens, name_target ..) with ``weight``: raked token weights.

    From weight = tokens, weights are scaled in turn so that each value of each dimension
    sums to its target, until all marginals agree. If the jobs run out first (targets that no
    weights can meet), a warning tells how far the last factors were from 1. Windows run over cells, which are sums, never over documents; where
    there are few, by count, one task sweeps them all, with the same result.
    """
    few = cells.count() <= FEW_CELLS
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(MOST_JOBS):
        if few:
            # One partition serves the windows of all dimensions without an exchange.
            now = now.coalesce(1)
        for _ in range(SWEEPS):
            now = now.withColumn("off", F.lit(0.0))
            for name in names:
                sum_ = F.sum("weight").over(Window.partitionBy(name))
                ratio = F.when(sum_ > 0, F.col(f"{name}_target") / sum_).otherwise(1.0)
                now = now.withColumn("ratio", ratio).withColumns({
                    "weight": F.col("weight") * F.col("ratio"),
                    # A value without weights cannot be brought to its target.
                    "off": F.greatest("off", F.abs(F.col("ratio") - 1)),
                })
        now = staged(now, "cells")
        off = now.agg(F.max("off")).first()[0] or 0.0
        if off <= TOLERANCE:
            return now
    warnings.warn(f"marginals disagree with their targets by up to {off:.3g}", stacklevel=2)
    return now


def _rate(cells: DataFrame, budget: float) -> float:
    """The rate at which sum(least(1, rate * factor) * tokens) over cells is ``budget``.

    Cells whose probability reaches 1 are set aside and the rest is scaled again; each round
    sets more aside, and one row per round reaches the driver.
    """
    rate = 0.0
    while True:
        full = F.col("factor") * rate >= 1
        r = cells.agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("factor") * F.col("tokens"))).alias("open"),
        ).first()
        if not r.open or r.full >= budget:
            return max(rate, 0.0) if r.full is not None else 0.0
        new = (budget - r.full) / r.open
        if new <= rate * (1 + 1e-14):
            return new
        rate = new


def unused_prefix(df: DataFrame) -> str:
    """Underscores that no column name starts with."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def calibrated(
    docs: DataFrame, dimensions: dict[str, Column], targets: dict[str, DataFrame | float], *,
    tokens: Column, keep: float = 0.5, prefix: str = "_",
) -> DataFrame:
    """``docs`` with ``_tokens``, ``_weight`` and ``_probability``, in DataFrame operations only.

    ``dimensions`` name the marginals, such as source, language and topic. A target is a
    table (value, weight), or an exponent: shares are then proportional to the token sum to
    that power (1: as it is, 0: all alike). Weights of values that no document has are
    ignored; a value without weight is given none. ``_weight`` is what a token of the
    document's cell counts for after raking, ``_probability`` = least(1, rate * _weight) with
    the rate at which the expected tokens are ``keep`` of all. Null values are a value of
    their own; null token counts are 0; a cell without tokens has weight and probability 1.
    An empty table gives an empty result. No column of ``docs`` may start with ``prefix``.
    """
    if taken := [c for c in docs.columns if c.startswith(prefix)]:
        raise ValueError(f"columns {taken} start with {prefix}")
    names = [f"{prefix}d{i}" for i in range(len(dimensions))]
    wanted = dict(zip(names, (targets[d] for d in dimensions), strict=True))
    count, weight, probability = (prefix + n for n in ("tokens", "weight", "probability"))
    marked = docs.withColumns(
        {n: _value(d) for n, d in zip(names, dimensions.values(), strict=True)}
        | {count: F.coalesce(tokens, F.lit(0)).cast("bigint")}
    )
    cells = staged(marked.groupBy(*names).agg(F.sum(count).alias("tokens")), "cells")
    factor = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)
    aimed = staged(_targets(cells, names, wanted), "aimed")
    raked = staged(
        rake(aimed, names).select(*names, "tokens", factor.alias("factor")), "raked"
    )
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    rate = _rate(raked, keep * total)
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("factor") * rate)).otherwise(1.0)
    factors = raked.select(*names, F.col("factor").alias(weight), chance.alias(probability))
    return marked.join(factors, names).drop(*names)


def draw(id_: Column, text: Column) -> Column:
    """A number in [0, 1) from the digest of the id, or of the text where the id is null."""
    key = F.md5(F.coalesce(id_.cast("string"), text, F.lit("")))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / float(16**13)


def mix(
    docs: DataFrame, dimensions: dict[str, Column], targets: dict[str, DataFrame | float], *,
    id_col: str = "doc_id", text_col: str = "text", keep: float = 0.5,
) -> DataFrame:
    """The documents that are drawn, with the columns of ``docs``.

    Each is kept with its calibrated probability, decided by its id alone, so a rerun draws
    the same ones and rows of one id and cell stay or go together. See ``calibrated``.
    """
    prefix = unused_prefix(docs)
    rows = calibrated(
        docs, dimensions, targets, tokens=words(F.col(text_col)), keep=keep, prefix=prefix
    )
    drawn = rows.where(draw(F.col(id_col), F.col(text_col)) < F.col(prefix + "probability"))
    return drawn.select(*docs.columns)


def topic(text: Column) -> Column:
    """A coarse topic by marks in the text: license, contact, table or prose; null: prose."""
    return (
        F.when(text.contains("icense"), "license").when(text.contains("@"), "contact")
        .when(text.contains(" | "), "table").otherwise("prose")
    )
