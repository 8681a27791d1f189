"""Last header value carried forward over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(
    df: DataFrame,
    partition: list[str],
    order: list[str],
    is_header: Column,
    value: Column,
    block: Column,
    name: str = "carried",
) -> DataFrame:
    """Add the value of the last header at or before each row; null before the first.

    A header whose value is null clears what was carried. ``block`` is any expression
    that never decreases along ``order`` within a group, such as the row position
    divided by a million or the day of a timestamp. It cuts a large group into parts that
    are scanned by separate tasks: each part's last header is found by aggregation, and
    only those few rows are carried from part to part.
    """
    held = F.when(is_header, F.struct(value.alias("value")))
    rows = df.withColumn("_block", block).withColumn("_held", held)
    within = Window.partitionBy(*partition, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    across = Window.partitionBy(*partition).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    last = f"max_by(_held, struct({', '.join(order)})) filter (where _held is not null) as _last"
    blocks = (
        rows.groupBy(*partition, "_block")
        .agg(F.expr(last))
        .withColumn("_before", F.last("_last", ignorenulls=True).over(across))
        .select(*partition, "_block", "_before")
    )
    local = rows.withColumn("_local", F.last("_held", ignorenulls=True).over(within))
    carried = F.coalesce("_local", "_before")["value"].alias(name)
    # Null keys and blocks are groups like any other.
    same = F.lit(True)
    for i, key in enumerate([*partition, "_block"]):
        blocks = blocks.withColumnRenamed(key, f"_key{i}")
        same = same & F.col(key).eqNullSafe(F.col(f"_key{i}"))
    return local.join(blocks, same).select(*df.columns, carried)
