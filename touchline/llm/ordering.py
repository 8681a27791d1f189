"""Cutting a table into ranges of its id, so that no task holds the global order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a range, about, while there are fewer ranges than the most.
RANGE_ROWS = 4_000
MOST_RANGES = 4_096


def range_cuts(df: DataFrame, column: str, rows: int = RANGE_ROWS) -> list[int]:
    """Ascending cuts of the BIGINT ``column`` into ranges of about equal numbers of rows.

    Range r holds the values from cut r - 1 up to below cut r; nulls go with range 0. Only
    the column is read. At most ``MOST_RANGES`` numbers reach the driver; beyond that ranges
    hold more rows, which tasks read as a sorted stream. Equal values share a range.
    """
    count = df.where(F.col(column).isNotNull()).count()
    parts = min(MOST_RANGES, -(-count // rows))
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    return sorted(set(df.agg(F.percentile_approx(column, shares, 20 * parts)).first()[0]))


def ranges_of(values: pa.Array, cuts: list[int]) -> pa.Array:
    """The range of each value."""
    found = np.searchsorted(np.array(cuts, np.int64), pc.fill_null(values, 0).to_numpy(), side="right")
    return pa.array(np.where(pc.is_null(values).to_numpy(zero_copy_only=False), 0, found), pa.int32())
