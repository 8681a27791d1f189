"""Application log lines as columns; works on batch and streaming text alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The levels in the order they are looked for, and the component names.
LEVELS = ("debug", "info", "warning", "error")
MODULES = ("bbc_pool", "fishy_pool", "matcher_pool", "scheduler", "python_worker")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines already in the log."""
    return spark.read.text(path)


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files as they arrive."""
    return spark.readStream.text(path)


def is_head(line: Column) -> Column:
    """Whether a line begins a record: it starts with a year of this century and has three words."""
    return line.startswith("20") & (F.size(F.split(line, " ", 3)) == 3)


def parse_log_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Add time, level, pids, modules, message and is_continuation of a line.

    A line that does not start with a year of this century, or has fewer than three
    words, continues the one above and gets nothing but the flag and its text.
    """
    line = F.col(column)
    head_line = is_head(line)
    head = r"^(20[^ ]*(?: \d[^ ]*)?) (.*)$"
    rest = F.regexp_extract(line, f"(?s){head}", 2)
    level = F.coalesce(
        *[F.when(F.contains(F.lower(rest), F.lit(f"[{name}]")), name) for name in LEVELS]
    )
    modules = F.filter(
        F.array(*[F.when(F.contains(rest, F.lit(name)), name) for name in MODULES]),
        lambda name: name.isNotNull(),
    )
    fields = {
        "time": F.regexp_extract(line, f"(?s){head}", 1),
        "level": level,
        "pids": F.regexp_extract_all(rest, F.lit(r"<\d+\.\d+\.\d+>"), F.lit(0)),
        "modules": modules,
    }
    message = F.regexp_replace(rest, r"(?s)^\[\w+\] ", "")
    return df.select(
        "*",
        *[F.when(head_line, value).alias(name) for name, value in fields.items()],
        F.when(head_line, message).otherwise(line).alias("message"),
        (~head_line).alias("is_continuation"),
    )
