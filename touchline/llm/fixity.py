"""Fixity audit of WARC replicas by Merkle trees over records and ordered offset ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import staged

#: Bytes of an offset range, and children of a node above the ranges.
RANGE_BYTES = 1 << 16
FAN_OUT = 16


def warc_record(url: Column, body: Column, date: str = "2000-01-01T00:00:00Z") -> Column:
    """A WARC resource record as text; null parts count as empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    name = F.md5(F.concat(url, F.lit("\n"), body))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:md5:"), name,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def with_offsets(records: DataFrame, *order: str) -> DataFrame:
    """``records`` (archive, length, ..) with the ``offset`` at which each starts in its archive.

    Records of one archive are laid out by ``order``, nulls first; an archive is a file of
    bounded size, so its lengths meet in one task. Null lengths count as 0.
    """
    before = Window.partitionBy("archive").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint"))


def _ranges(records: DataFrame, range_bytes: int) -> DataFrame:
    """(archive, node, digest) of each offset range that holds records, in order of offset."""
    # Repeated records are counted first, so that a range has a bounded number of lines.
    lines = records.groupBy("archive", "offset", "length", "digest").count()
    return lines.groupBy("archive", F.expr(f"offset div {range_bytes}").alias("node")).agg(
        F.sha2(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("offset", "length", "digest", "count"))),
                    lambda r: F.concat_ws(
                        " ", r["offset"].cast("string"), F.coalesce(r["length"].cast("string"), F.lit("-")),
                        F.coalesce(r["digest"], F.lit("-")), r["count"].cast("string"),
                    ),
                ),
                "\n",
            ),
            256,
        ).alias("digest")
    )


def _above(nodes: DataFrame, fan_out: int) -> DataFrame:
    """The next level: a node is the digest of its children's numbers and digests in order."""
    return nodes.groupBy("archive", F.expr(f"node div {fan_out}").alias("node")).agg(
        F.sha2(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("node", "digest"))),
                    lambda c: F.concat_ws(" ", c["node"].cast("string"), c["digest"]),
                ),
                "\n",
            ),
            256,
        ).alias("digest")
    )


def merkle_levels(
    records: DataFrame, depth: int, *, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT
) -> list[DataFrame]:
    """Node tables (archive, node, digest) from the ranges up to the level of number ``depth``."""
    levels = [staged(_ranges(records, range_bytes), "ranges")]
    for _ in range(depth):
        levels.append(_above(levels[-1], fan_out))
    return levels


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digest differs, or which one side lacks."""
    other = b.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("digest").alias("b_digest"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    return a.join(other, same, "full_outer").where("not digest <=> b_digest").select(
        *[F.coalesce(k, f"b_{k}").alias(k) for k in keys]
    )


def _numbered(rows: DataFrame, side: str, *keys: str) -> DataFrame:
    """``rows`` with the ``nth`` of each among those equal in ``keys``; names take ``side``."""
    among = Window.partitionBy("archive", *keys).orderBy("offset", "length", "digest", "count")
    rows = rows.withColumn("nth", F.row_number().over(among))
    return rows.select(*[F.col(c).alias(c + side) for c in rows.columns])


def _met(*keys: str) -> Column:
    """The condition that rows of the sides ``_a`` and ``_b`` have the same archive and keys, none null."""
    same = F.col("archive_a").eqNullSafe(F.col("archive_b"))
    for k in keys:
        same = same & (F.col(f"{k}_a") == F.col(f"{k}_b"))
    return same


def audit(
    a: DataFrame, b: DataFrame, *, record_col: str | None = None,
    range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT,
) -> DataFrame:
    """Where two replicas differ: one row per differing record.

    Both tables have archive, offset (BIGINT), length and digest of each record, and perhaps
    ``record_col`` with its id as a string. Columns of the result: archive, offset, problem
    (``altered``: other length or digest, ``missing`` from b, ``extra`` in b), offset_b,
    length_a, length_b, digest_a, digest_b; offset is that of a, for extra records that of b.

    Records are hashed into offset ranges, those into a tree; roots are compared first, and only
    branches that differ are followed down to their records. What is not equal there is matched
    by length and digest first, as records behind a damaged one have moved whole and are sound,
    then by id, then, unless both have one, by offset. Equal records of one archive are matched
    in order of offset; where an offset repeats, each differing record of one side is shown
    beside each of the other. An archive is a file of bounded size. Null archives, lengths and
    digests are values like any other, but a null digest does not move; a null offset counts as
    -1, a null id as none. Other columns are left out; two empty tables give an empty result.
    """
    sides = [
        staged(
            t.select(
                "archive", F.coalesce(F.col("offset"), F.lit(-1)).cast("bigint").alias("offset"),
                F.col("length").cast("bigint").alias("length"), "digest",
                (F.col(record_col) if record_col else F.lit(None)).cast("string").alias("record"),
            ),
            "records",
        )
        for t in (a, b)
    ]
    last = max(t.agg(F.max("offset")).first()[0] or 0 for t in sides) // range_bytes
    depth = 0
    while last:
        depth, last = depth + 1, last // fan_out
    trees = [merkle_levels(t, depth, range_bytes=range_bytes, fan_out=fan_out) for t in sides]
    keys = ["archive", "node"]
    bad = staged(_differing(trees[0][depth], trees[1][depth], keys), "branches")
    for level in range(depth - 1, -1, -1):
        parents = bad.select(F.col("archive").alias("p_archive"), F.col("node").alias("p_node"))
        inside = F.col("archive").eqNullSafe(F.col("p_archive")) & (F.expr(f"node div {fan_out}") == F.col("p_node"))
        children = [tree[level].join(parents, inside, "left_semi") for tree in trees]
        bad = staged(_differing(*children, keys), "branches")
    ranges = bad.select(F.col("archive").alias("p_archive"), F.col("node").alias("p_node"))
    inside = F.col("archive").eqNullSafe(F.col("p_archive")) & (F.expr(f"offset div {range_bytes}") == F.col("p_node"))
    held = ["archive", "offset", "length", "digest"]
    left, right = (
        staged(
            t.join(ranges, inside, "left_semi").groupBy(held)
            .agg(F.count("*").alias("count"), F.min("record").alias("record")),
            "suspects",
        )
        for t in sides
    )
    # What both sides hold equally often is sound, where it was or moved.
    rest_a, rest_b = _unequal(left, right, [*held, "count"]), _unequal(right, left, [*held, "count"])
    moved_a, moved_b = (
        _numbered(rest, side, "length", "digest", "count") for rest, side in ((rest_a, "_a"), (rest_b, "_b"))
    )
    moved = _met("length", "digest", "count", "nth")
    lost = moved_a.join(moved_b, moved, "left_anti")
    new = moved_b.join(moved_a, moved, "left_anti")
    lost, new = (
        _numbered(t.select(*[F.col(c + side).alias(c) for c in left.columns]), side, "record")
        for t, side in ((lost, "_a"), (new, "_b"))
    )
    known = staged(lost.join(new, _met("record", "nth"), "full_outer"), "by-id")
    both = F.col("count_a").isNotNull() & F.col("count_b").isNotNull()
    lost = known.where("count_b is null").select(lost.columns)
    new = known.where("count_a is null").select(new.columns)
    at = _met("offset") & (F.col("record_a").isNull() | F.col("record_b").isNull())
    found = known.where(both).unionByName(lost.join(new, at, "full_outer"))
    return found.select(
        F.when(F.col("count_a").isNull(), F.col("archive_b")).otherwise(F.col("archive_a")).alias("archive"),
        F.coalesce("offset_a", "offset_b").alias("offset"),
        F.expr("if(count_b is null, 'missing', if(count_a is null, 'extra', 'altered'))").alias("problem"),
        "offset_b", "length_a", "length_b", "digest_a", "digest_b",
    )


def _unequal(rows: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without an equal one in ``other``, nulls being equal."""
    other = other.select(*[F.col(c).alias(f"o_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    return rows.join(other, same, "left_anti")
