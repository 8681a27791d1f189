"""Merkle dataset manifest with a witness for every row, grown by streaming aligned append.

Rows of a tree (such as a language) are its leaves in order. Aligned blocks of leaves are
streamed through an appender: open subtrees carry the partial witnesses of their leaves, and
each sibling that completes extends them. The roots of all blocks are then appended likewise,
until a tree has one node, its subroot; subroots are appended to give the root. A row's
witness is its own, then its block's, and so on up.

A witness is binary: per level one byte for the place in the run, one for the size of the run,
and the digests (32 bytes each) of the other nodes of the run from left to right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.session import staged

#: Children of a node, and levels of a block: a task appends this many leaves at a time.
FAN = 8
BLOCK_LEVELS = 3
BLOCK = FAN**BLOCK_LEVELS


def leaf_digest(*columns: Column) -> Column:
    """Hex SHA-256 of a row: ``-`` for a null, else bytes of the value as text, colon, the value."""
    fields = [
        F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
        for c in columns
    ]
    return F.sha2(F.concat(*fields), 256)


def node_digest(children: bytes) -> bytes:
    """Digest of a node from those of its children, which enter as hex text."""
    return hashlib.sha256(children.hex().encode()).digest()


class OpenNode:
    """A complete subtree whose run is still open: its leaves, and its siblings so far."""

    def __init__(self, digest: bytes, first: int, end: int):
        self.digest, self.first, self.end = digest, first, end
        self.left, self.right = b"", bytearray()


class Appender:
    """Leaves of one aligned block, appended one by one; each gets a witness up to the block's root."""

    def __init__(self, levels: int):
        self.levels = levels
        self.open: list[list[OpenNode]] = [[] for _ in range(levels + 1)]
        self.witnesses: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        at = len(self.witnesses)
        self.witnesses.append(bytearray())
        self._complete(0, OpenNode(digest, at, at + 1))

    def _complete(self, level: int, node: OpenNode) -> None:
        run = self.open[level]
        node.left = b"".join(sibling.digest for sibling in run)
        for sibling in run:
            sibling.right += node.digest
        run.append(node)
        if level < self.levels and len(run) == FAN:
            self._close(level)

    def _close(self, level: int) -> None:
        """The run has all its nodes: their witnesses get this level, and the parent is complete."""
        run, self.open[level] = self.open[level], []
        for place, node in enumerate(run):
            step = bytes((place, len(run))) + node.left + node.right
            for leaf in range(node.first, node.end):
                self.witnesses[leaf] += step
        whole = node_digest(b"".join(node.digest for node in run))
        self._complete(level + 1, OpenNode(whole, run[0].first, run[-1].end))

    def finish(self) -> bytes:
        """Close what is open, and return the block's root."""
        for level in range(self.levels):
            if self.open[level]:
                self._close(level)
        return self.open[self.levels][0].digest


def levels_of(nodes: int) -> int:
    """Levels of a block that appends up to ``nodes`` nodes of its tree."""
    levels = 0
    while levels < BLOCK_LEVELS and FAN**levels < nodes:
        levels += 1
    return levels


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (tree, ..) with ``rank`` by ``order`` within the tree from 0, and its size ``n``.

    Rows are dealt to ranges of (tree, order) and numbered as a stream in each; what precedes
    a range in its tree comes from a table of counts. No task holds a tree.
    """
    schema = T.StructType([
        *leaves.schema, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()),
    ])
    tree_at = leaves.columns.index("tree")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column(tree_at).dictionary_encode()
            codes, names = runs.indices.to_numpy(), runs.dictionary.to_pylist()
            starts = np.concatenate(([0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]))
            at = np.arange(len(codes), dtype=np.int64)
            for i, j in pairwise(starts.tolist()):
                tree = names[codes[i]]
                before = count if tree == last else 0
                at[i:j] += before - i
                last, count = tree, before + j - i
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(codes), part, np.int32)), pa.array(at)], schema.names
            )

    sorted_ = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    numbered = staged(sorted_.mapInArrow(number, schema), "numbered")
    # One row per tree and range that holds some of it.
    sizes = staged(numbered.groupBy("tree", "part").agg(F.count("*").alias("c")), "sizes")
    before = sizes.selectExpr(
        "tree", "part", "sum(c) over (partition by tree order by part) - c as base", "sum(c) over (partition by tree) as n"
    )
    return numbered.join(before, ["tree", "part"]).withColumn("rank", F.col("base") + F.col("at")).drop("part", "at", "base")


def _append(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, n, rank, digest, ..) with ``block``, ``witness`` up to the block's root, and ``block_root``.

    ``block_root`` stands in the last row of a block only.
    """
    keyed = nodes.withColumn("block", F.expr(f"rank div {BLOCK}"))
    names = keyed.columns
    rank, n, digest = (names.index(c) for c in ("rank", "n", "digest"))
    schema = T.StructType([
        *keyed.schema, T.StructField("witness", T.BinaryType()), T.StructField("block_root", T.BinaryType()),
    ])

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        appender = Appender(levels_of(whole.column(n)[0].as_py()))
        for leaf in whole.column(digest).to_pylist():
            appender.append(leaf)
        root = appender.finish()
        roots = [None] * (whole.num_rows - 1) + [root]
        witnesses = pa.array(map(bytes, appender.witnesses), pa.binary())
        return pa.RecordBatch.from_arrays([*whole.columns, witnesses, pa.array(roots, pa.binary())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # A task has whole blocks in order, so a block starts where its first rank is.
            first = batch.column(rank).to_numpy() % BLOCK == 0
            bounds = sorted({0, batch.num_rows, *np.flatnonzero(first).tolist()})
            for i, j in pairwise(bounds):
                if first[i] and held:
                    yield block(held)
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield block(held)

    return keyed.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank").mapInArrow(run, schema)


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Append until each tree has one node: the tables of all passes, and (tree, digest) of the subroots."""
    passes, now = [], nodes
    while True:
        done = staged(_append(now), "witnesses")
        passes.append(done)
        now = done.where("block_root is not null").select(
            "tree", F.expr(f"ceil(n / {BLOCK})").alias("n"), F.col("block").alias("rank"), F.col("block_root").alias("digest")
        )
        if (now.agg(F.max("n")).first()[0] or 0) <= 1:
            return passes, now.select("tree", "digest")


def _witnessed(passes: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first pass with witnesses up to where those of ``tops`` (tree, witness, ..) end.

    A block takes its upper witness to its leaves; the upper tables are smaller by the block
    size each, and a block never holds more rows than that, so no key of the join is hot.
    """
    above = tops.withColumn("block", F.lit(0).cast("bigint")).withColumnRenamed("witness", "upper")
    extra = [c for c in tops.columns if c not in ("tree", "witness")]
    for done in reversed(passes):
        joined = done.drop("block_root").join(above, ["tree", "block"]).withColumn("witness", F.concat("witness", "upper"))
        above = joined.select("tree", F.col("rank").alias("block"), F.col("witness").alias("upper"), *extra)
    return joined.drop("block", "upper", "n", "rank")


def manifest(
    docs: DataFrame, fields: list[str], *, tree_col: str = "lang", id_col: str = "doc_id",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row of ``docs``: id, ``leaf``, ``subroot``, ``root`` (hex) and ``witness`` (binary).

    A leaf is the digest of ``fields``. Leaves of one value of ``tree_col`` (null is a value of
    its own) ascend by id, nulls first, equal ids by leaf; eight nodes in a row, fewer at the
    end, become their digest while there is more than one. Subroots, ordered by tree value in
    bytes, nulls first, give the root likewise. Rows alike are leaves of their own and may
    swap witnesses. ``carry`` adds columns of names that are free. No other column is in the
    result, whatever its name. An empty table gives an empty result. Texts are digested where
    they are read and never move; one row, the root, reaches the driver.
    """
    names = {f"c{i}": c for i, c in enumerate((carry or {}).values())}
    leaves = staged(
        docs.select(
            F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("")).alias("tree"),
            F.col(id_col).alias("id"), F.unhex(leaf_digest(*map(F.col, fields))).alias("digest"),
            # Deals rows alike to several ranges.
            F.spark_partition_id().alias("salt"), *[c.alias(n) for n, c in names.items()],
        ),
        "leaves",
    )
    passes, subroots = grow(ranked(leaves, ["id", "digest", "salt"]).drop("salt"))
    forest = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    tops, root = grow(forest)
    found = root.first()
    upper = _witnessed(tops, root.select("tree", F.lit(b"").alias("witness"))).select(
        F.col("name").alias("tree"), "witness", F.lower(F.hex("digest")).alias("subroot")
    )
    return _witnessed(passes, staged(upper, "forest")).select(
        F.col("id").alias(id_col), F.lower(F.hex("digest")).alias("leaf"), "subroot",
        F.lit(found.digest.hex() if found else None).cast("string").alias("root"), "witness",
        *[F.col(n).alias(name) for n, name in zip(names, carry or {}, strict=True)],
    )


def folded(leaf: bytes, witness: bytes) -> tuple[bytes, bytes]:
    """The root that ``leaf`` leads to beside the siblings of ``witness``, and all those siblings."""
    at, siblings = 0, []
    while at < len(witness):
        place, size = witness[at : at + 2]
        others = witness[at + 2 : at + 2 + 32 * (size - 1)]
        leaf = node_digest(others[: 32 * place] + leaf + others[32 * place :])
        siblings.append(others)
        at += 2 + len(others)
    return leaf, b"".join(siblings)


def verify(rows: DataFrame, leaf_col: str = "leaf") -> DataFrame:
    """``rows`` of a manifest with ``proof_sha256``, ``folded_root`` and ``verified``, without ``witness``.

    ``folded_root`` is recomputed from the hex digest in ``leaf_col`` and the witness alone;
    ``verified`` tells whether it is the root. ``proof_sha256`` is the digest of all siblings.
    A null in ``leaf_col`` gives null and false.
    """
    leaf, witness, root = (rows.columns.index(c) for c in (leaf_col, "witness", "root"))
    kept = [i for i in range(len(rows.columns)) if i != witness]
    schema = T.StructType([
        *[rows.schema[i] for i in kept], T.StructField("proof_sha256", T.StringType()),
        T.StructField("folded_root", T.StringType()), T.StructField("verified", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, roots = [], []
            for own, path in zip(batch.column(leaf).to_pylist(), batch.column(witness).to_pylist(), strict=True):
                top, siblings = folded(bytes.fromhex(own or ""), path)
                proofs.append(hashlib.sha256(siblings.hex().encode()).hexdigest())
                roots.append(None if own is None else top.hex())
            same = [a is not None and a == b for a, b in zip(roots, batch.column(root).to_pylist(), strict=True)]
            out = [batch.column(i) for i in kept] + [pa.array(proofs, pa.string()), pa.array(roots, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return rows.mapInArrow(run, schema)
