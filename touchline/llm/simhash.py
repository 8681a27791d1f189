"""SimHash near-duplicates: pigeonhole blocks, exact Hamming verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.batches import slices
from touchline.llm.components import components
from touchline.llm.hashing import groups_of_bytes, shingle_spans, spaced, xxh64
from touchline.session import staged

#: Fingerprints of one block value that one task compares; more are dealt to pairs of tiles.
TILE = 4096
_SEED = 42
#: Eight bits as eight bytes of 0 or 1, so that up to 255 bytes add up in one number.
_SPREAD = np.unpackbits(
    np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"
).view("<u8").ravel()


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes the bits that over half of them have; none: 0."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not some.size:
        return out
    runs = counts[some]
    parts = -(-runs // 255)
    first = np.repeat(np.cumsum(runs) - runs, parts)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    spread = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(spread, first + 255 * within, axis=0).view(np.uint8)
    set_bits = np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    bits = 2 * set_bits > runs[:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def simhash(texts: list[str], words: int) -> np.ndarray:
    """Unsigned fingerprints; the rule is in ``add_fingerprints``."""
    joined = [spaced(text) for text in texts]
    out = np.zeros(len(texts), np.uint64)
    for i, j in groups_of_bytes(joined):
        text, start, size, counts = shingle_spans(joined[i:j], words)
        out[i:j] = _majority(xxh64(text, start, size, _SEED), counts)
    return out


def add_fingerprints(
    docs: DataFrame, *, text_col: str = "text", out: str = "fingerprint", words: int = 4
) -> DataFrame:
    """``docs`` with a BIGINT column: the SimHash of the text's word shingles.

    A-Z are lower-cased, words are cut at the ASCII white space, shingles of ``words`` words
    (repeats count; a shorter text is one shingle) are hashed with XXH64, seed 42. A bit is 1
    if over half of the hashes have it. Null and empty texts get 0. ``out`` must be a new name.
    """
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pc.fill_null(batch.column(place), "").to_pylist()
            prints = pa.array(simhash(texts, words).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, prints], names=[*batch.schema.names, out]
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(out, T.LongType())]))


def block_masks(count: int, distance: int) -> list[int]:
    """Bit masks of which two fingerprints within ``distance`` agree on at least one.

    The 64 bits are cut into k blocks. At most ``distance`` blocks differ, so some k -
    distance blocks agree entirely; each mask is one such choice. k is the smallest that
    leaves a few chance meetings per fingerprint at ``count`` fingerprints.
    """
    k = distance + 1
    while k < 16 and 2 ** (64 * (k - distance) / k + 2) < count:
        k += 1
    edges = [64 * i // k for i in range(k + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [reduce(or_, chosen) for chosen in combinations(blocks, k - distance)]
    assert len(masks) == comb(k, distance)
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning_links(prints: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that span each component of distinct ``prints``, found by breadth-first search.

    Every fingerprint is compared with all that no component has yet, so no link that joins
    two components is missed, and none within a component is written twice.
    """
    left = prints
    while left.size > 1:
        front, left = left[:1], left[1:]
        while front.size and left.size:
            block, front = front[:64], front[64:]
            near = np.bitwise_count(block[:, None] ^ left[None, :]) <= distance
            found = np.flatnonzero(near.any(axis=0))
            if found.size:
                yield from zip(
                    block[near[:, found].argmax(axis=0)].tolist(), left[found].tolist(), strict=True
                )
                front = np.concatenate((front, left[found]))
                left = np.delete(left, found)


def _compare(distance: int):
    """Links within each run of equal keys; input is sorted by key, then fingerprint."""

    def links(prints: np.ndarray) -> list[tuple[int, int]]:
        return list(spanning_links(prints, distance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            *keys, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            prints = prints.view(np.uint64)
            if not len(prints):
                continue
            change = np.zeros(len(prints), bool)
            for key in keys:
                change[1:] |= key[1:] != key[:-1]
            starts = np.concatenate(([0], np.flatnonzero(change), [len(prints)]))
            found: list[tuple[int, int]] = []
            if held_key == tuple(key[0] for key in keys):
                held = np.concatenate((held, prints[: starts[1]]))
                starts = starts[1:]
            if len(starts) > 1:
                found += links(held)
                sizes = np.diff(starts)
                for r in np.flatnonzero(sizes[:-1] > 1).tolist():
                    found += links(prints[starts[r] : starts[r + 1]])
                held_key = tuple(key[-1] for key in keys)
                held = prints[starts[-2] :].copy()
            if found:
                pairs = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"]
                )
        if found := links(held):
            pairs = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"]
            )

    return run


def near_links(prints: DataFrame, distance: int, *, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct values of the one BIGINT column ``p`` of ``prints``.

    They join exactly what all pairs within ``distance`` differing bits would join. Values
    meet on blocks of bits (``block_masks``). Where over ``tile`` values share a block, they
    are dealt to tiles by hash and each pair of tiles is compared by a task of its own, so
    a crowded block is neither dropped nor held by one task.
    """
    masks = block_masks(prints.count(), distance)
    choices = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(m).alias("m")) for i, m in enumerate(masks)])
    keyed = prints.select("p", F.explode(choices).alias("k")).select(
        F.col("k.c").alias("c"), F.expr("p & k.m").alias("v"), "p"
    )
    crowded = staged(keyed.groupBy("c", "v").count().where(F.col("count") > tile), "crowded")
    if crowded.isEmpty():
        dealt = keyed.select("c", "v", F.lit(0).alias("t"), F.lit(0).alias("u"), "p")
    else:
        # A pair of tiles holds about ``tile`` values.
        tiles = keyed.join(crowded, ["c", "v"], "left").withColumn(
            "n", F.expr(f"coalesce(ceil(2 * count / {tile}), 1)")
        ).withColumn("own", F.expr("pmod(xxhash64(p), n)"))
        dealt = tiles.select(
            "c", "v", F.explode(F.expr("sequence(0, n - 1)")).alias("other"), "own", "p"
        ).select(
            "c", "v", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), "p"
        )
    keys = ["c", "v", "t", "u"]
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(tasks, *keys).sortWithinPartitions(*keys, "p")
    return sorted_.mapInArrow(_compare(distance), "a bigint, b bigint").distinct()


def _rooted(rows: DataFrame, distance: int, tile: int) -> DataFrame:
    """(p, first, root) per distinct fingerprint of ``rows`` (id, p): smallest id, component."""
    prints = staged(rows.groupBy("p").agg(F.min("id").alias("first")), "distinct")
    roots = components(near_links(prints.select("p"), distance, tile=tile))
    return staged(
        prints.join(roots, prints.p == roots.node, "left").select(
            "p", "first", F.coalesce("root", "p").alias("root")
        ),
        "rooted",
    )


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
    distance: int = 4, tile: int = TILE,
) -> DataFrame:
    """Per row of ``docs``: id, BIGINT fingerprint, component_id.

    Rows whose fingerprints differ in at most ``distance`` bits are linked; component_id is
    the smallest id that links reach, the row's own included. Rows of equal fingerprint are
    one node, so large groups of copies cost one comparison. Null and empty texts share the
    fingerprint 0 and are linked like any other; null ids pass through and never become a
    component_id unless a whole component has none. Repeated rows stay. Other columns are
    left out. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = add_fingerprints(texts, words=words)
    rows = staged(prints.select("id", F.col("fingerprint").alias("p")), "prints")
    rooted = _rooted(rows, distance, tile)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("p", "component_id")
    return rows.join(classes, "p").select(
        F.col("id").alias(id_col), F.col("p").alias("fingerprint"), "component_id"
    )


def keep_first(marked: DataFrame, rooted: DataFrame, id_col: str) -> DataFrame:
    """One row of ``marked`` (with ``p``) of each root of ``rooted`` (p, first, root): that of the smallest id."""
    kept = rooted.groupBy("root").agg(
        F.min(F.struct(F.col("first").isNull(), "first", "p")).alias("k")
    ).select(F.col("k.first").alias("first"), F.col("k.p").alias("kept_p"))
    same = (F.col("p") == F.col("kept_p")) & F.col(id_col).eqNullSafe(F.col("first"))
    once = Window.partitionBy("p", id_col).orderBy(F.lit(1))
    return marked.join(kept, same, "left_semi").withColumn("row", F.row_number().over(once)).where("row = 1")


def drop_near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
    distance: int = 4, tile: int = TILE,
) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (nulls last).

    Among rows of one component and equal smallest id, the one of the smallest fingerprint
    stays, and among rows alike in both, any one. All columns of ``docs`` stay as they are.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_name, text_name = (names[docs.columns.index(c)] for c in (id_col, text_col))
    # Written once, since the fingerprints are needed for the links and again for the rows.
    marked = staged(add_fingerprints(docs.toDF(*names), text_col=text_name, out="p", words=words), "marked")
    rooted = _rooted(marked.select(F.col(id_name).alias("id"), "p"), distance, tile)
    return keep_first(marked, rooted, id_name).select(*names).toDF(*docs.columns)
