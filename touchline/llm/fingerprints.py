"""Document fingerprints by one-permutation MinHash with optimal densification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.batches import column_type, map_arrow, slices
from touchline.llm.hashing import groups_of_bytes, shingle_spans, spaced, xxh64
from touchline.llm.ordering import range_cuts, ranges_of

#: Bins of the one permutation; a power of two. The standard error is about 0.023 at most.
BINS = 512
#: Low bits that are kept of each bin's least hash.
BITS = 4
WORDS = 5
_SEED = 8
_ATTEMPTS = 64


@lru_cache(maxsize=256)
def _donors(bins: int, block: int) -> np.ndarray:
    """For each of 64 attempts and each bin the bin it tries; the same for all documents."""
    tries = np.arange(block * _ATTEMPTS, (block + 1) * _ATTEMPTS, dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        x = (np.arange(bins, dtype=np.uint64)[None, :] << np.uint64(32)) + tries
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(bins)).astype(np.int64)


def densified(hashes: np.ndarray, bins: int = BINS, bits: int = BITS) -> np.ndarray | None:
    """Low bits of each bin's least hash; None for no hash.

    The top bits of a hash choose its bin. An empty bin tries other bins in an order that
    depends on the bin and the attempt alone, and takes the first one that is not empty.
    """
    if not len(hashes):
        return None
    ordered = np.sort(hashes)
    width = np.uint64(64 - (bins.bit_length() - 1))
    first = np.searchsorted(ordered, np.arange(bins, dtype=np.uint64) << width)
    full = np.diff(np.append(first, len(ordered))) > 0
    low = (ordered[np.minimum(first, len(ordered) - 1)] & np.uint64((1 << bits) - 1)).astype(np.uint8)
    if full.sum() == 1:
        return np.full(bins, low[full][0])
    out, empty, block = low.copy(), np.flatnonzero(~full), 0
    while empty.size:
        tried = _donors(bins, block)[:, empty]
        hit = full[tried]
        found = hit.any(axis=0)
        donor = tried[hit.argmax(axis=0), np.arange(empty.size)]
        out[empty[found]] = low[donor[found]]
        empty, block = empty[~found], block + 1
    return out


def sketches(texts: list[str]) -> list[np.ndarray | None]:
    joined = [spaced(text) for text in texts]
    out: list[np.ndarray | None] = []
    for i, j in groups_of_bytes(joined):
        text, start, size, counts = shingle_spans(joined[i:j], WORDS)
        hashes = xxh64(text, start, size, _SEED)
        ends = np.cumsum(counts)
        out += [densified(hashes[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
    return out


def as_hex(sketch: np.ndarray | None) -> str:
    """Two bins a byte, as hex digits; the sketch of no words is the empty string."""
    if sketch is None:
        return ""
    return (sketch[0::2] | sketch[1::2] << 4).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard likeness of the shingle sets.

    Bins that differ agree by chance in their low bits once in 2 ** BITS; the estimate is
    corrected for that and kept within 0 and 1. Two sketches of no words are alike.
    """
    if a is None or b is None:
        return float(a is b)
    chance = 0.5**BITS
    return min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id and ``fingerprint``, the hex sketch of its five-word shingles.

    A-Z are lower-cased and words cut at the ASCII white space. A text of fewer words is one
    shingle; null, empty and blank texts have the empty fingerprint. Equal texts have equal
    fingerprints. Ids pass through; other columns are left out; no shuffle.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = sketches(pc.fill_null(batch.column(1), "").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(as_hex, found))], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_arrow(rows, each, f"id {column_type(rows, 'id')}, fingerprint string", rows=256)
    return out.withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the characters replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = pa.schema(
    [("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside an edited form of itself and the next document.

    The order is by descending BIGINT id, nulls last, equal ids by a hash of the text; after
    the last comes the first, so a lone document follows itself. Null texts count as empty.
    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. Other columns are left out; an empty table gives an empty result.

    Ranges of ids are sorted each in a task and read as a stream. The first row of a range
    is sent a second time, to the end of the range that comes before it in the order.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("h", F.xxhash64("text"))
    cuts = range_cuts(rows, "id")

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ranges_of(batch.column(0), cuts), *batch.columns], names=["part", "id", "h"])

    # One row for each range reaches the driver.
    heads = (
        map_arrow(rows.select("id", "h"), place, "part int, id bigint, h bigint")
        .groupBy("part").agg(F.max(F.struct("id", "h")).alias("top")).orderBy("part").collect()
    )
    parts = [r.part for r in heads]
    sent_to = {
        (r.top.id, r.top.h): target for r, target in zip(heads, [*parts[1:], *parts[:1]], strict=True)
    }

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        part = ranges_of(batch.column(0), cuts)
        keys = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
        again = {i: sent_to[key] for i, key in enumerate(keys) if key in sent_to}
        order = pa.array([*range(batch.num_rows), *again], pa.int64())
        out = batch.take(order)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*part.to_pylist(), *again.values()], pa.int32()),
                pa.array([False] * batch.num_rows + [True] * len(again)),
                *out.columns,
            ],
            names=["part", "again", "id", "text", "h"],
        )

    dealt = (
        map_arrow(rows, deal, "part int, again boolean, id bigint, text string, h bigint", rows=512)
        .repartitionById(len(cuts) + 1, "part")
        .sortWithinPartitions("part", "again", F.desc_nulls_last("id"), F.desc("h"))
        .select("again", "id", "text")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches, 128):
            again, ids, texts = (c.to_pylist() for c in batch.columns)
            now = list(zip(again, ids, texts, sketches(texts), strict=True))
            held = now if last is None else [last, *now]
            # Behind the rows sent again nothing of the range follows.
            pairs = [(a, b) for a, b in zip(held, held[1:], strict=False) if not a[0]]
            last = held[-1]
            changed = [edited(a[2], b[2]) for a, b in pairs]
            out = [
                (
                    a[1], len(a[2]), hashlib.sha256(c.encode()).hexdigest(), as_hex(a[3]), as_hex(e),
                    likeness(a[3], e), likeness(a[3], b[3]),
                )
                for (a, b), c, e in zip(pairs, changed, sketches(changed), strict=True)
            ]
            columns = zip(*out, strict=True) if out else [[]] * len(_OUT)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT
            )

    schema = (
        "id bigint, n_chars bigint, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double"
    )
    return dealt.mapInArrow(compare, schema).withColumnRenamed("id", id_col)
