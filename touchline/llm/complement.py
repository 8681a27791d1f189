"""Best-fit packing by exact complements: token pieces into as few full sequences as can be.

All lengths are at most the capacity, so their histogram is bounded however many pieces there
are, and the plan is made on counts. From the longest length down, a gap is looked up among
the sums of one, two and three available lengths; combinations that fill it exactly are taken
as often as all their lengths last. What is left goes best-fit, longest first, into the
tightest gap that holds it. Long combinations can use up what fits best elsewhere, so plans
with combinations of up to three, two and one are made, and the shortest is kept. Pieces are then numbered within their length, and the number is
the place in the plan.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.batches import column_type, slices
from touchline.llm.token_files import WordIds
from touchline.session import staged

#: Pieces of one length that are numbered in one group, about.
GROUP_ROWS = 50_000

#: (length, times) in the order of a sequence, and how many sequences are alike.
Pattern = tuple[tuple[tuple[int, int], ...], int]


@lru_cache(maxsize=2)
def _words(path: str) -> WordIds:
    return WordIds(path)


class Supply:
    """Available lengths, indexed by the sums of one, two and three of them, up to ``most``."""

    def __init__(self, counts: dict[int, int], capacity: int, most: int = 3):
        self.capacity, self.most = capacity, most
        self.left = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.left[length] = count
        self.index()

    def index(self) -> None:
        """Sums as bits of an integer. Counts only fall, so an old index misses no sum."""
        present = np.flatnonzero(self.left).tolist()
        whole = (1 << self.capacity + 1) - 1
        self.one = sum(1 << a for a in present)
        self.two = self.three = 0
        for a in present if self.most > 1 else ():
            self.two |= self.one << a & whole
        for a in present if self.most > 2 else ():
            self.three |= self.two << a & whole

    def pairs(self, gap: int) -> np.ndarray:
        """The larger lengths of available pairs that sum to ``gap``, longest first."""
        larger = np.arange(gap - 1, (gap - 1) // 2, -1)
        return larger[(self.left[larger] > 0) & (self.left[gap - larger] > 0)]

    def complements(self, gap: int) -> Iterator[tuple[int, ...]]:
        """Combinations of up to ``most`` lengths with sum ``gap``, as available when asked for."""
        if self.one >> gap & 1:
            yield (gap,)
        if self.two >> gap & 1:
            for a in self.pairs(gap).tolist():
                yield a, gap - a
        if self.three >> gap & 1:
            for a in range(gap - 2, (gap - 1) // 3, -1):
                if self.left[a] and self.two >> gap - a & 1:
                    for b in self.pairs(gap - a).tolist():
                        if b <= a:
                            yield a, b, gap - a - b

    def take(self, lengths: tuple[int, ...]) -> int:
        """How often all of ``lengths`` could be taken together; they are gone then."""
        needs = Counter(lengths)
        times = min(int(self.left[x]) // n for x, n in needs.items())
        for x, n in needs.items():
            self.left[x] -= times * n
        return times


def exact(supply: Supply) -> list[Pattern]:
    """Sequences of a seed and a complement, full to the last token; ``supply`` loses them."""
    out: list[Pattern] = []
    for seed in range(supply.capacity, 0, -1):
        if not supply.left[seed]:
            continue
        if seed == supply.capacity:
            out.append((((seed, 1),), supply.take((seed,))))
            continue
        if (supply.most + 1) * seed < supply.capacity:
            break
        before = np.count_nonzero(supply.left)
        for rest in supply.complements(supply.capacity - seed):
            # A longer one was a seed before, and failed.
            if times := supply.take((seed, *rest)):
                runs = Counter((seed, *rest))
                out.append((tuple(sorted(runs.items(), reverse=True)), times))
            if not supply.left[seed]:
                break
        if np.count_nonzero(supply.left) < before - 1:
            supply.index()
    return out


def best_fit(supply: Supply) -> list[Pattern]:
    """Sequences of what is left, longest first, each into the tightest gap that holds it."""
    capacity = supply.capacity
    # By gap: sequences alike, as runs and their number.
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    held = np.zeros(capacity + 1, bool)

    def put(gap: int, runs: tuple[tuple[int, int], ...], count: int) -> None:
        open_[gap].append((runs, count))
        held[gap] = True

    for length in np.flatnonzero(supply.left)[::-1].tolist():
        count = int(supply.left[length])
        supply.left[length] = 0
        while count:
            fits = int(held[length:].argmax()) + length
            if not held[fits]:
                runs, alike, fits = (), -(-count // (capacity // length)), capacity
            else:
                runs, alike = open_[fits].pop()
                held[fits] = bool(open_[fits])
            each = fits // length
            full = min(alike, count // each)
            if full:
                put(fits - each * length, (*runs, (length, each)), full)
                count -= full * each
                alike -= full
            if alike and 0 < count < each:
                put(fits - count * length, (*runs, (length, count)), 1)
                count, alike = 0, alike - 1
            if alike and runs:
                put(fits, runs, alike)
    return [x for entries in open_.values() for x in entries]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold ``counts[length]`` pieces of each length, none over ``capacity``."""
    plans = []
    for most in (3, 2, 1):
        supply = Supply(counts, capacity, most)
        plans.append(exact(supply) + best_fit(supply))
    return min(plans, key=lambda patterns: sum(alike for _, alike in patterns))


def slots(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of a plan go: for each length, runs of its numbers in ascending order.

    ``key`` is length and first number of the run; numbers from there on fill ``times`` places
    in each of the sequences from ``sequence`` on, the first at ``offset``. The number of runs
    is bounded by the capacity alone: a combination is taken until one of its lengths is spent,
    and a residual length opens, fills or splits a bounded number of groups of sequences.
    """
    number = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for runs, alike in patterns:
        offset = 0
        for length, times in runs:
            rows.append((length, int(number[length]), times, sequence, offset))
            number[length] += times * alike
            offset += length * times
        sequence += alike
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "number", "times", "sequence", "offset"), table.T, strict=True))


def cut(
    docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """The token pieces of ``docs``: id, ``piece`` from 0, ``start``, ``length``, ``ids_crc32``.

    ``tokenizer`` is a ``.json`` file of the tokenizers library that drops white space. A
    document is its ids and ``end_id``; only longer ones than ``capacity`` are cut, into
    pieces of that length and a last one. ``start`` counts its ids before the piece. With
    ``keep_ids`` the ids come too, as little-endian unsigned 32-bit numbers in ``ids``. A null
    text counts as empty and has the end id alone; null and repeated ids pass through, each
    row by itself; other columns are left out; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {column_type(rows, 'id')}, piece int, start bigint, length bigint, ids_crc32 bigint"
    names = ["id", "piece", "start", "length", "ids_crc32"]
    if keep_ids:
        schema, names = schema + ", ids binary", [*names, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        for batch in slices(batches, 512):
            owner, out = [], []
            for i, ids in enumerate(words.encode(pc.fill_null(batch.column(1), "").to_pylist())):
                ids = np.append(np.frombuffer(ids, words.dtype), end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity].tobytes()
                    owner.append(i)
                    out.append((piece, start, len(part) // 4, crc32(part), part))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns[: len(names) - 1]], names)

    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def place(pieces: DataFrame, *, capacity: int = 4096, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless from 0, at most ``capacity`` in a sequence.

    Lengths must be from 1 to ``capacity``, or it raises. All columns stay; the two new names
    must be free, or it raises. Pieces alike may swap places. An empty table gives an empty
    result. At most ``capacity`` counts reach the driver, and the plan that goes back is
    bounded by the capacity (``slots``). Pieces of one length are numbered in groups of about
    ``GROUP_ROWS`` rows, so a very common length is spread over many tasks.
    """
    if taken := {"sequence_id", "offset"} & set(pieces.columns):
        raise ValueError(f"columns {sorted(taken)} exist")
    names = [f"c{i}" for i in range(len(pieces.columns))]
    length = names[pieces.columns.index(length_col)]
    spark = pieces.sparkSession
    # Rows alike are told apart by the task that wrote them, so that none of their groups is hot.
    rows = staged(pieces.toDF(*names).withColumn("salt", F.spark_partition_id()), "pieces")
    histogram = {r[0]: r[1] for r in rows.groupBy(length).count().limit(capacity + 1).collect()}
    if any(x is None or not 0 < x <= capacity for x in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    table = slots(plan(histogram, capacity), capacity)
    groups = spark.createDataFrame(
        [(x, -(-count // GROUP_ROWS)) for x, count in histogram.items()], f"{length} bigint, groups bigint"
    )
    keyed = rows.join(F.broadcast(groups), length).withColumn("g", F.expr("pmod(xxhash64(salt, *), groups)".replace("*", ", ".join(names))))
    sizes = keyed.groupBy(length, "g").agg(F.count("*").alias("size"))
    base = sizes.selectExpr(length, "g", f"sum(size) over (partition by {length} order by g) - size as base")
    within = Window.partitionBy(length, "g").orderBy(*[c for c in names if c != length], "salt")
    numbered = keyed.withColumn("row", F.row_number().over(within)).join(base, [length, "g"]).select(
        *names, (F.col("base") + F.col("row") - 1).alias("number")
    )
    at = names.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Length and number in one key; a corpus has fewer than 2 ** 50 pieces.
        keys = table["length"] << 50 | table["number"]
        for batch in batches:
            own = batch.column(at).cast(pa.int64()).to_numpy()
            number = batch.column(len(names)).to_numpy()
            slot = np.searchsorted(keys, own << 50 | number, side="right") - 1
            past, times = number - table["number"][slot], table["times"][slot]
            sequence = table["sequence"][slot] + past // times
            offset = table["offset"][slot] + past % times * own
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, pieces.dtypes, strict=True))
    placed = numbered.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")
    return placed.toDF(*pieces.columns, "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pieces placed with their ``ids``: each sequence as one binary."""
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    ).select("sequence_id", "length", F.expr("aggregate(parts.ids, x'', (a, b) -> concat(a, b))").alias("ids"))


def pack_documents(
    docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """The pieces of ``cut`` with their places of ``place``."""
    pieces = cut(docs, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, keep_ids=keep_ids)
    return place(pieces, capacity=capacity)
