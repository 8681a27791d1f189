"""Nearest neighbours by cosine: stable projections, a kd-tree and a chi-square stopping test.

Vectors of length one are projected to a few dimensions by a Gaussian matrix. The squared
projected distance of two vectors is then their squared distance times a chi-square variable
with that many degrees of freedom. A search takes points by projected distance, verifies them
by the exact cosine and stops when the next projected distance is so large that a point nearer
than the worst kept one would have been met before with probability ``sure``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import staged


#: Allowance of the stopping test for rounding, in squared distance: vectors that point the same
#: way project alike but for rounding, and none of them may be left out.
ROUNDING = 1e-12


@dataclass(frozen=True)
class Settings:
    dimensions: int = 8  # of the projection; even
    sure: float = 0.96
    cell_rows: int = 8192  # distinct vectors of a cell, about; one task searches a cell
    leaf_rows: int = 256
    sample_rows: int = 50_000  # projected vectors, at most, that choose the cuts between cells
    query_rows: int = 50_000  # queries that a task holds, about; beyond, a cell has more tasks
    seed: int = 11

    def matrix(self, size: int) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((size, self.dimensions))

    def quantile(self) -> float:
        """What a chi-square variable stays below with probability ``sure``."""
        low, high = 0.0, 1000.0
        while high - low > 1e-9:
            x = (low + high) / 2
            term = total = 1.0
            for i in range(1, self.dimensions // 2):
                term *= x / 2 / i
                total += term
            low, high = (x, high) if 1 - exp(-x / 2) * total < self.sure else (low, x)
        return high


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.linalg.norm(vectors, axis=1)
    return vectors / norms[:, None], norms


def _split(points: np.ndarray, rows: int) -> list:
    """A kd-tree over ``points``: (dimension, cut, left, right), or the indices of a leaf."""

    def below(index: np.ndarray):
        if len(index) <= rows:
            return index
        axis = int(np.ptp(points[index], axis=0).argmax())
        half = len(index) // 2
        order = index[np.argpartition(points[index, axis], half)]
        return axis, float(points[order[half], axis]), below(order[:half]), below(order[half:])

    return below(np.arange(len(points)))


class Cells:
    """The top of the tree: cuts that give each point of the projected space a cell."""

    def __init__(self, sample: np.ndarray, count: int, dimensions: int):
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        tree = _split(sample, max(1, -(-len(sample) // count))) if len(sample) else np.zeros(0, np.int64)

        def number(node, low: np.ndarray, high: np.ndarray):
            if not isinstance(node, tuple):
                self.low.append(low)
                self.high.append(high)
                return len(self.low) - 1
            axis, cut, left, right = node
            up, down = high.copy(), low.copy()
            up[axis] = down[axis] = cut
            return axis, cut, number(left, low, up), number(right, down, high)

        self.tree = number(tree, np.full(dimensions, -inf), np.full(dimensions, inf))

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)

        def go(node, index: np.ndarray) -> None:
            if not isinstance(node, tuple):
                out[index] = node
            elif len(index):
                axis, cut, left, right = node
                under = points[index, axis] < cut
                go(left, index[under])
                go(right, index[~under])

        go(self.tree, np.arange(len(points)))
        return out

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """Least squared distance of each point to each cell's box."""
        out = np.empty((len(points), len(self.low)))
        for i, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            gap = np.maximum(np.maximum(low - points, points - high), 0)
            out[:, i] = (gap * gap).sum(axis=1)
        return out


class Tree:
    """The part of the index in one cell: leaves with their boxes, and the vectors."""

    def __init__(self, vectors: np.ndarray, settings: Settings):
        self.units = _unit(vectors)[0]
        self.flat = self.units @ settings.matrix(vectors.shape[1])
        self.quantile = settings.quantile()
        self.leaves: list[np.ndarray] = []

        def gather(node) -> None:
            if isinstance(node, tuple):
                gather(node[2])
                gather(node[3])
            else:
                self.leaves.append(node)

        gather(_split(self.flat, settings.leaf_rows))
        self.low = np.array([self.flat[leaf].min(axis=0) for leaf in self.leaves])
        self.high = np.array([self.flat[leaf].max(axis=0) for leaf in self.leaves])

    def search(self, unit: np.ndarray, flat: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Indices and cosines of the ``k`` best found; ``limit``: squared distance of a known k-th."""
        gap = np.maximum(np.maximum(self.low - flat, flat - self.high), 0)
        bounds = (gap * gap).sum(axis=1)
        places, cosines = np.zeros(0, np.int64), np.zeros(0)
        worst = limit
        for leaf in np.argsort(bounds):
            if bounds[leaf] > self.quantile * worst + ROUNDING:
                break
            rows = self.leaves[leaf]
            off = self.flat[rows] - flat
            rows = rows[(off * off).sum(axis=1) <= self.quantile * worst + ROUNDING]
            if not rows.size:
                continue
            places = np.concatenate((places, rows))
            cosines = np.concatenate((cosines, self.units[rows] @ unit))
            if len(places) > k:
                # All that tie with the k-th stay.
                least = np.partition(cosines, -k)[-k]
                kept = cosines >= least - 1e-12
                places, cosines = places[kept], cosines[kept]
                worst = min(worst, max(0.0, 2 - 2 * least))
        return places, cosines


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


_FOUND = "h1 bigint, h2 bigint, score double, ids array<bigint>"


def _search(points: DataFrame, queries: DataFrame, k: int, settings: Settings) -> DataFrame:
    """The best of each query in its cell; both tables are keyed by (cell, chunk)."""
    found = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def each(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not own.num_rows or not asked.num_rows:
            return found.empty_table()
        vectors = _matrix(own["vec"])
        tree = Tree(vectors, settings)
        norms = np.linalg.norm(vectors, axis=1)
        wanted = _matrix(asked["vec"])
        units = _unit(wanted)[0]
        flats = units @ settings.matrix(wanted.shape[1])
        ids = own["ids"].to_pylist()
        least = [min((i for i in x if i is not None), default=1 << 63) for x in ids]
        rows: list[tuple] = []
        keys = zip(asked["h1"].to_pylist(), asked["h2"].to_pylist(), asked["worst"].to_pylist(), strict=True)
        for i, (h1, h2, worst) in enumerate(keys):
            places, _ = tree.search(units[i], flats[i], k, inf if worst is None else worst)
            scores = (vectors[places] * wanted[i]).sum(axis=1) / (norms[places] * np.linalg.norm(wanted[i]))
            order = sorted(range(len(places)), key=lambda j: (-scores[j], least[places[j]]))[:k]
            rows += [(h1, h2, float(scores[j]), ids[places[j]]) for j in order]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, found, strict=True)], schema=found)

    return points.groupBy("cell", "chunk").cogroup(queries.groupBy("cell", "chunk")).applyInArrow(each, _FOUND)


def nearest(
    rows: DataFrame, queries: str, *, id_col: str = "vec_id", vector_col: str = "embedding",
    k: int = 5, settings: Settings = Settings(),
) -> DataFrame:
    """The ``k`` nearest rows found for each row that the SQL condition ``queries`` picks.

    Columns: query_id, rank from 1, the id, score: the cosine in double precision on the
    vectors as they are. Ties go to the smaller id; a query gets all candidates if there are
    fewer than ``k``. Candidates are all rows of another id. Vectors that are null, empty or
    zero, or hold null or non-finite parts, take no part, nor do those of another length
    than most have. A row repeated with id and vector counts once; a null id can be found
    (ties: last) but not ask. Ids must be BIGINT; other columns are left out; an empty table
    gives an empty result.

    Rows of equal vector are one point of the index with its ``k + 1`` smallest ids, since no
    answer can hold more of them; so a very common vector costs as much as any other. The
    cuts between cells are chosen on a bounded sample; every row is in the index. A query is
    searched in its own cell first, then in all cells that the stopping test cannot exclude.
    """
    asked = F.coalesce(F.expr(queries), F.lit(False))
    valid = rows.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), asked.alias("asks")
    ).where(
        """size(v) > 0 and exists(v, x -> x != 0)
        and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"""
    ).select("id", "asks", F.expr("transform(v, x -> cast(x as double) + 0D)").alias("vec"))
    sizes = valid.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = sizes.n if sizes else 1
    valid = valid.where(F.size("vec") == size).withColumns(
        {"h1": F.xxhash64("vec"), "h2": F.xxhash64("vec", F.lit(1))}
    )
    # The keys of a vector are two hashes of it, 128 bits in all.
    nearest_ids = Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("id"))
    points = staged(
        valid.select("h1", "h2", "vec", "id").distinct()
        .withColumn("r", F.row_number().over(nearest_ids)).where(F.col("r") <= k + 1)
        .groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("o"), "id"))).alias("ids"))
        .select("h1", "h2", "vec", F.col("ids.id").alias("ids")),
        "points",
    )
    asking = staged(valid.where("asks and id is not null").select("id", "h1", "h2", "vec").distinct(), "asking")
    wanted = asking.groupBy("h1", "h2").agg(F.first("vec").alias("vec"))
    count, askers = points.count(), wanted.count()
    chunks = max(1, -(-askers // settings.query_rows))
    matrix = settings.matrix(size)

    sample = points.select("vec").where(
        F.xxhash64("vec", F.lit(2)) / F.lit(2.0**64) + 0.5 < settings.sample_rows / max(1, count) * 0.9
    ).limit(settings.sample_rows)
    drawn = np.array([r.vec for r in sample.collect()], np.float64).reshape(-1, size)
    number = 1
    while number * settings.cell_rows < count:
        number *= 2
    cells = Cells(_unit(drawn)[0] @ matrix, number, settings.dimensions)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = _unit(_matrix(batch.column(2)))[0] @ matrix
                yield pa.RecordBatch.from_arrays([pa.array(cells.of(flat)), *batch.columns], names=["cell", *batch.schema.names])

    keyed = "cell int, h1 bigint, h2 bigint, vec array<double>"
    placed = points.mapInArrow(place, f"{keyed}, ids array<bigint>")
    placed = staged(placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))), "placed")
    chunk = F.expr(f"cast(pmod(h1, {chunks}) as int)").alias("chunk")
    home = staged(wanted.mapInArrow(place, keyed), "home")
    first = staged(
        _search(placed, home.select("*", chunk, F.lit(None).cast("double").alias("worst")), k + 1, settings), "found"
    )
    known = first.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(
        "h1", "h2", F.expr(f"if(n > {k}, greatest(2 - 2 * least, 0D), null)").alias("worst")
    )
    quantile = settings.quantile()

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            worst = np.array([inf if w is None else w for w in batch.column(4).to_pylist()])
            bounds = cells.bounds(_unit(_matrix(batch.column(3)))[0] @ matrix)
            bounds[np.arange(len(own)), own] = inf
            go, to = np.nonzero((bounds <= quantile * worst[:, None] + ROUNDING) & (bounds < inf))
            sent = batch.take(pa.array(go))
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *sent.columns[1:]], names=batch.schema.names)

    beyond = home.join(known, ["h1", "h2"], "left").select("cell", "h1", "h2", "vec", "worst").mapInArrow(others, f"{keyed}, worst double")
    second = _search(placed, beyond.select("*", chunk), k + 1, settings)
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    answers = (
        first.unionByName(second).select("h1", "h2", "score", F.explode("ids").alias("id"))
        .withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
        .groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("found"))
    )
    return asking.select(F.col("id").alias("query_id"), "h1", "h2").join(answers, ["h1", "h2"]).select(
        "query_id", F.posexplode(F.expr(f"slice(filter(found, x -> not x.id <=> query_id), 1, {k})")).alias("p", "x")
    ).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
