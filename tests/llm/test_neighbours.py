import math
import random

import numpy as np

from touchline.llm.neighbours import Settings, nearest
from touchline.llm.queries import op10_neighbours


def brute(rows, asks, k=5):
    good = [(i, np.array(v, np.float64)) for i, v in rows
            if v is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    out = {}
    for q, v in good:
        if q is not None and asks(q):
            scored = [(-float(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), i is None, i or 0) for i, w in good if i != q]
            out[q] = [(s, None if n else i) for s, n, i in sorted(scored)[:k]]
    return out


def check(got, want, recall):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert found.keys() == {q for q, w in want.items() if w}
    hits = total = 0
    for q, rs in found.items():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, len(want[q]) + 1))
        assert all(a.score > b.score - 1e-12 for a, b in zip(rs, rs[1:], strict=False))
        hits += len({r.vec_id for r in rs} & {i for _, i in want[q]})
        total += len(rs)
    assert hits / total >= recall
    return hits / total


def test_recall_on_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 50 == 0)
    check(op10_neighbours(spark, "/root/testdata/sf0.1").collect(), want, 0.93)
    many = nearest(
        spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id % 50 = 0",
        settings=Settings(cell_rows=100, query_rows=9),
    )
    check(many.collect(), want, 0.9)


def test_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(0, 400)]
    common = [1.0, 2.0, 3.0]
    rows += [(1000 + i, common) for i in range(120)] + [(1000, common), (None, [2.0, 4.0, 6.5])]
    rows += [(500, None), (510, []), (520, [0.0, 0.0, 0.0]), (530, [1.0, None, 2.0]), (540, [float("nan"), 1.0, 1.0]),
             (550, [float("inf"), 1.0, 1.0]), (560, [1.0, 2.0]), (570, [-0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i != 560]
    want = brute(as_float, lambda i: i % 10 == 0)
    got = nearest(df, "vec_id % 10 = 0", settings=Settings(cell_rows=64, leaf_rows=8)).collect()
    check(got, want, 0.95)
    hot = {r.rank: r.vec_id for r in got if r.query_id == 1000}
    assert hot == {1: 1001, 2: 1002, 3: 1003, 4: 1004, 5: 1005}
    assert {r.rank: r.vec_id for r in got if r.query_id == 1100}[1] == 1000


def test_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.0, 3.0]), (8, [2.0, 0.0])], schema)
    assert [tuple(r) for r in nearest(df, "vec_id = 0").orderBy("rank").collect()] == [(0, 1, 8, 1.0), (0, 2, 7, 0.0)]
    assert nearest(df.limit(1), "vec_id = 0").collect() == []
    assert nearest(df.limit(0), "vec_id = 0").collect() == []
    assert nearest(df, "vec_id is null").collect() == []


def test_multiples_of_one_vector_tie_by_id(spark):
    rng = np.random.default_rng(6)
    one = rng.standard_normal(24)
    vectors = np.concatenate((one * rng.uniform(0.1, 9, (3000, 1)), rng.standard_normal((200, 24))))
    ids = rng.permutation(len(vectors))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(frame, "vec_id % 50 = 0", settings=Settings(cell_rows=500, leaf_rows=64)).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.vec_id)
    norms = np.linalg.norm(vectors, axis=1)
    asked = [i for i in range(3000) if ids[i] % 50 == 0]
    for i in asked:
        scores = (vectors * vectors[i]).sum(axis=1) / (norms * np.linalg.norm(vectors[i]))
        order = np.lexsort((ids, -scores))
        assert found[int(ids[i])] == [int(ids[j]) for j in order if j != i][:5]
    assert len(asked) > 40
