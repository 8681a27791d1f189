import random

import pytest
from pyspark.sql import functions as F

from touchline.llm import mixing
from touchline.llm.mixing import calibrated, draw, mix, topic, words

DIMS = ("source", "lang", "topic")


def raked(cells, targets, sweeps=400):
    w = {c: float(t) for c, t in cells.items()}
    for _ in range(sweeps):
        for d, goal in enumerate(targets):
            sums = {}
            for c, x in w.items():
                sums[c[d]] = sums.get(c[d], 0) + x
            w = {c: x * goal[c[d]] / sums[c[d]] if sums[c[d]] else 0 for c, x in w.items()}
    return w


def brute(rows, powers, keep):
    cells = {}
    for *c, n in rows:
        cells[tuple(c)] = cells.get(tuple(c), 0) + (n or 0)
    total = sum(cells.values())
    targets = []
    for d, power in enumerate(powers):
        sums = {}
        for c, t in cells.items():
            sums[c[d]] = sums.get(c[d], 0) + t
        goal = {v: s**power if s else 0 for v, s in sums.items()} if not isinstance(power, dict) else {v: power.get(v, 0) for v in sums}
        targets.append({v: total * g / sum(goal.values()) for v, g in goal.items()})
    w = raked(cells, targets)
    factor = {c: w[c] / t if t else 1.0 for c, t in cells.items()}
    low, high = 0.0, 1e9
    for _ in range(200):
        rate = (low + high) / 2
        low, high = (rate, high) if sum(min(1, rate * factor[c]) * t for c, t in cells.items()) < keep * total else (low, rate)
    return {c: (factor[c], min(1.0, low * factor[c]) if t else 1.0) for c, t in cells.items()}


def table(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        s = rng.choice(["hot"] * 6 + ["a", "b", None, ""])
        lang = rng.choice(["en"] * 3 + ["de", "fr"]) if s != "b" else "de"
        rows.append((s, lang, rng.choice("xyz"), rng.choice([1, 5, 40, 300])))
    rows.append((None, None, "x", None))
    df = spark.createDataFrame([(i, *r, "t") for i, r in enumerate(rows)], "doc_id long, source string, lang string, topic string, n int, tokens string")
    return rows, df


@pytest.mark.parametrize(("keep", "few"), [(0.3, 50_000), (0.9, 0)])
def test_probabilities_equal_brute_force(spark, monkeypatch, keep, few):
    monkeypatch.setattr(mixing, "FEW_CELLS", few)
    rows, df = table(spark, 1)
    given = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 1.0), ("none", 9.0)], "value string, weight double")
    powers = (0.5, 0.7, {"x": 1.0, "y": 2.0, "z": 1.0})
    got = calibrated(
        df, {d: F.col(d) for d in DIMS}, {"source": 0.5, "lang": 0.7, "topic": given}, tokens=F.col("n"), keep=keep
    )
    assert got.columns == [*df.columns, "_tokens", "_weight", "_probability"]
    want = brute(rows, powers, keep)
    for r in got.collect():
        factor, p = want[r.source, r.lang, r.topic]
        assert r._weight == pytest.approx(factor, abs=1e-6) and r._probability == pytest.approx(p, abs=1e-6)
    assert got.count() == len(rows)


def test_mix_draws_and_plan_is_native(spark):
    rows, df = table(spark, 2)
    docs = df.withColumn("text", F.repeat(F.lit("word "), F.coalesce("n", F.lit(0)))).withColumn("_tokens", F.lit(1))
    drawn = mix(docs, {d: F.col(d) for d in DIMS}, dict.fromkeys(DIMS, 0.5), keep=0.5)
    assert drawn.columns == docs.columns
    ids = [r.doc_id for r in drawn.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    share = sum(rows[i][3] or 0 for i in ids) / sum(r[3] or 0 for r in rows)
    assert 0.4 < share < 0.6
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    dims = {d: F.col(d) for d in DIMS}
    assert mix(docs.limit(0), dims, dict.fromkeys(DIMS, 0.5)).collect() == []
    assert mix(docs.withColumn("text", F.lit(None).cast("string")), dims, dict.fromkeys(DIMS, 0.5)).count() == len(rows)


def test_helpers(spark):
    df = spark.createDataFrame([(1, " a\x0bb\xa0c  d"), (None, None), (None, "x | y"), (3, "License @"), (4, "")], "i long, t string")
    got = df.select(words(F.col("t")), topic(F.col("t")), draw(F.col("i"), F.col("t"))).collect()
    assert [r[0] for r in got] == [3, 0, 3, 2, 0]
    assert [r[1] for r in got] == ["prose", "prose", "table", "license", "prose"]
    assert all(0 <= r[2] < 1 for r in got)


def test_says_when_marginals_cannot_be_met_and_refuses_taken_names(spark):
    rows = [(1, "a", "x", 10), (2, "b", "y", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, s string, l string, n long")
    targets = {
        "s": spark.createDataFrame([("a", 1.0), ("b", 3.0)], "value string, weight double"),
        "l": spark.createDataFrame([("x", 3.0), ("y", 1.0)], "value string, weight double"),
    }
    dims = {"s": F.col("s"), "l": F.col("l")}
    with pytest.warns(UserWarning, match="marginals disagree"):
        calibrated(docs, dims, targets, tokens=F.col("n")).collect()
    with pytest.raises(ValueError):
        calibrated(docs.withColumn("_x", F.lit(1)), dims, targets, tokens=F.col("n"))
