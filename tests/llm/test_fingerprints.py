import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from touchline.llm import ordering
from touchline.llm.fingerprints import BINS, compare_with_next, densified, edited, fingerprints, likeness, sketches


def shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, min(1, len(words))))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_bins_hold_least_hash_or_a_donors():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 300, 5000):
        h = rng.integers(0, 2**64, n, dtype=np.uint64)
        got = densified(h)
        mine = {}
        for x in sorted(h.tolist(), reverse=True):
            mine[x >> 55] = x & 15
        assert all(got[b] == v for b, v in mine.items())
        assert set(got.tolist()) <= set(mine.values()) and len(got) == BINS


def test_likeness_estimates_jaccard():
    rng = random.Random(2)
    errors = []
    for _ in range(60):
        size = rng.randrange(30, 1500)
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        other = words[: rng.randrange(size)] + [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(size))]
        a, b = " ".join(words), " ".join(other)
        errors.append(likeness(*sketches([a, b])) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.035 and max(map(abs, errors)) < 0.12
    assert likeness(*sketches(["A b\nc", "a  b c"])) == 1.0
    assert likeness(*sketches(["", " \n"])) == 1.0 and likeness(*sketches(["", "a"])) == 0.0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        out[i] = (len(text or ""), hashlib.sha256(edited(text or "", after or "").encode()).hexdigest())
    return out


def test_next_documents_over_ranges(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(7 * i - 100, "".join(rng.choices("ab é\U0001f600", k=rng.randrange(40)))) for i in range(150)]
    rows += [(None, "the null id"), (5001, None), (5002, ""), (5003, "x y " * 20_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_chars int").repartition(5)
    want = brute(rows)
    for most in (10, 4000):
        monkeypatch.setattr(ordering.range_cuts, "__defaults__", (most,))
        got = compare_with_next(docs).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
        prints = {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()}
        assert {r.doc_id: r.fingerprint for r in got} == prints


def test_few_and_repeated_rows(spark):
    one = spark.createDataFrame([(4, "abcd")], "doc_id long, text string")
    row = compare_with_next(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0
    same = compare_with_next(one.union(one).union(one)).collect()
    assert len(same) == 3 and {r.edited_sha256 for r in same} == {row.edited_sha256}
    assert compare_with_next(one.limit(0)).collect() == []


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    errors = []
    for r in compare_with_next(docs).collect():
        t, u = texts[r.doc_id], texts[after[r.doc_id]]
        errors += [r.near_edited - jaccard(t, edited(t, u)), r.near_next - jaccard(t, u)]
    assert len(errors) == 2 * len(texts) and np.std(errors) < 0.03 and abs(np.mean(errors)) < 0.01
