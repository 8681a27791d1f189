import random
from itertools import combinations

from pyspark.sql import functions as F

from touchline.llm.packing import candidate, optimal_ends, pack


def cost(lengths, counts, ends):
    return sum(c * min(e for e in ends if e >= n) for n, c in zip(lengths, counts, strict=True))


def test_ends_are_optimal():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(1, 10)
        lengths = sorted(rng.sample(range(40), n))
        counts = [rng.randrange(1, 30) for _ in lengths]
        for k in (1, 2, 3, 5, 12):
            ends = optimal_ends(lengths, counts, k)
            best = min(
                cost(lengths, counts, [*some, lengths[-1]])
                for r in range(min(k, n)) for some in combinations(lengths[:-1], r)
            )
            assert len(ends) <= k and ends == sorted(set(ends)) and cost(lengths, counts, ends) == best
    assert optimal_ends([], [], 4) == []


def test_candidates_cover_lengths_closely(spark):
    lengths = [0, 1, 1024, 1025, 1500, 4097, 65535, 65536, 65537, 10**7 + 1]
    got = spark.createDataFrame([(n,) for n in lengths], "n long").select("n", candidate(F.col("n")).alias("e")).collect()
    assert all(r.n <= r.e <= r.n * (1 + 1 / 256) for r in got)
    assert [r.e for r in got[:3]] == lengths[:3]


def test_batches(spark):
    rng = random.Random(2)
    rows = [(i, int(rng.lognormvariate(4, 1.2))) for i in range(3000)]
    rows += [(None, None), (None, 7), (1, 0), (1, 0), (9999, 50_000)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, n_tokens int, bucket int")
    got = pack(docs, buckets=6, batch_tokens=2048).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), n or 0) for i, n in rows)
    buckets = {}
    for r in got:
        assert r.n_tokens <= r.padded_length
        buckets.setdefault((r.bucket, r.padded_length), {}).setdefault(r.batch, []).append(r.slot)
    assert len({b for b, _ in buckets}) == len(buckets) <= 6
    for (_, padded), batches in buckets.items():
        room = max(1, 2048 // max(padded, 1))
        assert sorted(batches) == list(range(len(batches)))
        for batch, slots in batches.items():
            full = room if batch < len(batches) - 1 else len(slots)
            assert sorted(slots) == list(range(full)) and len(slots) <= room
    assert pack(docs.limit(0)).collect() == []


def test_ends_are_real_lengths_above_the_exact_ones(spark):
    lengths = [1025, 1026, 1500, 3000, 3001, 3001, 9000, 20, 20]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n_tokens long")
    for buckets in (1, 3, 9):
        rows = pack(docs, buckets=buckets).collect()
        for bucket in {r.bucket for r in rows}:
            own = [r for r in rows if r.bucket == bucket]
            assert {r.padded_length for r in own} == {max(r.n_tokens for r in own)}
    best = optimal_ends(sorted(set(lengths)), [lengths.count(n) for n in sorted(set(lengths))], 3)
    assert sorted({r.padded_length for r in pack(docs, buckets=3).collect()}) == best
