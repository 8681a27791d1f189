from collections import Counter, defaultdict
from itertools import combinations_with_replacement
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from touchline.llm.complement import (
    Supply, best_fit, cut, exact, pack_documents, place, plan, sequences,
)
from touchline.llm.queries import QUERIES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def held(patterns, capacity):
    counts = Counter()
    for runs, alike in patterns:
        assert alike > 0 and sum(n * t for n, t in runs) <= capacity
        for n, t in runs:
            counts[n] += t * alike
    return counts


def total(patterns):
    return sum(alike for _, alike in patterns)


def test_plan_holds_every_piece_once():
    rng = np.random.default_rng(1)
    for _ in range(300):
        capacity = int(rng.integers(1, 60))
        counts = Counter(rng.integers(1, capacity + 1, int(rng.integers(0, 90))).tolist())
        assert held(plan(counts, capacity), capacity) == counts


def test_index_finds_every_exact_complement():
    rng = np.random.default_rng(2)
    for _ in range(60):
        counts = Counter(rng.integers(1, 25, 14).tolist())
        supply = Supply(counts, 40)
        for gap in range(1, 40):
            found = {tuple(sorted(c)) for c in supply.complements(gap) if not Counter(c) - counts}
            want = {c for n in (1, 2, 3) for c in combinations_with_replacement(sorted(counts), n)
                    if sum(c) == gap and not Counter(c) - counts}
            assert found == want


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_exact_combinations_leave_no_gap(parts):
    # Every length occurs in one combination only, so all sequences must be found full.
    capacity, counts = 10_000, Counter()
    for i in range(4):
        rest = [1 << i + 4 * j for j in range(parts - 1)]
        for length in (*rest, capacity - sum(rest)):
            counts[length] += 70
    supply = Supply(counts, capacity)
    full = exact(supply)
    assert total(full) == 280 and not supply.left.any()
    assert all(sum(n * t for n, t in runs) == capacity for runs, _ in full)


def test_best_fit_equals_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(100):
        capacity = int(rng.integers(10, 80))
        lengths = rng.integers(1, capacity + 1, 120).tolist()
        gaps = []
        for length in sorted(lengths, reverse=True):
            fits = min((g for g in gaps if g >= length), default=None)
            if fits is None:
                gaps.append(capacity - length)
            else:
                gaps[gaps.index(fits)] -= length
        assert total(best_fit(Supply(Counter(lengths), capacity))) == len(gaps)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(4)
    lengths = np.clip(rng.lognormal(6, 1.2, 20_000), 1, 4096).astype(int)
    assert total(plan(Counter(lengths.tolist()), 4096)) <= -(-int(lengths.sum()) // 4096) + 2
    # No two lengths over a half share a sequence.
    lengths = rng.integers(1, 4097, 20_000)
    assert total(plan(Counter(lengths.tolist()), 4096)) <= 1.01 * max(lengths.sum() / 4096, (lengths > 2048).sum())


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_equals_whole_encoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = QUERIES["op13_best_fit"](spark, SF).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = set()
    for d in docs:
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want.add((d.doc_id, piece, start, len(part), crc32(np.array(part, "<u4").tobytes())))
    assert len(rows) == len(want) and {tuple(r)[:5] for r in rows} == want
    used = check_places(rows, 4096)
    assert used <= -(-sum(w[3] for w in want) // 4096) + 1


def test_sequences_restore_texts_whatever_the_columns(spark):
    texts = [None, "", "a b", "word " * 700, "a b", "x" * 5000, "Hello, İ! " * 40]
    rows = [(None if i == 2 else i % 5, t, 1, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length int, sequence_id string")
    placed = pack_documents(docs, TOKENIZER, capacity=50, keep_ids=True)
    found = placed.collect()
    assert check_places(found, 50) >= -(-sum(r.length for r in found) // 50)
    whole = {r.sequence_id: (r.length, r.ids) for r in sequences(placed).collect()}
    for r in found:
        length, ids = whole[r.sequence_id]
        assert len(ids) == 4 * length and ids[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
        assert crc32(bytes(r.ids)) == r.ids_crc32
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in rows)
    ends = Counter((r.doc_id, r.start + r.length) for r in found if r.ids[-4:] == b"\x01\0\0\0")
    assert ends == want
    assert pack_documents(docs.limit(0), TOKENIZER).collect() == []


def test_hot_length_and_bad_lengths(spark):
    pieces = spark.range(130_000).selectExpr("id as doc_id", "if(id % 3 = 0, 7L, id % 90 + 1) as length", "'x' as salt", "id as number")
    placed = place(pieces, capacity=100)
    assert placed.columns == ["doc_id", "length", "salt", "number", "sequence_id", "offset"]
    rows = placed.collect()
    assert len(rows) == 130_000 and check_places(rows, 100) <= -(-sum(r.length for r in rows) // 100) * 1.01
    alike = spark.createDataFrame([(1, 60)] * 3 + [(2, 40)], "doc_id int, length int")
    rows = place(alike, capacity=100).collect()
    assert check_places(rows, 100) == 3 and len(rows) == 4
    for bad in (0, 101, None):
        with pytest.raises(ValueError):
            place(spark.createDataFrame([(1, bad)], "doc_id int, length int"), capacity=100)
    with pytest.raises(ValueError):
        place(alike.withColumnRenamed("doc_id", "offset"))
    assert cut(alike.selectExpr("doc_id", "'t' as text").limit(0), TOKENIZER).collect() == []
