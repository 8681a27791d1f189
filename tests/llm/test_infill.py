import hashlib
import random
import re

import pytest

from touchline.llm.infill import PIECE_BYTES, Rule, chunks, digests, restore, segments, transform, unit_ends

SCHEMA = "doc_id bigint, text string, n bigint, form string, output string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc, text, rule=Rule()):
    """(n, form, prefix_chars, middle_chars, output), by the words of the rule."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha(f"{rule.salt}:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in rule.marks) or h3 % 100 >= rule.rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < rule.suffix_first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    alphabet = ["a", "é", "漢", "😀", "\n", "\n", "\r", " ", "<", ">", "P", "S", "M", "\x85", " ", "\x00"]
    out = [None, "", "\n", "\n\n", "one line", "<P>", "a<S>b\nc", "x\n<M>", "<P\n>S<\nM>", "<\nP>", "<<P\n", "é" * 40 + "\n" + "z" * 90]
    return out + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(120)]


@pytest.mark.parametrize("rule", [Rule(), Rule(rate=40, suffix_first=80, salt="x")])
def test_equals_the_rule_in_small_pieces(spark, rule):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(i, t, 1, "f", "o") for i, t in rows], SCHEMA)
    want = {i: brute(i, t, rule) for i, t in rows}
    for size in (4, 17, PIECE_BYTES):
        out = transform(docs, rule, piece_bytes=size, tasks=3)
        got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
        assert got == want
        back = restore(out, rule, piece_bytes=size, tasks=2).collect()
        assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in rows}
        sums = {r.doc_id: tuple(r)[1:] for r in digests(docs, rule, piece_bytes=size, tasks=5).collect()}
        assert sums == {i: (*w[:4], sha(w[4]), sha(rows[i][1] or "")) for i, w in want.items()}
    assert {w[1] for w in want.values()} == {"plain", "psm", "spm"}


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a\nb\nc"), (None, "a\nb\nc"), (None, None), (3, "k\nl"), (3, "k\nl"), (3, "k\nl"), (3, "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for frame in (docs.coalesce(1), docs.repartition(4)):
        got = sorted(map(repr, ((r.doc_id, *tuple(r)[1:]) for r in transform(frame).collect())))
        assert got == sorted(repr((i, *brute(i, t))) for i, t in rows)
        sums = [(r.doc_id, r.output_sha256, r.restored_sha256) for r in digests(frame).collect()]
        assert sorted(map(repr, sums)) == sorted(repr((i, sha(brute(i, t)[4]), sha(t or ""))) for i, t in rows)
        assert restore(transform(frame)).count() == len(rows)
    assert digests(docs.limit(0)).collect() == [] and transform(docs.limit(0)).collect() == []
    named = docs.selectExpr("text as id", "doc_id as text")
    assert transform(named, id_col="id", text_col="id").count() == len(rows)


def test_very_long_text_and_hot_copies(spark):
    long = "\n".join(f"line {i} " + "é" * (i % 90) for i in range(40_000)) + "w" * 300_000
    rows = [(0, long), *((i, "same\ntext\n") for i in range(1, 3000))]
    got = {r.doc_id: r for r in digests(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert len(got) == 3000
    for i, t in (rows[0], rows[1], rows[-1]):
        w = brute(i, t)
        assert tuple(got[i])[1:] == (*w[:4], sha(w[4]), sha(t))


def test_pieces_are_bounded_and_whole():
    text = ("ab\n" * 10 + "é" * 30 + "\n" + "c").encode()
    ends = unit_ends(text)
    pieces = list(chunks(text, ends, 0, len(ends), 8))
    assert b"".join(pieces) == text and max(map(len, pieces)) <= 8
    assert all(p.decode() for p in pieces)
    assert not list(chunks(b"", unit_ends(b""), 0, 0, 8))


def test_segments_refuse_other_texts():
    assert segments("<S>s<P>p<M>", "spm") == ("p", "", "s")
    with pytest.raises(ValueError):
        segments("<P>p", "psm")
