import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import ordering, token_files
from touchline.llm.batches import json_tokenizer
from touchline.llm.token_files import WordIds, _image, pack, read_image, read_tokens, token_file_digests, unpack, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=30))
def test_coding_round_trip(ranks):
    control, data = pack(np.array(ranks, np.uint32))
    assert unpack(control, data, len(ranks)).tolist() == ranks
    assert len(data) == sum(max(1, -(-r.bit_length() // 8)) for r in ranks) and len(control) == -(-len(ranks) // 4)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aA bÉé'́.,1 \n\t\x0b\x1c\x85\xa0ſΣσ<|endoftext>") | st.characters(exclude_categories=["Cs"]), max_size=30))
def test_words_give_ids_of_text(text):
    check(text)


def check(*texts):
    words = WordIds(PATH)
    for text, got in zip(texts, words.encode(list(texts)), strict=True):
        want = json_tokenizer(PATH).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, words.dtype).tolist() == want


def test_words_of_given_texts():
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])
    check(*table.column(0).to_pylist())
    check(". , .. a. a., Ab, İstanbul. ÉTÉ, é. e\u0301. ª, ʰ. straße. 'S. don't, <|ENDOFTEXT|>. <|endoftext|>, x<|startoftext|>y,")
    check("İ", "ǅ, ΑΣ. ΣΑΣ, ﬀ. K. 中文, हिन्दी.")


def test_letters_before_a_mark():
    check("DENİZLİ, DENİZLİ. अज़. অড়,", "İ, İ.")
    letters = [c for c in map(chr, range(0x80, 0x110000)) if c.isalpha()]
    texts = [f"{c}{mark} x{c}{mark}" for c in letters for mark in ".,"]
    words = WordIds(PATH)
    want = json_tokenizer(PATH).encode_batch_fast(texts, add_special_tokens=False)
    got = words.encode(texts)
    assert not [t for t, g, w in zip(texts, got, want, strict=True) if np.frombuffer(g, words.dtype).tolist() != w.ids]


def test_image():
    docs = [(5, False, [1, 2, 300]), (0, True, []), (-7, False, [70000] * 9)]
    image = _image([(i, null, len(r), *map(len, p := pack(np.array(r, np.uint32))), *p) for i, null, r in docs])
    assert [(i, r.tolist()) for i, r in read_image(image)] == [(5, [1, 2, 300]), (None, []), (-7, [70000] * 9)]


def test_digests_against_plain_encoding(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ordering.range_cuts, "__defaults__", (50,))
    rng = random.Random(1)
    words = "the of and Über <|endoftext|> don't 42 x\ny".split(" ") + ["", "zq" * 9]
    rows = [(i * 3 - 40, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in rng.sample(range(300), 230)]
    rows += [(None, "null id"), (None, None), (7777, None), (7778, ""), (-50, "go " * 30_000), (7779, "twice"), (7779, "twice")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, start int")
    got = sorted(token_file_digests(docs, PATH).collect(), key=lambda r: r.start)
    start = 0
    by_id = {}
    for i, text in rows:
        ids = json_tokenizer(PATH).encode(text or "", add_special_tokens=False).ids + [2]
        by_id.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in by_id[r.doc_id]
        start += r.n_tokens
    folder = f"file://{tmp_path}/small"
    files = write_tokens(docs, PATH, folder, file_bytes=100)
    assert files.count() > 20
    again = read_tokens(files, folder).select("doc_id", "start", "n_tokens").orderBy("start").collect()
    assert [tuple(r) for r in again] == [(r.doc_id, r.start, r.n_tokens) for r in got]
    assert token_file_digests(docs.limit(0), PATH).collect() == []


def test_files_are_read_in_bounded_batches(monkeypatch, tmp_path):
    """A whole file as one batch took a worker's memory, beside the words it had kept for encoding."""
    monkeypatch.setattr(token_files, "READ_BYTES", 40)
    folder = f"file://{tmp_path}/files"
    docs = [(i, False, 3, *map(len, p := pack(np.array([i, 1, 2], np.uint32))), *p) for i in range(10)]
    token_files._put(folder, "one.bin", _image(docs))
    token_files._put(folder, "ranks.bin", np.arange(10, 30, dtype="<u4").tobytes())
    batches = list(token_files._documents(folder, "one.bin", 7))
    assert [b.num_rows for b in batches] == [4, 4, 2]
    rows = [r for b in batches for r in b.to_pylist()]
    assert rows == [
        {"id": i, "start": 7 + 3 * i, "n_tokens": 3, "ids": np.array([10 + i, 11, 12], "<u4").tobytes()} for i in range(10)
    ]


def test_texts_are_cut_by_bytes():
    rows = ["x" * n for n in (5, 0, 30, 1, 1, 12)] + [None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "text": rows})
    pieces = list(token_files._by_text([batch, batch.slice(3, 0)], 1, 10))
    assert sum((p.column("text").to_pylist() for p in pieces), []) == rows and len(pieces) >= 3
    assert all(sum(len(t or "") for t in p.column("text").to_pylist()) <= 40 for p in pieces)


def test_kept_words_are_bounded(monkeypatch):
    words = WordIds(PATH)
    monkeypatch.setattr(token_files, "KEPT_WORDS", 5)
    for text in ("a b c d e f g h", "  b\tz ", "", " "):
        got = words.encode([text])
        assert np.frombuffer(got[0], words.dtype).tolist() == json_tokenizer(PATH).encode(text, add_special_tokens=False).ids
    assert len(words.known) < 8 and b"" not in words.known and words.encode([]) == []
