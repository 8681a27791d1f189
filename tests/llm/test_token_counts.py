import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm.batches import by_bytes, json_tokenizer, sentencepiece_model
from touchline.llm.token_counts import PieceLengths, count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "  a  b \n c　d ", "x▁y ▁ z", "<s> </s> <unk>",
    "tab\there\nline \nnext  \n x", "é é \U0001f600 a‍b", "word " * 5000, "y" * 30000,
    "don't  we'll <|endoftext|> it<|startoftext|>s", "\x00 \x1c a \xa0b",
]


def whole(path, text):
    if path.endswith(".model"):
        return len(sentencepiece_model(path).encode(text))
    return len(json_tokenizer(path).encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"])
def test_sum_of_pieces_is_count_of_text(name):
    path = public_tokenizers.path(name)
    assert PieceLengths(path, 64).count(ODD) == [whole(path, text) for text in ODD]

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from("aA bé.,'  \n\t1ñ▁<|s>-\xa0"), max_size=40))
    def check(text):
        assert PieceLengths(path).count([text]) == [whole(path, text)]

    check()


def test_batches_by_bytes():
    assert list(by_bytes(["aa", "bb", "éé", "ccccccc", "d"], 5)) == [["aa", "bb"], ["éé"], ["ccccccc"], ["d"]]


def test_count_tokens_rows(spark):
    rows = [(1, None, 7), (None, "two words", 8), (1, "", 9), (2, "two words", 9), (3, "go " * 5000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, count_tokens(docs, MODEL).collect()), key=str)
    long_count = whole(MODEL, "go " * 5000)
    assert long_count > 4096
    n = whole(MODEL, "two words")
    assert got == sorted(
        [(1, 0, 0, False), (None, 9, n, False), (1, 0, 0, False), (2, 9, n, False),
         (3, 15000, long_count, True)], key=str,
    )
    assert count_tokens(docs.limit(0), MODEL).collect() == []
