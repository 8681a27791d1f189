"""Helpers for functions over Arrow batches, and the cutting of texts at safe boundaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: A single space between two characters that are not white space.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Rows of one Arrow batch that a function works on at a time; a few thousand texts.
ROWS = 2048


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a bounded number of rows, so few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_arrow(
    df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
    rows: int = ROWS,
) -> DataFrame:
    """``each`` over slices of the Arrow batches of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(each, slices(batches, rows))

    return df.mapInArrow(run, schema)


def column_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def safe_pieces(text: str) -> list[str]:
    """``text`` cut at each single space that stands between two non-space characters.

    The public tokenizers used here never join characters over such a space, so the tokens
    of a text are those of its pieces in order. The space itself is dropped.
    """
    return _SAFE.split(text)


def by_bytes(pieces: Iterable[str], most: int) -> Iterator[list[str]]:
    """Batches of about equal size: each closes before it would pass ``most`` UTF-8 bytes."""
    batch: list[str] = []
    held = 0
    for piece in pieces:
        size = len(piece.encode())
        if batch and held + size > most:
            yield batch
            batch, held = [], 0
        batch.append(piece)
        held += size
    if batch:
        yield batch


@lru_cache(maxsize=4)
def sentencepiece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def json_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer
