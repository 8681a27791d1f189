"""Token counts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.batches import (
    by_bytes,
    column_type,
    json_tokenizer,
    map_arrow,
    safe_pieces,
    sentencepiece_model,
)

#: UTF-8 bytes of one call of the tokenizer.
BATCH_BYTES = 1 << 18
#: Bytes of distinct pieces and their lengths that a worker keeps, about; then it starts anew.
KEPT_BYTES = 60_000_000
#: What an entry takes besides its text.
ENTRY_BYTES = 140
_SPACE = "▁"


class PieceLengths:
    """Token count of a text: the sum over its pieces, each distinct piece encoded once.

    Encoding dominates the work, and words repeat, so a worker keeps the lengths of pieces
    it has met. New pieces of all texts of a batch are encoded together, in calls of about
    ``batch_bytes``. Long texts need no other treatment, since their pieces are short.
    """

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES):
        self.batch_bytes = batch_bytes
        self.lengths: dict[str, int] = {}
        self.held = 0
        self.sentencepiece = path.endswith(".model")
        if self.sentencepiece:
            self.model = sentencepiece_model(path)
            names = map(self.model.id_to_piece, range(self.model.get_piece_size()))
            # A piece with a space after another character could join two words.
            self.cuts = not any(_SPACE in name.lstrip(_SPACE) for name in names)
        else:
            self.model = json_tokenizer(path)
            self.cuts = True

    def encode(self, pieces: list[str]) -> list[int]:
        if self.sentencepiece:
            return [len(ids) for ids in self.model.encode(pieces, num_threads=1)]
        return [
            len(e.ids) for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)
        ]

    def pieces(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        if self.sentencepiece:
            # The model reads its own space sign as a space, and puts one before each text.
            return safe_pieces(text.replace(_SPACE, " "))
        first, *rest = safe_pieces(text)
        return [first, *(" " + piece for piece in rest)]

    def count(self, texts: list[str]) -> list[int]:
        if self.held > KEPT_BYTES:
            self.lengths.clear()
            self.held = 0
        lengths = self.lengths
        cut = [self.pieces(text) for text in texts]
        new = {piece for pieces in cut for piece in pieces if piece not in lengths}
        for batch in by_bytes(sorted(new), self.batch_bytes):
            lengths.update(zip(batch, self.encode(batch), strict=True))
            # Four bytes a character at most.
            self.held += sum(ENTRY_BYTES + (len(piece) if piece.isascii() else 4 * len(piece)) for piece in batch)
        return [sum(map(lengths.__getitem__, pieces)) for pieces in cut]


@lru_cache(maxsize=4)
def _lengths(path: str, batch_bytes: int) -> PieceLengths:
    return PieceLengths(path, batch_bytes)


def count_tokens(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
    limit: int = 4096, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``tokenizer`` is the path of a ``.json`` file of the tokenizers library or a ``.model``
    file of sentencepiece; all workers must reach it. No begin, end or other special tokens
    are added, nothing is truncated. A null text counts as empty: 0 bytes, 0 tokens. Null
    and repeated ids pass through, each row by itself. Other columns are left out. An empty
    table gives an empty result. There is no shuffle: texts are counted where they are read.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = pc.fill_null(batch.column(1), "")
        counts = _lengths(tokenizer, batch_bytes).count(text.to_pylist())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pc.cast(pc.binary_length(text), pa.int64()),
                pa.array(counts, pa.int64()),
            ],
            names=["id", "n_bytes", "n_tokens"],
        )

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {column_type(ids, 'id')}, n_bytes bigint, n_tokens bigint"
    return map_arrow(ids, each, schema).select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
