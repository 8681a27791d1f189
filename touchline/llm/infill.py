"""Fill-in-the-middle texts: unit-chunk pieces under secondary sort, streamed per document.

Each text becomes pieces keyed by document and place in the output. One
``repartitionAndSortWithinPartitions`` brings a document's pieces to one task in output order,
where they are streamed into a digest or joined. Restoration reads that very stream, finds
segments by their marks, keys each piece by its place in the text, and sorts again: the
partitioner is the same, so the second sort moves nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: UTF-8 bytes of a piece, about: whole units up to this, a longer unit in parts of this size.
PIECE_BYTES = 1 << 16
#: UTF-8 bytes of the texts of a task, about, beyond what the session's partition count gives.
TASK_BYTES = 1 << 26

#: (row key, place), payload. Places: -1 the head, then 0, 1, ..
Piece = tuple[tuple[bytes, int], object]


@dataclass(frozen=True)
class Rule:
    """How texts are cut and arranged; the numbers after ``salt`` are shares in percent."""

    salt: str = "7"
    rate: int = 100
    suffix_first: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def numbers(self, doc: object) -> list[int]:
        digest = hashlib.sha256(f"{self.salt}:{'' if doc is None else doc}".encode()).hexdigest()
        return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


@dataclass(frozen=True)
class Head:
    """What goes with a document's pieces: its id and how its text was cut."""

    doc: object
    units: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None


def unit_ends(text: bytes) -> np.ndarray:
    """Byte ends of the lines of ``text``, each with its line feed; the last may have none."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    if len(text) and (not ends.size or ends[-1] < len(text)):
        ends = np.append(ends, len(text))
    return ends


def chunks(text: bytes, ends: np.ndarray, first: int, last: int, most: int) -> Iterator[bytes]:
    """Units ``first`` up to below ``last`` in pieces of whole units, of ``most`` bytes where units allow.

    A unit over ``most`` bytes is cut between characters.
    """
    bounds = np.concatenate(([0], ends))
    while first < last:
        start = int(bounds[first])
        until = int(np.searchsorted(bounds, start + most, side="right")) - 1
        until = min(max(until, first + 1), last)
        end = int(bounds[until])
        while end - start > most:
            cut = start + most
            while text[cut] & 0xC0 == 0x80:
                cut -= 1
            yield text[start:cut]
            start = cut
        yield text[start:end]
        first = until


def arranged(doc: object, text: str, rule: Rule, most: int) -> tuple[Head, Iterator[bytes]]:
    """The head of a document and the pieces of its output, in output order."""
    octets = text.encode()
    ends = unit_ends(octets)
    n = len(ends)
    h1, h2, h3, h4 = rule.numbers(doc)
    if not text or h3 % 100 >= rule.rate or any(mark in text for mark in rule.marks):
        return Head(doc, n, "plain", None, None), chunks(octets, ends, 0, n, most)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    bounds = [0, *ends.tolist()]
    chars = [len(octets[i:j].decode()) for i, j in pairwise((0, bounds[a], bounds[b]))]
    spm = h4 % 100 < rule.suffix_first
    parts = {rule.prefix: (0, a), rule.suffix: (b, n), rule.middle: (a, b)}
    order = (rule.suffix, rule.prefix, rule.middle) if spm else (rule.prefix, rule.suffix, rule.middle)

    def pieces() -> Iterator[bytes]:
        for mark in order:
            yield mark.encode()
            yield from chunks(octets, ends, *parts[mark], most)

    return Head(doc, n, "spm" if spm else "psm", *chars), pieces()


def _row_key(partition: int, doc: object, text: str) -> bytes:
    """A key that rows alike in id and text of one input partition share, and no others."""
    digest = hashlib.blake2b(f"{doc!r} {text}".encode(), digest_size=16).digest()
    return digest + partition.to_bytes(4, "big")


def _owner(key: tuple[bytes, int]) -> int:
    return int.from_bytes(key[0][:7], "big")


def output_pieces(
    docs: DataFrame, rule: Rule, *, id_col: str, text_col: str, piece_bytes: int, tasks: int
) -> RDD[Piece]:
    """Heads and pieces of all outputs, each document in one partition, in output order."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def emit(partition: int, docs: Iterable) -> Iterator[Piece]:
        for doc, text in docs:
            key = _row_key(partition, doc, text)
            head, pieces = arranged(doc, text, rule, piece_bytes)
            yield (key, -1), (head.doc, head.units, head.form, head.prefix_chars, head.middle_chars)
            for place, piece in enumerate(pieces):
                yield (key, place), piece

    return rows.rdd.mapPartitionsWithIndex(emit).repartitionAndSortWithinPartitions(tasks, _owner)


def _documents(pieces: Iterable[Piece]) -> Iterator[tuple[bytes, int, object, Iterator[object]]]:
    """(row key, rows alike, head, payloads in order) of each document of a sorted stream.

    Rows alike in id and text share a key; each of their pieces comes as often as there are
    rows, and is passed on once. The payloads must be read before the next document is.
    """
    stream = iter(pieces)
    ahead: list[Piece | None] = [next(stream, None)]

    def run(key: tuple[bytes, int]) -> int:
        count = 0
        while ahead[0] is not None and ahead[0][0] == key:
            count += 1
            ahead[0] = next(stream, None)
        return count

    def rest(row: bytes) -> Iterator[object]:
        while ahead[0] is not None and ahead[0][0][0] == row:
            key, payload = ahead[0]
            run(key)
            yield payload

    while ahead[0] is not None:
        key, head = ahead[0]
        yield key[0], run(key), head, rest(key[0])


def _restoring(rule: Rule, finish: Callable[[Iterable[bytes]], object]) -> Callable[[Iterable[Piece]], Iterator[Piece]]:
    """Reads outputs in order; passes their pieces on keyed by place in the text.

    The place of a piece comes from the output and its form alone: the mark it stands behind
    and its number behind that mark. What ``finish`` makes of the output goes with the head.
    """
    rank = {rule.prefix.encode(): 0, rule.middle.encode(): 1, rule.suffix.encode(): 2}

    def run(pieces: Iterable[Piece]) -> Iterator[Piece]:
        for key, rows, head, payloads in _documents(pieces):
            held: list[Piece] = []
            form, segment, number = head[2], 0, 0

            def passing() -> Iterator[bytes]:
                nonlocal segment, number
                for payload in payloads:
                    if form != "plain" and payload in rank:
                        segment, number = rank[payload], 0
                    else:
                        held.append(((key, segment << 40 | number), payload))
                        number += 1
                    yield payload

            yield (key, -1), (rows, head, finish(passing()))
            yield from held

    return run


def _sha256(pieces: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


def _joined(pieces: Iterable[bytes]) -> str:
    return b"".join(pieces).decode()


def _tasks(docs: DataFrame, column: str, tasks: int | None) -> int:
    """Tasks by the size of the texts, since adaptive execution does not see this shuffle."""
    if tasks:
        return tasks
    size = docs.agg(F.sum(F.octet_length(column).cast("bigint"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def _frame(docs: DataFrame, id_col: str, rows: RDD, *outs: str) -> DataFrame:
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()), *[T.StructField(name, T.StringType()) for name in outs],
    ])
    return docs.sparkSession.createDataFrame(rows, schema, verifySchema=False)


def transform(
    docs: DataFrame, rule: Rule = Rule(), *, id_col: str = "doc_id", text_col: str = "text",
    piece_bytes: int = PIECE_BYTES, tasks: int | None = None,
) -> DataFrame:
    """Per row of ``docs``: id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    Units are lines. Four numbers from the digest of the salt and the id cut them into prefix,
    middle and suffix (either may be empty) and choose the form: ``psm``, ``spm``, or ``plain``
    (the text as it is) for empty texts, texts that hold a mark, and the share beyond the rate.
    A null text counts as empty; a null id draws its numbers as an empty id. Repeated ids and
    repeated rows give a row each. Other columns are left out, whatever their names. An empty
    table gives an empty result. A long text moves in pieces; only ``output`` joins them.
    """

    def run(pieces: Iterable[Piece]) -> Iterator[tuple]:
        for _, rows, head, payloads in _documents(pieces):
            row = (*head, _joined(payloads))
            for _ in range(rows):
                yield row

    found = output_pieces(
        docs, rule, id_col=id_col, text_col=text_col, piece_bytes=piece_bytes, tasks=_tasks(docs, text_col, tasks)
    )
    return _frame(docs, id_col, found.mapPartitions(run), "output")


def segments(output: str, form: str, rule: Rule = Rule()) -> tuple[str, str, str]:
    """(prefix, middle, suffix) of an output; all of a plain one counts as prefix.

    The text of another form holds no mark, and no mark can arise where a segment meets one,
    since a mark starts with its only ``<`` and ends with its only ``>``.
    """
    if form == "plain":
        return output, "", ""
    first, second = (rule.prefix, rule.suffix) if form == "psm" else (rule.suffix, rule.prefix)
    if not output.startswith(first) or second not in output or rule.middle not in output:
        raise ValueError(f"not an output of form {form}")
    head, middle = output[len(first) :].split(rule.middle)
    one, two = head.split(second)
    return (one, middle, two) if form == "psm" else (two, middle, one)


def restore(
    outputs: DataFrame, rule: Rule = Rule(), *, id_col: str = "doc_id", piece_bytes: int = PIECE_BYTES,
    tasks: int | None = None,
) -> DataFrame:
    """(id, text) of each row of ``outputs`` (id, form, output): the texts ``transform`` was given.

    Needs nothing but the output and its form. Pieces are keyed by their place in the text and
    brought into order by a secondary sort. Rows alike stay as many as they are.
    """
    rows = outputs.select(F.col(id_col).alias("id"), "form", "output")

    def emit(partition: int, docs: Iterable) -> Iterator[Piece]:
        for doc, form, output in docs:
            key, place = _row_key(partition, doc, f"{form} {output}"), 0
            yield (key, -1), doc
            for segment in segments(output, form, rule):
                octets = segment.encode()
                ends = unit_ends(octets)
                for piece in chunks(octets, ends, 0, len(ends), piece_bytes):
                    yield (key, place), piece
                    place += 1

    def run(pieces: Iterable[Piece]) -> Iterator[tuple]:
        for _, rows, doc, payloads in _documents(pieces):
            row = (doc, _joined(payloads))
            for _ in range(rows):
                yield row

    found = rows.rdd.mapPartitionsWithIndex(emit).repartitionAndSortWithinPartitions(_tasks(outputs, "output", tasks), _owner)
    schema = T.StructType([
        T.StructField(id_col, outputs.schema[id_col].dataType), T.StructField("text", T.StringType()),
    ])
    return outputs.sparkSession.createDataFrame(found.mapPartitions(run), schema, verifySchema=False)


def digests(
    docs: DataFrame, rule: Rule = Rule(), *, id_col: str = "doc_id", text_col: str = "text",
    piece_bytes: int = PIECE_BYTES, tasks: int | None = None,
) -> DataFrame:
    """As ``transform``, with ``output_sha256`` and ``restored_sha256`` in place of the output.

    The restored text is rebuilt from the output and its form and streamed into its digest;
    a task holds the pieces of one document at a time. Nulls, repeats and empty tables as there.
    """
    tasks = _tasks(docs, text_col, tasks)

    def run(pieces: Iterable[Piece]) -> Iterator[tuple]:
        for _, _, (rows, head, output), payloads in _documents(pieces):
            row = (*head, output, _sha256(payloads))
            for _ in range(rows):
                yield row

    out = output_pieces(
        docs, rule, id_col=id_col, text_col=text_col, piece_bytes=piece_bytes, tasks=tasks
    )
    placed = out.mapPartitions(_restoring(rule, _sha256), preservesPartitioning=True)
    restored = placed.repartitionAndSortWithinPartitions(out.getNumPartitions(), _owner).mapPartitions(run)
    return _frame(docs, id_col, restored, "output_sha256", "restored_sha256")
