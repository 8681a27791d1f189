"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Layout of a file, little-endian: 8 bytes magic, documents (u64); per document its id (i64),
whether the id is null (u8), ids (u64), control bytes (u64), data bytes (u64); all control
bytes; all data bytes. A control byte holds two bits for each of four ranks: how many bytes,
less one, the rank has in the data. A document starts with a control byte of its own; ranks
missing in its last one have no data. ``ranks.bin`` in the folder maps rank to id (u32).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.batches import by_bytes, json_tokenizer, map_arrow, slices
from touchline.llm.ordering import range_cuts, ranges_of
from touchline.session import shared_dir, staged

MAGIC = b"RANKVB01"
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8"), ("control", "<u8"), ("data", "<u8")])
#: A file closes with the document that brings it to this many bytes.
FILE_BYTES = 8 << 20
#: Bytes of text that are encoded at a time; the longer, the fewer words are looked up twice.
TEXT_BYTES = 8 << 20
#: Bytes of ids after which a batch read from a file closes.
READ_BYTES = 4 << 20
#: Distinct words that a worker keeps with their ids, at about 180 bytes each besides their
#: content, and bytes of that content; beyond either it starts anew.
KEPT_WORDS = 800_000
KEPT_BYTES = 64_000_000
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


#: Words of the letters a-z, À-Ö, Ø-Þ, ß-ö and ø-ÿ: composed already, and lower-cased one by one.
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: The byte alphabet of byte-level models: printable bytes are themselves, the others follow 255.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordIds:
    """Ids of a text, each distinct word of it encoded once by the tokenizers library.

    For tokenizers that drop white space, lower-case, take a run of letters as one unit and
    never join characters over white space: the ids of a text are those of its words in
    order. Words are cut at the ASCII white space, A-Z lower-cased first. A word that is one
    run of Latin letters goes to the library's merge model as such; one full stop or comma behind
    letters, if they are still letters once normalised, is a unit of its own. All other words pass through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = json_tokenizer(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def _whole(self, words: list[bytes]) -> None:
        for batch in by_bytes((word.decode() for word in words), 1 << 18):
            found = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
            for word, encoding in zip(batch, found, strict=True):
                self.known[word.encode()] = np.array(encoding.ids, self.dtype).tobytes()

    def _letters(self, stem: bytes) -> bool:
        """Whether the pre-tokenizer sees letters only; the normaliser turns some letters into letter and mark."""
        if stem.isalpha() or _LATIN.fullmatch(stem):
            return True
        text = stem.decode()
        return text.isalpha() and self.tokenizer.normalizer.normalize_str(text).isalpha()

    def _learn(self, new: set[bytes]) -> None:
        known, merge, code = self.known, self.tokenizer.model.tokenize, self.code
        stems = {w[:-1] for w in new if w[-1:] in b".," and len(w) > 1} | new
        rest = []
        for word in stems - known.keys():
            if _LATIN.fullmatch(word):
                units = word.decode()
                if not units.isascii():
                    units = units.lower().encode().decode("latin-1").translate(_BYTES)
                known[word] = b"".join([code[t.id] for t in merge(units)])
            else:
                rest.append(word)
        letters = {w for w in rest if w.decode().isalpha()}
        self._whole(sorted(letters | {b".", b","}))
        whole = set(rest) - letters
        for word in [w for w in whole if w[-1:] in b".," and w[:-1] in known]:
            if self._letters(word[:-1]):
                known[word] = known[word[:-1]] + known[word[-1:]]
                whole.discard(word)
        self._whole(sorted(whole & new))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian ids of each text, of type ``dtype``."""
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """``encode`` of an array without nulls; words are cut, made distinct and put back by Arrow."""
        if len(self.known) > KEPT_WORDS or self.held > KEPT_BYTES:
            self.known.clear()
            self.held = 0
        # Lower-casing could turn other text into a special string.
        special = pc.match_substring(texts, "<|")
        cut = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_pylist()
        new = set(distinct).difference(self.known)
        # White space at either end of a text leaves an empty word there.
        new.discard(b"")
        if new:
            self._learn(new)
            # A word's stem may be kept beside it.
            self.held += 2 * (sum(map(len, new)) + sum(map(len, map(self.known.__getitem__, new))))
        ids = pa.array([self.known[word] if word else b"" for word in distinct], pa.large_binary())
        _, starts, content = ids.take(words.indices).buffers()
        starts = np.frombuffer(starts, np.int64)[cut.offsets.to_numpy()]
        return pa.Array.from_buffers(ids.type, len(texts), [None, pa.py_buffer(starts), content])


@lru_cache(maxsize=2)
def _words(path: str) -> WordIds:
    return WordIds(path)


def _by_text(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes of a text column, and one text at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff(sizes.cumsum() // most)) + 1
        for start, stop in pairwise([0, *cuts.tolist(), batch.num_rows]):
            yield batch.slice(start, stop - start)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ``ranks``."""
    ranks = ranks.astype("<u4")
    codes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    held = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    held[: len(ranks)] = codes
    control = (held.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    octets = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), octets[np.arange(4) <= codes[:, None]].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` ranks of ``pack``, by table lookup."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    starts = np.cumsum(lengths) - lengths
    held = data + bytes(3)
    words = np.ndarray(len(held) - 3, "<u4", held, strides=(1,))
    return words[starts] & _MASKS[lengths - 1]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, content: bytes) -> None:
    """Written under another name first, so that a task run again never leaves half a file."""
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    part = f"{base}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, f"{base}/{name}")


def _get(folder: str, name: str) -> bytes:
    store, base = _open(folder)
    with store.open_input_stream(f"{base}/{name}") as source:
        return source.read()


@lru_cache(maxsize=2)
def _ids_by_rank(folder: str) -> np.ndarray:
    return np.frombuffer(_get(folder, "ranks.bin"), "<u4")


def _image(docs: list[tuple]) -> bytes:
    table = np.array([d[:5] for d in docs], _DOC)
    return b"".join(
        (MAGIC, np.uint64(len(docs)).tobytes(), table.tobytes(), *(d[5] for d in docs), *(d[6] for d in docs))
    )


def read_image(image: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ranks) of each document of a file, in its order."""
    if image[:8] != MAGIC:
        raise ValueError("not a token file")
    count = int(np.frombuffer(image, "<u8", 1, 8)[0])
    table = np.frombuffer(image, _DOC, count, 16)
    control = 16 + table.nbytes
    data = control + int(table["control"].sum())
    for doc in table:
        c, d = control + int(doc["control"]), data + int(doc["data"])
        yield None if doc["null"] else int(doc["id"]), unpack(image[control:c], image[data:d], int(doc["n"]))
        control, data = c, d


def _documents(folder: str, name: str, start: int) -> Iterator[pa.RecordBatch]:
    """The documents of a file; a batch closes with the one that brings its ids to ``READ_BYTES``."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*docs, strict=True), types, strict=True)],
            names=["id", "start", "n_tokens", "ids"],
        )

    docs, held = [], 0
    for i, ranks in read_image(_get(folder, name)):
        docs.append((i, start, len(ranks), _ids_by_rank(folder)[ranks].tobytes()))
        start += len(ranks)
        held += len(docs[-1][3])
        if held >= READ_BYTES:
            yield batch()
            docs, held = [], 0
    if docs:
        yield batch()


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str, *, id_col: str = "doc_id",
    text_col: str = "text", end_id: int = 2, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the ids of all texts to ``folder`` in ascending id order; returns the file list.

    ``tokenizer`` is a ``.json`` file of the tokenizers library that drops white space;
    ``end_id`` follows each document, so an empty or null text has one id. Ids of equal value
    are ordered by their ids' coding; a null id comes first and is kept as null. Ids must be
    BIGINT; other columns are left out. An empty table gives no file and an empty list. The
    list has one row per file: ``part`` and ``file`` give the order, ``name``, ``n_docs``,
    ``n_tokens``. ``folder`` is a URI that pyarrow can open on every worker.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = _words(tokenizer)
        end = pa.scalar(np.array([end_id], words.dtype).tobytes(), pa.large_binary())
        found = words.encode_array(pc.fill_null(batch.column(1), ""))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([words.dtype.itemsize] * len(found), pa.int32()),
                pc.binary_join_element_wise(found, end, pa.scalar(b"", pa.large_binary())).cast(pa.binary()),
            ],
            names=["id", "width", "ids"],
        )

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(encode, _by_text(batches, 1, TEXT_BYTES))

    encoded = staged(rows.mapInArrow(encode_all, "id bigint, width int, ids binary"), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in slices(batches, 512):
            by_width: dict[int, list[bytes]] = {}
            for width, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_width.setdefault(width, []).append(ids)
            for width, texts in by_width.items():
                found = np.bincount(np.frombuffer(b"".join(texts), f"<u{width}"))
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["token", "n"])

    counts = encoded.select("width", "ids").mapInArrow(count, "token bigint, n bigint")
    # One row per id of the vocabulary at most reaches the driver.
    ranked = counts.groupBy("token").agg(F.sum("n").alias("n")).collect()
    by_rank = np.array([r.token for r in sorted(ranked, key=lambda r: (-r.n, r.token))], "<u4")
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    _put(folder, "ranks.bin", by_rank.tobytes())

    cuts = range_cuts(rows, "id")

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        # All texts are encoded; the words that this worker kept would take memory to the end.
        _words.cache_clear()
        widths, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        ranks = [rank_of[np.frombuffer(i, f"<u{w}")] for w, i in zip(widths, ids, strict=True)]
        packed = [pack(r) for r in ranks]
        return pa.RecordBatch.from_arrays(
            [
                ranges_of(batch.column(0), cuts), batch.column(0),
                pa.array([len(r) for r in ranks], pa.int64()),
                pa.array([c for c, _ in packed], pa.binary()), pa.array([d for _, d in packed], pa.binary()),
            ],
            names=["part", "id", "n", "control", "data"],
        )

    coded = map_arrow(encoded, code, "part int, id bigint, n bigint, control binary, data binary")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, held, size = None, 0, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                name = f"part-{part:05d}-{file:06d}.bin"
                _put(folder, name, _image(held))
                row = {"part": part, "file": file, "name": name, "n_docs": len(held), "n_tokens": sum(d[2] for d in held)}
                yield pa.RecordBatch.from_pylist([row], schema=listed)

        for batch in slices(batches, 512):
            for p, i, n, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part or size >= file_bytes:
                    yield from close()
                    part, file, held, size = p, file + 1 if p == part else 0, [], 0
                held.append((i or 0, i is None, n, len(control), len(data), control, data))
                size += len(control) + len(data)
        yield from close()

    listed = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    files = (
        coded.repartitionById(len(cuts) + 1, "part")
        .sortWithinPartitions("part", "id", "n", "control", "data")
        .mapInArrow(write, "part int, file int, name string, n_docs bigint, n_tokens bigint")
    )
    return staged(files, "token-list")


def read_tokens(files: DataFrame, folder: str, *, id_col: str = "doc_id") -> DataFrame:
    """Each document of the listed files: id, ``start`` (ids of all before it), ``n_tokens``, ``ids``.

    ``ids`` are little-endian u32 token ids as binary. The order is that of the list.
    """
    # Starts of files: sums of the parts before (one number per part, of which there is a
    # bounded number), then a running sum within the part.
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, base = 0, []
    for r in totals:
        base += [r.part, before]
        before += r.n
    if not base:
        base = [0, 0]
    w = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn(
        "start",
        F.create_map(*map(F.lit, base))[F.col("part")] + F.coalesce(F.sum("n_tokens").over(w), F.lit(0)),
    ).select("name", F.col("start").cast("bigint"))
    tasks = max(1, len(totals))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _documents(folder, name, start)

    out = placed.repartition(tasks, "name").mapInArrow(
        read, "id bigint, start bigint, n_tokens bigint, ids binary"
    )
    return out.withColumnRenamed("id", id_col)


def token_file_digests(
    docs: DataFrame, tokenizer: str, folder: str | None = None, *, id_col: str = "doc_id",
    text_col: str = "text", end_id: int = 2,
) -> DataFrame:
    """Write the token files, read them back: id, start, n_tokens, ids_crc32 per document."""
    folder = folder or shared_dir(docs.sparkSession, "tokens")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    files = write_tokens(docs, tokenizer, folder, id_col=id_col, text_col=text_col, end_id=end_id)
    return read_tokens(files, folder, id_col=id_col).select(
        id_col, "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
