"""Language identification: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.batches import column_type, map_arrow, slices

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_SYMBOLS = 257  # the bytes, and one sign behind the end of a text's last window
_PAD = 256
#: Windows that go through the network together in prediction; their states stay in the cache.
_BATCH = 1024


@dataclass(frozen=True)
class Settings:
    """Sizes of the network and of its training; a bounded number of rows per language."""

    hidden: int = 8  # units in each direction
    window: int = 96  # bytes of a sequence; a text is cut into such windows, all of it
    docs_per_lang: int = 400  # labelled rows learned from, at most, for each language
    windows_per_doc: int = 4  # windows of each of those, evenly spaced over its text
    most_langs: int = 500  # languages learned, the most frequent ones
    steps: int = 300
    batch: int = 192
    rate: float = 0.02
    seed: int = 7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _gru(table: np.ndarray, u: np.ndarray, b: np.ndarray, symbols: np.ndarray, keep: bool = False):
    """States (T, H, B) of one direction for ``symbols`` (T, B); ``keep``: what learning needs."""
    size = u.shape[1]
    h = np.zeros((size, symbols.shape[1]), np.float32)
    states = np.empty((len(symbols), size, symbols.shape[1]), np.float32)
    kept = []
    for t, step in enumerate(symbols):
        x = table.take(step, axis=1)
        y = u @ h
        gates = _sigmoid(x[: 2 * size] + y[: 2 * size])
        r, z = gates[:size], gates[size:]
        c = y[2 * size :] + b
        n = np.tanh(x[2 * size :] + r * c)
        if keep:
            kept.append((h, r, z, c, n))
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def _gru_back(u: np.ndarray, symbols: np.ndarray, kept: list, d_states: np.ndarray):
    """Gradients of table, u and b: backpropagation through time."""
    size = u.shape[1]
    d_u, d_b = np.zeros_like(u), np.zeros((size, 1), np.float32)
    d_x = np.empty((len(symbols), 3 * size, symbols.shape[1]), np.float32)
    d_h = np.zeros_like(kept[0][0])
    for t in range(len(symbols) - 1, -1, -1):
        h, r, z, c, n = kept[t]
        d = d_h + d_states[t]
        d_n = d * (1 - z) * (1 - n * n)
        d_r, d_z = d_n * c * r * (1 - r), d * (h - n) * z * (1 - z)
        d_y = np.concatenate((d_r, d_z, d_n * r))
        d_x[t] = np.concatenate((d_r, d_z, d_n))
        d_h = d * z + u.T @ d_y
        d_u += d_y @ h.T
        d_b += (d_n * r).sum(axis=1, keepdims=True)
    rows = d_x.transpose(1, 0, 2).reshape(3 * size, -1)
    flat = symbols.ravel()
    d_table = np.stack([np.bincount(flat, row, _SYMBOLS) for row in rows]).astype(np.float32)
    return d_table, d_u, d_b


class Network:
    """Weights of both directions and of the output layer, and the languages in order.

    With ``background`` there is one class behind those of the languages, for what is in none.
    """

    def __init__(self, langs: list[str], settings: Settings, background: bool = False):
        self.langs, self.settings, self.background = langs, settings, background
        rng = np.random.default_rng(settings.seed)
        h, n = settings.hidden, len(langs) + background
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.weights = [
            w
            for _ in range(2)
            for w in (draw(3 * h, _SYMBOLS, scale=0.5), draw(3 * h, h, scale=h**-0.5), np.zeros((h, 1), np.float32))
        ] + [draw(n, 2 * h, scale=(2 * h) ** -0.5), np.zeros((n, 1), np.float32)]

    def _log_probs(self, symbols: np.ndarray, keep: bool = False):
        """Log probabilities (T, languages, B) of every position."""
        (tf, uf, bf, tb, ub, bb, v, c), h = self.weights, self.settings.hidden
        ahead, kept_f = _gru(tf, uf, bf, symbols, keep)
        behind, kept_b = _gru(tb, ub, bb, symbols[::-1], keep)
        behind = behind[::-1]
        logits = np.matmul(v[:, :h], ahead) + np.matmul(v[:, h:], behind) + c
        logits -= logits.max(axis=1, keepdims=True)
        logs = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return logs, (ahead, behind, kept_f, kept_b)

    def fit(self, symbols: np.ndarray, labels: np.ndarray) -> None:
        """Adam on the cross entropy of all positions; ``symbols`` (T, N), ``labels`` (N)."""
        s, h = self.settings, self.settings.hidden
        rng = np.random.default_rng(s.seed + 1)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        for step in range(1, s.steps + 1):
            chosen = rng.integers(0, len(labels), s.batch)
            x, y = symbols[:, chosen], labels[chosen]
            inside = (x != _PAD).astype(np.float32)[:, None, :]
            logs, (ahead, behind, kept_f, kept_b) = self._log_probs(x, keep=True)
            d = np.exp(logs)
            d[:, y, np.arange(s.batch)] -= 1
            d *= inside / max(1.0, float(inside.sum()))
            v = self.weights[6]
            d_v = np.concatenate(
                [np.einsum("tcb,thb->ch", d, states, optimize=True) for states in (ahead, behind)], axis=1
            )
            grads = [
                *_gru_back(self.weights[1], x, kept_f, np.matmul(v[:, :h].T, d)),
                *_gru_back(self.weights[4], x[::-1], kept_b, np.matmul(v[:, h:].T, d)[::-1]),
                d_v, d.sum(axis=(0, 2))[:, None],
            ]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = s.rate * min(1.0, 2 * (1 - step / (s.steps + 1))) * min(1.0, 1.0 / (norm + 1e-9))
            for w, g, (m1, m2) in zip(self.weights, grads, moments, strict=True):
                g = g * np.float32(1.0)
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)

    def document_probs(self, texts: list[bytes]) -> np.ndarray:
        """Mean over all positions of each text's label probabilities: (texts, classes)."""
        window = self.settings.window
        total = np.zeros((len(texts), len(self.langs) + self.background))
        sizes = np.array([len(t) for t in texts], np.int64)
        for symbols, owner in _windows(texts, window, _BATCH):
            probs = np.exp(self._log_probs(symbols)[0])
            probs *= (symbols != _PAD)[:, None, :]
            np.add.at(total, owner, probs.sum(axis=0).T)
        return total / np.maximum(sizes, 1)[:, None]


def _windows(texts: list[bytes], window: int, batch: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All windows of all texts as symbols (window, up to batch), and the text of each."""
    held, owners = [], []
    for i, text in enumerate(texts):
        octets = np.frombuffer(text, np.uint8).astype(np.int16)
        cut = np.full(-(-len(text) // window) * window, _PAD, np.int16)
        cut[: len(text)] = octets
        held.append(cut.reshape(-1, window))
        owners.append(np.full(len(held[-1]), i))
    if not held:
        return
    all_, owner = np.concatenate(held), np.concatenate(owners)
    for at in range(0, len(all_), batch):
        yield np.ascontiguousarray(all_[at : at + batch].T), owner[at : at + batch]


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def learn(
    labelled: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang", background: bool = False,
) -> Network | None:
    """A network fitted on a bounded sample of ``labelled``; None if no row has text and label.

    At most ``docs_per_lang`` rows of each language, of smallest hash of id and text, give
    ``windows_per_doc`` windows each, from the start to the end of their texts. What reaches
    the driver is bounded by these settings. Rows are first thinned by that hash, so a frequent
    language is neither sorted nor gathered whole; rows alike in both are one. With
    ``background`` the network has a class more, learned from ``_noise``.
    """
    rows = labelled.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where("lang is not null and text != ''").withColumn("h", F.xxhash64("id", "text") / F.lit(2.0**64) + 0.5)
    n, w, k = settings.docs_per_lang, settings.window, settings.windows_per_doc
    # Counted by hash, so that rows alike count once, as they do below; exact where few.
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("c"))
    counts = {r.lang: r.c for r in sizes.orderBy(F.desc("c"), "lang").limit(settings.most_langs).collect()}
    if not counts:
        return None
    shares = F.create_map(*[F.lit(x) for lang, c in counts.items() for x in (lang, min(1.0, (2.0 * n + 50) / c))])
    thinned = rows.where(F.col("h") < shares[F.col("lang")]).dropDuplicates(["lang", "h"])
    picked = thinned.selectExpr(
        "lang",
        "id",
        f"""transform(sequence(0, {k - 1}), i -> substring(
            text, cast(1 + i * greatest(length(text) - {w}, 0) div {max(k - 1, 1)} as int), {w})) as parts""",
        f"row_number() over (partition by lang order by h) as place",
    ).where(f"place <= {n}").select("lang", F.explode(F.array_distinct("parts")).alias("part"))
    sample = picked.orderBy("lang", "part").collect()
    langs = sorted({r.lang for r in sample})
    if not langs:
        return None
    network = Network(langs, settings, background)
    parts = [r.part.encode()[:w] for r in sample]
    places = {lang: i for i, lang in enumerate(langs)}
    labels = [places[r.lang] for r in sample]
    if background:
        noise = _noise(parts, -(-len(parts) // len(langs)), settings.seed)
        parts, labels = parts + noise, labels + [len(langs)] * len(noise)
    symbols = np.full((w, len(parts)), _PAD, np.int16)
    for i, part in enumerate(parts):
        symbols[: len(part), i] = np.frombuffer(part, np.uint8)
    network.fit(symbols, np.array(labels))
    return network


def _noise(parts: list[bytes], count: int, seed: int) -> list[bytes]:
    """Windows in no language: half are shuffled ``parts``, the others any bytes or any above 127."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(count):
        part = np.frombuffer(parts[rng.integers(len(parts))], np.uint8)
        if k % 4 < 2:
            part = rng.permutation(part)
        else:
            part = rng.integers(128 if k % 4 == 2 else 0, 256, len(part), np.uint8)
        out.append(part.tobytes())
    return out


def keep_identified(
    docs: DataFrame, network: Network | None, *, text_col: str = "text",
    most_background: float = 0.4, spread: float = 3.0,
) -> DataFrame:
    """Rows of ``docs`` whose text has a letter and, if it is long enough to tell, a language.

    With a background class, a text of n bytes is rejected if that class has more than
    ``most_background`` + ``spread`` / sqrt(n) of its probability, whatever the number of
    languages; so the bound is 0.5 at 900 bytes, and up to 25 bytes are too few to reject.
    Without that class, or without a network, only texts without a letter go, empty and null
    ones too. All columns stay, whatever their names, and each row is judged by itself, so
    null ids and repeated rows are treated alike. An empty table gives an empty result.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts = [t or "" for t in batch.column(place).to_pylist()]
            kept = np.array([has_letter(t) for t in texts], bool)
            if network is not None and network.background and kept.any():
                octets = [t.encode() for t, k in zip(texts, kept, strict=True) if k]
                size = np.array([len(o) for o in octets])
                probs = network.document_probs(octets)
                kept[kept] = probs[:, -1] <= most_background + spread / np.sqrt(size)
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def predict(
    docs: DataFrame, network: Network | None, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, ``lang_pred`` and ``score`` from the whole text alone.

    The text is cut into windows; the network labels each position, and a document's
    probabilities are the means over all of its positions. A text without a letter, empty or
    null, or the lack of a network, gives ``und`` and score 0. Ids pass through as they are,
    rows repeat, other columns are left out, and an empty table gives an empty result.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        langs = [UNDETERMINED] * len(texts)
        scores = np.zeros(len(texts))
        if network is not None:
            known = [i for i, t in enumerate(texts) if has_letter(t)]
            probs = network.document_probs([texts[i].encode() for i in known])
            for i, p in zip(known, probs, strict=True):
                best = int(p[: len(network.langs)].argmax())
                langs[i], scores[i] = network.langs[best], min(1.0, float(p[best]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(langs, pa.string()), pa.array(scores)],
            names=["id", "lang_pred", "score"],
        )

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_arrow(ids, each, f"id {column_type(ids, 'id')}, lang_pred string, score double", rows=256)
    return out.withColumnRenamed("id", id_col)
