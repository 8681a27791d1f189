import numpy as np
from pyspark.sql import functions as F

from touchline.llm import language
from touchline.llm.language import Network, Settings, keep_identified, learn, predict
from touchline.llm.queries import op6_language

SF = "/root/testdata/sf0.001"
SMALL = Settings(hidden=3, window=5, steps=1, batch=4, docs_per_lang=20)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = Network(["a", "b", "c"], SMALL)
    net.weights = [w.astype(np.float64) for w in net.weights]
    x = rng.integers(0, 6, (5, 4)).astype(np.int16)
    x[4, 1] = language._PAD
    target = rng.standard_normal((5, 3, 4))
    table, u, b = net.weights[:3]

    def value():
        return float((language._gru(table, u, b, x)[0].astype(np.float64) * target).sum())

    d = language._gru_back(u, x, language._gru(table, u, b, x, keep=True)[1], target)
    for w, g in zip((table, u, b), d, strict=True):
        for place in [(0, 0), (2, 1 % w.shape[1]), (w.shape[0] - 1, w.shape[1] - 1)]:
            old = w[place]
            w[place] = old + 1e-2
            up = value()
            w[place] = old - 1e-2
            down = value()
            w[place] = old
            assert abs((up - down) / 2e-2 - g[place]) < 2e-3


def test_windows_cover_whole_texts():
    texts = [b"", b"abc", bytes(range(256)) * 3, b"12345"]
    got = {}
    for symbols, owner in language._windows(texts, 5, 7):
        for column, i in zip(symbols.T, owner, strict=True):
            got[i] = got.get(i, b"") + bytes(int(s) for s in column if s != language._PAD)
    assert got == {i: t for i, t in enumerate(texts) if t}


def test_held_out_accuracy(spark):
    rows = op6_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joined = rows.join(docs, "doc_id").where("held_out and length(text) > 100")
    right, n, low, high = joined.agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")
    ).first()
    assert n > 200 and right > 0.95 and 0 <= low <= high <= 1
    assert rows.count() == docs.count()


def test_odd_rows(spark):
    rows = [(1, "und so weiter und so fort " * 9, "de", 1), (2, "the one and the other " * 9, "en", 1),
            (None, None, "en", 1), (3, "", "xx", 1), (3, "12 34 !?", None, 1), (4, "é" * 50_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    net = learn(docs, Settings(steps=40))
    assert net.langs == ["de", "en"]
    got = predict(docs, net).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    assert [r.lang_pred for r in got[:2]] == ["de", "en"]
    assert [(r.lang_pred, r.score) for r in got[2:5]] == [("und", 0.0)] * 3
    assert got[5].lang_pred in net.langs
    assert learn(docs.limit(0)) is None and learn(docs.where("lang is null")) is None
    assert {r.lang_pred for r in predict(docs, None).collect()} == {"und"}
    assert predict(docs.limit(0), net).collect() == []


def test_prediction_uses_text_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = learn(docs, Settings(steps=20))
    plain = predict(docs, net).orderBy("doc_id").collect()
    other = predict(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("s")), net).orderBy("doc_id").collect()
    assert plain == other


def test_without_background_only_letterless_texts_go(spark):
    rows = [(1, "Und so."), (2, "12 34"), (3, None), (4, ""), (None, "und so weiter " * 20), (None, "und so weiter " * 20)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    for net in (None, Network(["a", "b"], Settings())):
        kept = keep_identified(docs, net)
        assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "None", "None"] and kept.columns == docs.columns
        assert keep_identified(docs.limit(0), net).collect() == []


def test_learns_from_rows_without_ids(spark):
    rows = [(None, f"{i} und so weiter und so fort", "de") for i in range(2000)]
    rows += [(7, f"{i} the one and the other", "en") for i in range(2000)] + [(7, "y lo uno y lo otro", "es")] * 900
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert learn(docs, Settings(steps=1, docs_per_lang=50)).langs == ["de", "en", "es"]
    assert learn(docs, Settings(steps=1, docs_per_lang=50, most_langs=2)).langs == ["de", "en"]


def test_background_rejects_unlearned_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 0")
    for langs in (["de", "en", "fr"], ["de"]):
        net = learn(docs.where(F.col("lang").isin(langs)), background=True)
        assert net.langs == langs
        learned = docs.where(F.col("lang").isin(langs) & F.col("text").rlike(r"\p{L}"))
        # Whole texts, and their first words.
        for text in (F.col("text"), F.substring("text", 1, 70)):
            cut = learned.select("doc_id", text.alias("text"))
            assert keep_identified(cut, net).count() >= 0.99 * cut.where(F.col("text").rlike(r"\p{L}")).count()
        other = docs.where("lang = 'es' and length(text) >= 200")
        assert keep_identified(other, net).count() <= 0.05 * other.count()
        odd = [(i, t * k) for i, t in enumerate(["你好世界", "привет мир ", "xqzk vjwq zzkx qpwj "]) for k in (8, 90)]
        assert keep_identified(spark.createDataFrame(odd, "doc_id long, text string"), net).count() == 0
