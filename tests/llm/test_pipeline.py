from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_simhash import brute_components, brute_print
from touchline.session import staged

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_equal_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, "123 !!", None, "s", 6), (-2, None, None, None, None), (-3, "", "en", "s", 0)], docs.schema)
    now = staged(docs.unionByName(odd), "test")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, now, SF), "test")
        counts.append(out.count())
        if name != "packing":
            assert out.columns == docs.columns
        if name == "language":
            # Only what has no letter goes here.
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        if name == "near_duplicates":
            texts = {r.doc_id: brute_print(r.text) for r in now.collect()}
            roots = brute_components(sorted(set(texts.values())), lambda a, b: (a ^ b).bit_count() <= 4)
            least = {}
            for i in sorted(texts):
                least.setdefault(roots[texts[i]], i)
            assert {r.doc_id for r in out.collect()} == set(least.values())
        if name == "mixing":
            assert out.join(now, "doc_id", "left_anti").count() == 0
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in now.collect()}
        now = out
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0
    assert corpus_pipeline.run(spark, SF).select(F.count("doc_id")).first()[0] == counts[3]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "mixing", "packing"]
