"""The pipeline's stages, one after the other, against plain decisions."""

import re

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wellspan.llm import secret_scan
from wellspan.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), {}
    found["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = found[name] = materialize(stage(spark, docs, SF), name)
    return found


def test_columns_and_rows(stages):
    kept = stages["documents"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == kept.columns and stages[name].count() <= kept.count()
    assert set(stages["best_fit_packing"].select("doc_id").distinct().toPandas().doc_id) == set(stages["secret_scan"].toPandas().doc_id)


def test_documents_with_letters_stay_after_language(stages):
    gone = stages["documents"].join(stages["language_id"], "doc_id", "left_anti").collect()
    assert all(not re.search(r"[^\W\d_]", d.text or "") for d in gone)


def test_no_link_is_left_after_near_copies(stages):
    from test_text_operators import plain_join

    rows = [(r.doc_id, r.text) for r in stages["ngram_jaccard"].collect()]
    assert all(component == i for i, (_, component) in plain_join(rows).items())
    before = plain_join([(r.doc_id, r.text) for r in stages["toxicity"].collect()])
    assert {i for i, _ in rows} == {i for i, (_, component) in before.items() if component == i}


def test_no_base_secret_is_left(stages):
    words = secret_scan.read_dictionary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for r in stages["secret_scan"].collect():
        assert r.n_chars == len(r.text)
        assert not [s for s in secret_scan.scan(r.text, words, 40.0) if s[0] in ("access", "hex")]


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32")
    want = stages["best_fit_packing"].select(got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_empty_and_odd_documents(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the same few words again", "en", "s", 24), (4, "the same few words again", "en", "s", 24)], docs.schema))
    for start in (docs.limit(0), odd.withColumn("score", F.lit(1)).withColumn("secrets", F.lit("x"))):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = materialize(stage(spark, now, SF), name)
        assert {r.doc_id for r in now.collect()} <= {3}
