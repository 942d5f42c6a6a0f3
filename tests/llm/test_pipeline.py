"""The pipeline against plain versions of its decisions, on small documents."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import bpe, langid, minhash, mixing, quality
from factloom.llm.queries import bpe_path


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        folder = str(tmp_path_factory.mktemp(name))
        stage(spark, docs, sf).write.mode("overwrite").parquet(folder)
        docs = spark.read.parquet(folder)
        out.append(docs)
    return out


def test_stages_are_the_operators_decisions(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.op3(docs).collect()}
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(stages[0]) == sorted(i for i, (lang, s) in rows.items() if lang != "und" and s >= langid.LEAST_SCORE)
    good = quality.op8(stages[0], spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1")
    assert ids(stages[1]) == ids(good)
    assert ids(stages[2]) == ids(minhash.op1(stages[1]).where("kept"))
    taken = {r["doc_id"]: r["copies"] for r in mixing.op5(stages[2]).collect() if r["copies"]}
    assert dict(collections.Counter(ids(stages[3]))) == taken
    assert ids(stages[4]) == ids(stages[3])
    assert all(s.columns == docs.columns for s in stages[:4])


def test_last_stage_round_trips(spark, stages):
    texts = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    b = bpe.tokenizer(bpe_path())
    for r in stages[4].collect():
        assert b.encode([texts[r["doc_id"]]])[0].tolist() == list(r["ids"]) and len(r["ids"]) == r["n_tokens"]


def test_run_equals_the_stages(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[4].collect()))


def test_odd_documents_pass_through(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "", 0), (3, "plain words of a small text here", "en", None, 5), (3, "plain words of a small text here", "en", None, 5), (None, "no id but words of some kind", "en", "s", 1), (4, "w " * 60_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, str(tmp_path)).columns == docs.columns
            stage(spark, df, str(tmp_path)).count()
        coded = corpus_pipeline.bpe_encoding(spark, df, str(tmp_path))
        assert coded.count() == df.count()
