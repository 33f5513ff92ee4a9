"""The pipeline's stages, each against brute force on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import secrets
from tests.llm.test_operators import EDGES, brute_hits, brute_links


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", s, len(t or "")) for d, t, s in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


SF = "/root/testdata/sf0.001"


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.withColumn("row", F.lit(1)), SF)
        assert list(out.columns)[:5] == list(corpus_pipeline.COLUMNS), name
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_duplicates(spark, docs):
    got = kept(corpus_pipeline.near_duplicates(spark, docs, SF))
    links = {d: c for d, c, _ in brute_links([(i, t) for i, (_, t, _) in enumerate(EDGES)])}
    best = {}
    for i, (d, t, _) in enumerate(EDGES):
        key = ((d is None, d or 0, i), (d, t))
        best[links[i]] = min(best.get(links[i], key), key)
    assert got == sorted((row for _, row in best.values()), key=repr)


def test_decontamination(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [(str(i), t) for i, t in items]
    real = spark.read.parquet(f"{SF}/documents.parquet")
    expected = sorted(((r["doc_id"], r["text"]) for r in real.collect() if not brute_hits(r["text"], items)[-1]), key=repr)
    assert kept(corpus_pipeline.decontaminate(spark, real, SF)) == expected


def test_secrets(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.scan_secrets(spark, real, SF).collect()}
    for r in real.collect():
        if secrets.base_spans(r["text"] or ""):
            assert not secrets.base_spans(out[r["doc_id"]].replace("[secret]", " "))


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("taken <= 0 or taken is null").count() == 0
