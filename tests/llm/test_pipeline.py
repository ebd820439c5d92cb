"""Each stage of the pipeline against a brute-force version on a small fixture, and the whole on the smallest tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerframe.llm import bpe
from test_llm_operators import DOCS, brute_classes, documents

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).withColumns({"score": F.lit("own"), "rejected": F.lit("own")})


def test_stages_in_order(spark, docs):
    rows = [tuple(r)[:5] for r in docs.collect()]
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {"own"}
    lettered = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    assert kept.count() == len(lettered)
    unique = corpus_pipeline.drop_exact_copies(spark, kept, "")
    assert unique.columns == docs.columns
    assert unique.count() == len({re.sub(r"[\x20\x09-\x0D]", "", r[1]) for r in lettered})
    classes = brute_classes([tuple(r)[:5] for r in unique.collect()])
    near = corpus_pipeline.drop_near_copies(spark, unique, "")
    assert near.columns == docs.columns and near.count() == len(classes)
    assert {r["doc_id"] for r in near.collect()} == {next((x for null, x in c if not null), None) for c in classes}
    mixed = corpus_pipeline.mix_sources(spark, near, "")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in near.collect()}
    texts = {r["doc_id"]: r["text"] for r in near.collect()}
    t = bpe.load(bpe.vocabulary_path())
    done = corpus_pipeline.encode(spark, mixed, "").collect()
    assert len(done) == mixed.count()
    assert all(r["ids"] == t.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) for r in done)


def test_empty_input(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_whole_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and out.filter("n_tokens <> size(ids)").count() == 0
