"""The pipeline's stages, each against what it was given."""

import inspect

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from voxelloom.llm import common, decontamination, neardup


@pytest.fixture(scope="module")
def outputs(spark, sf):
    docs = common.table(spark, sf, "documents")
    seen = [docs]
    for name, stage in P.STAGES:
        docs = common.durable(stage(spark, docs, sf), f"test-{name}")
        seen.append(docs)
    return seen


def test_shape(spark, sf, outputs):
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, stage in P.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"], name
    for df in outputs[:-1]:
        assert df.columns == outputs[0].columns
    assert outputs[-1].count() == outputs[4].count()


def test_decisions_take_effect(spark, sf, outputs):
    _, good, single, clean, mixed, placed = outputs
    kept = {r["doc_id"] for r in neardup.near_duplicates(good).where("kept").collect()}
    assert {r["doc_id"] for r in single.collect()} == kept
    marked = decontamination.contamination(single, common.table(spark, sf, "benchmark"))
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in marked.where("n_hit = 0").collect()}
    words = F.sum(F.regexp_count("text", F.lit(common.WORD_PATTERN)))
    share = mixed.agg(words).first()[0] / clean.agg(words).first()[0]
    assert 1.3 < share < 1.7
    assert placed.agg(F.max("shard")).first()[0] <= 39


def test_empty_and_odd_documents(spark, sf):
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a few words of plain text", "en", "s", 3), (3, "a few words of plain text", "en", "s", 3)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for docs in (odd, odd.where("false")):
        n = docs.count()
        for name, stage in P.STAGES[1:4]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and (out.count() > 0) == (n > 0), name
        assert P.STAGES[4][1](spark, docs, sf).count() == n


def test_near_dedup_keeps_one_row_of_each_component(spark, sf):
    words = [f"w{i}" for i in range(80)]
    plain, near, other = " ".join(words), " ".join([*words, "end"]), " ".join(f"o{i}" for i in range(60))
    rows = [(1, plain, "en", "a", 1), (1, plain, "en", "a", 1), (1, plain, "en", "b", 1), (1, near, "en", "a", 1), (2, near, "en", "a", 1)]
    rows += [(None, other, "en", "a", 1), (None, other + " end", "en", "a", 1), (None, other, "en", "a", 1)]
    rows += [(3, "alone with few words", "en", "a", 1), (4, None, "en", "a", 1), (4, "", "en", "a", 1), (4, "", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = P.near_dedup_stage(spark, docs, sf)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] or 0, (r["text"] or "")[:2]) for r in out.collect())
    assert got == [(0, "o0"), (1, "w0"), (3, "al"), (4, ""), (4, ""), (4, "")]
