"""Nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from voxelloom.llm import (
    decontamination, langid, lm, mixing, neardup, quality, sharding, tokencounts, toxicity, vectorsearch,
)

CLASHING = ["size", "k", "bucket", "score", "node", "label", "words", "text_key", "taken", "shard", "slot", "n", "key", "_text"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def _odd_rows():
    plain = "the quick brown fox jumps over the lazy dog and then runs away from the barn"
    rows = [(i, f"{plain} number {i} told {i * 7}", "en", f"s{i % 3}", 1) for i in range(12)]
    rows += [(100 + i, "una casa blanca en la colina verde con flores y " + "sol " * (i + 1), "es", "s1", 1) for i in range(8)]
    rows += [(200, None, None, None, None), (201, "", "en", "", 0), (202, " \t\n", "en", "s1", 3), (203, "!!! 123", "es", None, 7)]
    rows += [(204, "word " * 60_000, "en", "s2", 300_000), (205, "x" * 200_000, None, "s2", 200_000)]
    rows += [(206, plain, "en", "s0", 5), (206, plain, "en", "s0", 5), (207, plain, "en", "s0", 5), (None, plain, "en", "s0", 5)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(_odd_rows(), DOCS)
    return docs.withColumns({c: F.lit(1) for c in CLASHING})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1, 0) for i in range(12)] + [(100 + i, 0, 1) for i in range(8)] + [(None, 1, 1), (200, None, None), (206, 1, 0), (206, 1, 0)]
    return spark.createDataFrame(rows, LABELS).withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def items(spark):
    text = "quick brown fox jumps over the lazy dog and then runs"
    rows = [(1, text), (2, None), (3, ""), (None, text), (4, "blanca en"), (5, "word"), (5, "never seen here")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("size", F.lit(0))


def test_mixing(odd, none):
    rows = mixing.plan_mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by_source = {}
    for r in rows:
        t = by_source.setdefault(r["source"], [r["target"], 0, r["source_size"]])
        t[1] += r["taken"]
    assert all(abs(t - round(target)) <= 1 for target, t, _ in by_source.values())
    assert abs(sum(t[0] for t in by_source.values()) - 1.5 * sum(t[2] for t in by_source.values())) < 1e-3
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan_mix(odd).collect()))
    assert mixing.plan_mix(none).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixing.mix(none).count() == 0


def test_sharding(odd, none):
    rows = sharding.assign_shards(odd).collect()
    assert len(rows) == odd.count()
    for s in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    copies = {r["shard"] for r in rows if r["doc_id"] in (206, 207, None)}
    assert len(copies) == 1
    assert [r["size"] for r in rows if r["doc_id"] == 200] == [16]
    assert sharding.assign_shards(none).count() == 0


def test_decontamination(odd, none, items):
    found = {}
    for r in decontamination.contamination(odd, items).collect():
        found.setdefault(r["doc_id"], r)
    assert found[0]["n_hit"] == 11 and found[0]["item_ids"] == ["1"]
    assert found[100]["n_hit"] == 2 and found[100]["item_ids"] == ["4"]
    assert found[204]["n_hit"] == 60_000 and found[204]["item_ids"] == ["5"]
    assert found[200]["n_words"] == 0 and found[201]["n_hit"] == 0
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.contamination(odd, items.where("false")).where("n_hit > 0").count() == 0
    kept = decontamination.remove_contaminated(odd, items)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {200, 201, 202, 203, 205}


def test_neardup(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[207]["component_id"] == by[206]["component_id"] == by[None]["component_id"] == 206
    assert by[200]["n_shingles"] == 0 and by[200]["kept"] and by[201]["component_id"] == 201
    assert by[204]["n_shingles"] == 1 and by[205]["n_shingles"] == 1
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.remove_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 207").count() == 0


def test_quality(odd, none, labels):
    rows = quality.score_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score_quality(none, labels).count() == 0
    assert {r["score"] for r in quality.score_quality(odd, labels.where("false")).collect()} == {0.5}
    only = quality.score_quality(odd, labels.where("quality = 1")).collect()
    assert len({r["score"] for r in only}) == 1 and 0.5 < only[0]["score"] < 1
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_columns_of_other_types_with_clashing_names(spark, odd, labels):
    """Names the operators use inside, as arrays, structs and texts."""
    kinds = [F.array(F.lit(1)), F.struct(F.lit(1).alias("a")), F.lit("x"), F.lit(2.5)]
    names = ["label", "node", "regs", "first", "hot", "key", "start", "shift", "uid", "h", "n", "size", "bucket", "_text"]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", *[kinds[i % 4].alias(c) for i, c in enumerate(names)])
    docs = docs.where("doc_id < 110 OR doc_id > 205 OR doc_id IS NULL")
    n = docs.count()
    assert neardup.near_duplicates(docs).count() == lm.score_texts(docs).count() == sharding.assign_shards(docs).count() == n
    assert quality.score_quality(docs, labels).count() == mixing.plan_mix(docs).count() == langid.identify_languages(docs).count() == n
    kept = neardup.remove_near_duplicates(docs.drop("first"))
    assert kept.columns == docs.drop("first").columns and 0 < kept.count() < n


def test_quality_stage_on_odd_and_empty_tables(spark, sf, odd, none):
    import corpus_pipeline

    kept = corpus_pipeline.quality_stage(spark, odd, sf)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert corpus_pipeline.quality_stage(spark, none, sf).count() == 0


def test_sharding_of_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, text string")
    rows = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.assign_shards(docs).collect()}
    assert rows == {1: (16, None), 2: (16, 0), 3: (17, 3904355907)}


def test_language_ties(spark):
    text = "one and the same words in every tongue that there is"
    docs = spark.createDataFrame([(i, text, lang) for i in range(40) for lang in ("bb", "aa")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["rejected"]) for r in langid.identify_languages(docs).collect()} == {("aa", True)}


def test_toxicity(odd, none, labels):
    rows = toxicity.score_toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(odd, labels.where("false")).collect()} == {0.5}


def test_langid(odd, none):
    found = {r["doc_id"]: r for r in langid.identify_languages(odd).collect()}
    assert found[0]["lang_pred"] == "en" and found[100]["lang_pred"] == "es"
    assert found[200]["lang_pred"] == found[201]["lang_pred"] == found[203]["lang_pred"] == "und"
    assert found[200]["score"] == 0 and found[204]["lang_pred"] in ("en", "es")
    assert langid.identify_languages(none).count() == 0
    unknown = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify_languages(unknown).collect()} == {"und"}


def test_lm(odd, none):
    rows = {r["doc_id"]: r for r in lm.score_texts(odd).collect()}
    assert rows[200]["n_tokens"] == rows[201]["n_tokens"] == rows[202]["n_tokens"] == 1
    assert rows[204]["n_tokens"] == 60_001 and rows[205]["n_tokens"] == 2
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in rows.values())
    assert lm.score_texts(none).count() == 0
    lone = lm.score_texts(odd.where("doc_id = 200")).collect()
    assert len(lone) == 1


def test_tokencounts(odd, none):
    rows = {(r["source"], r["lang"], r["tokenizer"]): r for r in tokencounts.rollup_documents(odd).collect()}
    assert rows[(None, None, "words@1")]["docs"] == 1 and rows[(None, None, "words@1")]["tokens"] == 0
    assert sum(r["docs"] for r in rows.values()) == 2 * odd.count()
    assert tokencounts.rollup_documents(none).count() == 0


def test_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (100, []), (None, [1.0, 1.0])]
    rows += [(i, [1.0, 2.0]) for i in (1, 2, 3, 3)] + [(120, [3.0, 1.0, 1.0]), (140, [1e12, -1e12])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "score", "rank", "unit")})
    found = {}
    for r in vectorsearch.top_k(v, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {0, 100, 120, 140}
    # 64 * (1, 2): inner product 5 * 4096 for copies, 5 for (3, 1, 1), -1e12 for the long one
    assert [x[1] for x in sorted(found[0])] == [1, 2, 3, 3, 120, 100, 140]
    assert sorted(found[0])[0][2] == 5 * 4096
    assert vectorsearch.top_k(v.where("false"), F.col("vec_id") % 20 == 0).count() == 0
