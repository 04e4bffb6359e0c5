"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loginloom.llm import bpe, merkle, mixing, ngram_join, quality, sharding, suffix_dedup, token_tree, topk, url_filter

LONG = " ".join(f"w{i}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, LONG, "en", "a", len(LONG)),
    (4, PASSAGE + " one two three", None, "b", 9),
    (5, PASSAGE + " one two three", "de", "b", 9),
    (6, "x" * 5_000, "en", None, 1),
    (7, "   \n\t ", "en", "b", 6),
    (8, "ein Wort", "de", "c", 8),
    (8, "ein Wort", "de", "c", 8),
    (None, "no id at all " + PASSAGE, "en", "c", 4),
    (9, "The end. " * 40, "en", "c", 360),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["size", "n", "node", "token", "block", "shard", "version", "doc", "key", "spans", "target", "copies", "component", "label", "quality", "piece"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASHES:
        rows = rows.withColumn(c, F.lit("clash"))
    return rows


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 1, None), (9, 0, 0), (None, 1, 0), (8, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "sharding": (lambda d: sharding.assign(d), len(ROWS)),
    "bpe": (lambda d: bpe.encode(d), len(ROWS)),
    "mixing": (lambda d: mixing.mix(d), len(ROWS)),
    "suffix_dedup": (lambda d: suffix_dedup.remove(d), len(ROWS)),
    "merkle": (lambda d: merkle.fingerprints(d), len(ROWS)),
    "ngram_join": (lambda d: ngram_join.classes(d), len(ROWS)),
    "token_tree": (lambda d: token_tree.build(d), len(ROWS)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_gets_a_result(docs, name):
    run, n = OPERATORS[name]
    assert len(run(docs).collect()) == n


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, name):
    assert OPERATORS[name][0](docs.limit(0)).collect() == []


def test_quality_edges(docs, labels):
    found = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(found) == len(ROWS) and all(0 <= r.quality_score <= 1 for r in found)
    assert all(r.quality_score == 0.5 for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect())
    assert quality.score(docs.limit(0), None).collect() == []


def test_topk_edges(spark):
    rows = [(0, [1.0, 2.0]), (20, [2.0, None]), (40, None), (60, [float("nan"), 1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, []), (None, [1.0, 1.0]), (80, [float("inf"), 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("score", F.lit(1))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(vectors, scale=1.0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 5), (0, 2, 1, 5), (0, 3, 2, 0)]
    assert topk.top_k(vectors.limit(0)).collect() == []
    huge = spark.createDataFrame([(0, [3e7, 1.0]), (1, [3e7, 2.0]), (2, [-3e7, 1.0])], "vec_id long, embedding array<double>")
    assert [r.score for r in topk.top_k(huge, scale=1.0).orderBy("rank").collect()] == [900000000000002, -899999999999999]


def test_url_edges(spark):
    rows = [(1, None, None), (2, "no scheme", "<a href='//x.org/'>"), (3, "HTTP://A.Example.NET/en/x?q#f", None), (4, "http://example.net", ""), (4, "http://example.net", ""), (None, "http://q.org/fr/", "x" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.net", "/en/x", "example.net/en/", "allow"), (4, "example.net", "", None, "allow"), (None, "q.org", "/fr/", "org/fr/", "allow")}
    assert url_filter.judge(pages.limit(0)).collect() == []


def test_pipeline_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, plain.limit(0), str(tmp_path)).columns == plain.columns, name
        assert stage(spark, plain.limit(0), str(tmp_path)).collect() == []
        assert stage(spark, plain, str(tmp_path)).columns == plain.columns
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, plain, str(tmp_path)).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(8) == 1 and 4 in ids and 5 not in ids and {1, 2, 7} <= set(ids)
    cut = {r.doc_id: r.text for r in corpus_pipeline.remove_repeated_substrings(spark, plain.filter("doc_id IN (4, 5, 8)"), str(tmp_path)).collect()}
    assert cut[4] == ROWS[3][1] and 5 not in cut and cut[8] == "ein Wort"
