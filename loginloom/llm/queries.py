"""The queries opN_<name>: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, importance, merkle, minhash, mixing, ngram_join, quality, sharding, suffix_dedup, token_tree, topk, url_filter
from .common import table


def op1_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=16)
    law = F.lit("bytes").alias("law")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), cache=240_000_000)


def op3_branch_and_bound_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("mix_size").alias("size"), "source", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.size("mix_places") * F.col("mix_size")).alias("taken"), F.col("mix_places").alias("shards"), mixing.orders().alias("shard_orders"))


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op7_link_graph_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("dedup_bytes", 256).alias("kept_sha256"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op9_attention_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = quality.score(docs, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op10_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of each text, of any length (a replacement, an insertion, a deletion at the end), counted from its kept tree."""
    trees = token_tree.build(table(spark, sf_dir, "documents"))
    n = F.col("n_chars")
    quarter, half = F.floor(n / 4), F.floor(n / 2)
    spans = [(quarter, F.least(quarter + 7, half), F.lit(" re-edited")), (half, half, F.lit("2024's ")), (n - F.floor(n / 10), n, F.lit(""))]
    edits = F.array(*[F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), t.alias("text")) for a, b, t in spans])
    return token_tree.recount(trees.withColumn("edits", edits)).select("doc_id", "n_tokens", "n_tokens_edited", "n_chars", "n_chars_reencoded")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024.0, dimensions=64, salt="3")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, percent=5, least_words=20, seed=42)
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_min_cost_resharding": op1_min_cost_resharding,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_branch_and_bound_topk": op3_branch_and_bound_topk,
    "op4_source_mixing": op4_source_mixing,
    "op6_merkle_fingerprints": op6_merkle_fingerprints,
}

QUERIES["op7_link_graph_url_filter"] = op7_link_graph_url_filter
QUERIES["op5_suffix_array_dedup"] = op5_suffix_array_dedup
QUERIES["op8_ngram_jaccard_join"] = op8_ngram_jaccard_join
QUERIES["op9_attention_mil_quality"] = op9_attention_mil_quality
QUERIES["op10_edit_aware_token_counts"] = op10_edit_aware_token_counts
QUERIES["op11_centroid_clustering"] = op11_centroid_clustering
QUERIES["op12_importance_resampling"] = op12_importance_resampling
QUERIES["op13_minhash_near_dedup"] = op13_minhash_near_dedup


def _near_sql(words: int, columns: str) -> str:
    """Links of the sets of `words`-word shingles by an exact join, and the least doc_id that they reach."""
    return rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ),
        s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {words} THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - {words - 2}), lambda i: array_to_string(words[i:i + {words - 1}], ' '))) END AS items FROM w
        ),
        flat AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s),
        pair AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.item = b.item AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ),
        reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM s
            UNION
            SELECT r.doc_id, p.b FROM reach r JOIN pair p ON p.a = r.other
        )
        SELECT s.doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles, min(r.other) AS component_id{columns} FROM s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.items
    """


ORACLE_SQL: dict[str, str] = {
    "op3_branch_and_bound_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
    """,
    "op8_ngram_jaccard_join": _near_sql(5, ""),
    "op13_minhash_near_dedup": _near_sql(4, ", s.doc_id = min(r.other) AS kept"),
    "op11_centroid_clustering": centroids.sql(k=8, rounds=10, scale=1024, dimensions=64, salt="3"),
    "op12_importance_resampling": importance.sql(buckets=10_000, percent=5, least_words=20, seed=42),
    "op5_suffix_array_dedup": """
        WITH t AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
        ),
        piece AS (SELECT doc_id, n, h, unnest(range(0, n - 99, 400)) AS base FROM t WHERE n >= 100),
        short AS (SELECT doc_id, base, least(400, n - 99 - base) AS places, substr(h, 2 * base + 1, 998) AS h FROM piece),
        place AS (SELECT doc_id, base, h, unnest(range(0, places)) AS k FROM short),
        w AS (SELECT doc_id, base + k AS i, substr(h, 2 * k + 1, 200) AS s FROM place),
        late AS (
            SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
        ),
        starts AS (
            SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM late
        ),
        numbered AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts),
        runs AS (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM numbered GROUP BY ALL),
        gaps AS (
            SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM runs
            UNION ALL
            SELECT t.doc_id, coalesce(max(hi), 0), any_value(t.n) FROM t LEFT JOIN runs r ON r.doc_id = t.doc_id GROUP BY t.doc_id
        ),
        kept AS (
            SELECT g.doc_id, string_agg(substr(t.h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gaps g JOIN t ON t.doc_id = g.doc_id GROUP BY g.doc_id
        )
        SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, CAST(coalesce(sum(r.hi - r.lo), 0) AS BIGINT) AS n_removed, count(r.run) AS n_spans,
            any_value(sha256(unhex(k.h))) AS kept_sha256
        FROM t LEFT JOIN runs r ON r.doc_id = t.doc_id JOIN kept k ON k.doc_id = t.doc_id GROUP BY t.doc_id, t.n
    """,
}
