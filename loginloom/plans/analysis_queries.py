"""Registered queries of graph work and evaluation, each with the SQL that it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, graph, uncertainty
from .detection_queries import SCORE_CTE, rounded, scored
from .fixtures import DENSE_SQL, SPARSE_SQL, auth_dense, auth_sparse

QUERIES, ORACLE_SQL = {}, {}


def registered(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---- graph ----------------------------------------------------------------------------------------------------------

ALERT_RISK = 0.85
ALERTS_CTE = f"{DENSE_SQL}{SCORE_CTE}, a AS (SELECT event_id, t, usr, src, dst, round(risk, 6) AS risk, is_new_pair AS is_new, support, label FROM s WHERE round(risk, 6) >= {ALERT_RISK})"


def alerts(spark: SparkSession, sf_dir: str, least: float = ALERT_RISK) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("risk", F.round("risk", 6)).filter(F.col("risk") >= least)
    return rows.select("event_id", "t", "usr", "src", "dst", "risk", F.col("is_new_pair").alias("is_new"), "support", "label")


@registered("f01_temporal_edges", f"{DENSE_SQL} SELECT event_id, t, 'user:' || usr AS source, 'host:' || dst AS destination, 'host:' || src AS origin, success, label FROM e")
def f01(spark, sf_dir):
    return graph.temporal_edges(auth_dense(spark, sf_dir))


@registered(
    "f02_recent_neighbors",
    f"""{DENSE_SQL}, n AS (SELECT event_id, t, usr, dst, row_number() OVER (PARTITION BY usr ORDER BY t, event_id) AS n,
        count(*) OVER (PARTITION BY usr ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_n FROM e)
    SELECT a.event_id, count(b.n) AS n_neighbors, coalesce(string_agg(b.dst::VARCHAR, ',' ORDER BY b.n DESC), '') AS neighbors
    FROM n a LEFT JOIN n b ON b.usr = a.usr AND b.n <= a.before_n AND b.n > a.before_n - 20 GROUP BY a.event_id""",
)
def f02(spark, sf_dir):
    return graph.recent_neighbors(auth_dense(spark, sf_dir))


PATHS_CTE = (
    ALERTS_CTE
    + """, p(events, hosts, first_t, last_t, at_host, risks, news, supports, n) AS (
    SELECT [event_id], [src, dst], t, t, dst, risk, is_new, support, 1 FROM a
    UNION ALL
    SELECT list_append(p.events, a.event_id), list_append(p.hosts, a.dst), p.first_t, a.t, a.dst, p.risks + a.risk, p.news + a.is_new, p.supports + a.support, p.n + 1
    FROM p JOIN a ON a.src = p.at_host AND a.t > p.last_t AND a.t <= p.last_t + 1800 AND NOT list_contains(p.hosts, a.dst) WHERE p.n < 3
), scored_paths AS (SELECT array_to_string(events, '-') AS path, events, first_t, last_t, n AS n_edges,
    round(0.55::DOUBLE * risks / n + 0.20::DOUBLE * news / n + 0.15::DOUBLE * (n - 1) / n + 0.10::DOUBLE * least(1.0::DOUBLE, supports / n::DOUBLE / 3), 6) AS score FROM p WHERE n > 1)"""
)


@registered(
    "f06_attack_graph",
    f"""{ALERTS_CTE}, r AS (SELECT event_id, risk, 'user' AS kind, usr AS id FROM a UNION ALL SELECT event_id, risk, 'host', src FROM a UNION ALL SELECT event_id, risk, 'host', dst FROM a)
    SELECT 'node' AS part, kind, id::VARCHAR AS a, '' AS b, count(DISTINCT event_id) AS n_alerts, max(risk) AS max_risk FROM r GROUP BY kind, id
    UNION ALL SELECT 'edge', 'session', 'user:' || usr, 'host:' || src, count(*), max(risk) FROM a GROUP BY usr, src
    UNION ALL SELECT 'edge', 'auth', 'host:' || src, 'host:' || dst, count(*), max(risk) FROM a GROUP BY src, dst""",
)
def f06(spark, sf_dir):
    nodes, edges = graph.attack_graph(alerts(spark, sf_dir))
    left = nodes.select(F.lit("node").alias("part"), "kind", F.col("id").cast("string").alias("a"), F.lit("").alias("b"), "n_alerts", "max_risk")
    return left.union(edges.select(F.lit("edge"), "kind", "a", "b", "n_alerts", "max_risk"))


@registered(
    "f07_entity_risk",
    f"""{ALERTS_CTE}, r AS (SELECT 'user' AS kind, usr AS id, 'dst:' || dst AS other, t, risk FROM a UNION ALL SELECT 'source', src, 'dst:' || dst, t, risk FROM a UNION ALL SELECT 'destination', dst, 'usr:' || usr, t, risk FROM a),
    m AS (SELECT kind, id, sum(risk * pow(0.5, ((SELECT max(t) FROM a) - t) / 3600.0::DOUBLE)) AS mass, count(DISTINCT other) AS others, count(*) AS n_alerts FROM r GROUP BY kind, id)
    SELECT kind, id, round(0.7::DOUBLE * (1 - exp(-mass)) + 0.3::DOUBLE * least(1.0::DOUBLE, others / 8.0::DOUBLE), 6) AS score, others, n_alerts FROM m ORDER BY score DESC, kind, id LIMIT 50""",
)
def f07(spark, sf_dir):
    return graph.entity_risk(alerts(spark, sf_dir))


@registered("f12_alert_hops", f"{ALERTS_CTE} SELECT event_id, t, risk, 0 AS hop, 'usr:' || usr AS actor, 'src:' || src AS target FROM a UNION ALL SELECT event_id, t, risk, 1, 'src:' || src, 'dst:' || dst FROM a")
def f12(spark, sf_dir):
    return graph.alert_hops(alerts(spark, sf_dir))


def incident_hops(spark, sf_dir):
    """The hops of each account's incidents, hosts under one name whether left or reached."""
    return graph.incidents(alerts(spark, sf_dir)).select("incident", "event_id", "t", F.lit(1).alias("hop"), F.concat(F.lit("host:"), "src").alias("actor"), F.concat(F.lit("host:"), "dst").alias("target"), "risk")


@registered("f10_kill_chain")
def f10(spark, sf_dir):
    """Layers and longest chains of each incident's hops."""
    return graph.kill_chain(incident_hops(spark, sf_dir))


@registered("f11_kill_chain_primary")
def f11(spark, sf_dir):
    return rounded(graph.kill_chain_primary(incident_hops(spark, sf_dir)), "incident", "place", "event_id", "actor", "target", "length", "total")


@registered(
    "f13_similar_entities",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(c.e, q.e) / c.norm / q.norm, 6) AS similarity FROM n c JOIN n q ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND q.norm > 0 AND c.norm > 0)
    SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, similarity FROM p WHERE similarity >= 0 WINDOW w AS (PARTITION BY query_id ORDER BY similarity DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
)
def f13(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return graph.similar(vectors, vectors.filter("vec_id % 50 = 0"))


@registered(
    "f15_entity_profile",
    f"""{SPARSE_SQL}, h AS (SELECT usr, (t % 86400) // 3600 AS hour, count(*) AS n FROM e GROUP BY ALL), b AS (SELECT usr, hour AS busiest_hour FROM h QUALIFY row_number() OVER (PARTITION BY usr ORDER BY n DESC, hour) = 1)
    SELECT e.usr, count(*) AS n, count(DISTINCT dst) AS n_dst, count(DISTINCT src) AS n_src, CAST(sum(1 - success) AS BIGINT) AS failures, any_value(busiest_hour) AS busiest_hour FROM e JOIN b ON b.usr = e.usr GROUP BY e.usr""",
)
def f15(spark, sf_dir):
    return graph.entity_profile(auth_sparse(spark, sf_dir))


# ---- evaluation -----------------------------------------------------------------------------------------------------

SCORES_CTE = f"{SPARSE_SQL}, x AS (SELECT event_id, t, usr, src, label, ((event_id * 7919 + usr * 31) % 1000 + label * 200) / 1200.0::DOUBLE AS score FROM e)"
BLOCKS_CTE = f"""{SCORES_CTE}, b AS (SELECT score, sum(label) AS n_pos, sum(1 - label) AS n_neg FROM x GROUP BY score),
    c AS (SELECT *, sum(n_pos) OVER w AS cum_pos, sum(n_neg) OVER w AS cum_neg FROM b WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled score table with ties, by integer arithmetic on the events."""
    score = ((F.col("event_id") * 7919 + F.col("usr") * 31) % 1000 + F.col("label") * 200) / F.lit(1200.0)
    return auth_sparse(spark, sf_dir).select("event_id", "t", "usr", "src", "label", score.alias("score"))


def blocks(spark, sf_dir):
    return evaluation.block_table(scores(spark, sf_dir))


@registered(
    "i01_chronological_split",
    f"""{SPARSE_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY t, event_id) - 1 AS p, count(*) OVER () AS n FROM e), k AS (SELECT max(t) FILTER (p = floor(n * 0.70)::BIGINT - 1) AS c1, max(t) FILTER (p = floor(n * 0.85)::BIGINT - 1) AS c2 FROM n)
    SELECT event_id, CASE WHEN t <= c1 THEN 'train' WHEN t <= c2 THEN 'validation' ELSE 'test' END AS partition FROM e, k""",
)
def i01(spark, sf_dir):
    return evaluation.chronological_split(auth_sparse(spark, sf_dir)).select("event_id", "partition")


@registered("i02_average_precision", f"{BLOCKS_CTE} SELECT round(sum(n_pos * cum_pos / (cum_pos + cum_neg)::DOUBLE) / sum(n_pos), 6) AS average_precision FROM c")
def i02(spark, sf_dir):
    return rounded(evaluation.average_precision(blocks(spark, sf_dir)), "average_precision")


@registered("i03_roc_auc", f"{BLOCKS_CTE} SELECT round(1 - sum(n_pos * (0.5::DOUBLE * n_neg + cum_neg - n_neg)) / (sum(n_pos) * sum(n_neg)), 6) AS roc_auc FROM c")
def i03(spark, sf_dir):
    return rounded(evaluation.roc_auc(blocks(spark, sf_dir)), "roc_auc")


@registered("i04_recall_precision_at_k", f"{SCORES_CTE}, k AS (SELECT * FROM x ORDER BY score DESC, label LIMIT 200) SELECT round(sum(label) / (SELECT sum(label) FROM x)::DOUBLE, 6) AS recall, round(sum(label) / count(*)::DOUBLE, 6) AS precision FROM k")
def i04(spark, sf_dir):
    return rounded(evaluation.at_k(scores(spark, sf_dir), 200), "recall", "precision")


@registered("i05_threshold_at_budget", f"{SCORES_CTE}, n AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n FROM x WHERE label = 0) SELECT round(min(score), 6) AS threshold FROM n WHERE r <= greatest(1, floor(n * 25 / 10000.0)::BIGINT)")
def i05(spark, sf_dir):
    return rounded(evaluation.threshold_at_budget(scores(spark, sf_dir), 25), "threshold")


@registered("i06_select_threshold", f"{BLOCKS_CTE} SELECT round(min(score), 6) AS threshold FROM c WHERE cum_neg <= floor((SELECT sum(n_neg) FROM b) * 25 / 10000.0)")
def i06(spark, sf_dir):
    return rounded(evaluation.select_threshold(blocks(spark, sf_dir), 25), "threshold")


@registered("i07_operating_point", f"{SCORES_CTE} SELECT count(*) FILTER (score >= 0.8) AS alerts, count(*) FILTER (score >= 0.8 AND label = 1) AS tp, count(*) FILTER (score >= 0.8 AND label = 0) AS fp, round(count(*) FILTER (score >= 0.8 AND label = 1) / sum(label)::DOUBLE, 6) AS recall, round(count(*) FILTER (score >= 0.8 AND label = 1) / count(*) FILTER (score >= 0.8)::DOUBLE, 6) AS precision, round(count(*) FILTER (score >= 0.8 AND label = 0) * 10000 / count(*)::DOUBLE, 6) AS fp_per_10k FROM x")
def i07(spark, sf_dir):
    return rounded(evaluation.operating_point(scores(spark, sf_dir), 0.8), "alerts", "tp", "fp", "recall", "precision", "fp_per_10k")


@registered("i08_brier_score", f"{SCORES_CTE} SELECT round(avg((score - label) * (score - label)), 6) AS brier FROM x")
def i08(spark, sf_dir):
    return rounded(evaluation.brier(scores(spark, sf_dir)), "brier")


@registered("i09_lift", f"{SCORES_CTE}, z AS (SELECT avg((score >= 0.8)::INTEGER::DOUBLE) FILTER (label = 1) AS recall, avg((score >= 0.8)::INTEGER::DOUBLE) FILTER (label = 0) AS benign_rate FROM x) SELECT round(recall, 6) AS recall, round(benign_rate, 6) AS benign_rate, round(recall / benign_rate, 6) AS lift FROM z")
def i09(spark, sf_dir):
    return rounded(evaluation.lift(scores(spark, sf_dir).select("label", (F.col("score") >= 0.8).cast("int").alias("fired"))), "recall", "benign_rate", "lift")


@registered("i10_bootstrap_interval")
def i10(spark, sf_dir):
    return rounded(evaluation.bootstrap(blocks(spark, sf_dir)), "low", "high", "replicates")


@registered("i11_paired_comparison")
def i11(spark, sf_dir):
    """Two scorings of the same events on the same resamples; the tests draw the same numbers in numpy."""
    other = ((F.col("event_id") * 104729 + F.col("src") * 17) % 997 + F.col("label") * 100) / F.lit(1100.0)
    rows = scores(spark, sf_dir).select(F.col("score").alias("score_a"), F.round(other, 2).alias("score_b"), "label")
    return rounded(uncertainty.paired_comparison(rows), "difference", "low", "high", "fraction_a_wins", "significant", "replicates")


@registered("i13_calibration_report")
def i13_report(spark, sf_dir):
    """Equal-frequency bins of scores of which most are 0; the tests follow the same rule in numpy."""
    rows = scores(spark, sf_dir).select(F.when(F.col("event_id") % 10 < 8, 0.0).otherwise(F.col("score")).alias("score"), "label")
    table, summary = uncertainty.calibration_report(rows)
    found = table.join(F.broadcast(summary))
    return rounded(found, "bin", "n", "positives", "mean_predicted", "observed", "low", "high", "expected_error", "maximum_error", "brier", "reliability", "resolution", "uncertainty")


_WILSON = "(p + 1.96::DOUBLE * 1.96 / (2 * n) {s} 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE * 1.96 / (4 * n * n))) / (1 + 1.96::DOUBLE * 1.96 / n)"


@registered("i12_wilson_interval", f"{SCORES_CTE}, z AS (SELECT usr, count(*)::DOUBLE AS n, sum(label)::DOUBLE / count(*) AS p FROM x GROUP BY usr) SELECT usr, round({_WILSON.format(s='-')}, 6) + 0.0 AS low, round({_WILSON.format(s='+')}, 6) + 0.0 AS high FROM z")
def i12(spark, sf_dir):
    low, high = evaluation.wilson(F.col("p").cast("double"), F.col("n").cast("double"))
    rows = scores(spark, sf_dir).groupBy("usr").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    return rounded(rows.withColumns({"low": low, "high": high}), "usr", "low", "high")


EDGES = [0.2, 0.4, 0.6, 0.8]


@registered("i13_calibration_bins", f"{SCORES_CTE}, z AS (SELECT CAST((score >= 0.2)::INTEGER + (score >= 0.4)::INTEGER + (score >= 0.6)::INTEGER + (score >= 0.8)::INTEGER AS INTEGER) AS bin, count(*) AS n, avg(score) AS mean_score, avg(label::DOUBLE) AS rate FROM x GROUP BY 1) SELECT bin, n, round(mean_score, 6) AS mean_score, round(rate, 6) AS rate, round(abs(rate - mean_score), 6) AS gap FROM z")
def i13(spark, sf_dir):
    return rounded(evaluation.calibration(scores(spark, sf_dir), EDGES), "bin", "n", "mean_score", "rate", "gap")


@registered("i14_precision_gate", f"{BLOCKS_CTE}, z AS (SELECT *, (cum_pos + cum_neg)::DOUBLE AS n, cum_pos / (cum_pos + cum_neg)::DOUBLE AS p FROM c), y AS (SELECT *, n >= 20 AND {_WILSON.format(s='-')} < 0.3 AS fails FROM z), k AS (SELECT max(score) FILTER (fails) AS stop FROM y) SELECT round(min(score), 6) AS gate, CAST(max(n) AS BIGINT) AS alerts, CAST(max(cum_pos) AS BIGINT) AS hits FROM y, k WHERE n >= 20 AND (stop IS NULL OR score > stop)")
def i14(spark, sf_dir):
    return rounded(evaluation.precision_gate(blocks(spark, sf_dir), 0.3), "gate", "alerts", "hits")


@registered("i15_attack_only_entities", f"{SPARSE_SQL} SELECT dst AS entity, count(*) AS n FROM e GROUP BY dst HAVING min(label) = 1")
def i15(spark, sf_dir):
    return evaluation.attack_only(auth_sparse(spark, sf_dir), "dst")


@registered(
    "i18_drift_psi_ks",
    f"""{SCORES_CTE}, k AS (SELECT quantile_disc(t, 0.5) AS cut FROM x), y AS (SELECT score, (t <= cut)::INTEGER AS old, (t > cut)::INTEGER AS new FROM x, k), n AS (SELECT sum(old)::DOUBLE AS n_old, sum(new)::DOUBLE AS n_new FROM y),
    h AS (SELECT i AS bin, coalesce(sum(old), 0) AS o, coalesce(sum(new), 0) AS w FROM range(10) r(i) LEFT JOIN y ON least(floor(score * 10), 9) = i GROUP BY i),
    q AS (SELECT greatest(0.0001::DOUBLE, o / n_old) AS p, greatest(0.0001::DOUBLE, w / n_new) AS q FROM h, n), c AS (SELECT score, sum(sum(old)) OVER (ORDER BY score) AS co, sum(sum(new)) OVER (ORDER BY score) AS cw FROM y GROUP BY score)
    SELECT (SELECT round(sum((q - p) * ln(q / p)), 6) FROM q) AS psi, (SELECT round(max(abs(co / n_old - cw / n_new)), 6) FROM c, n) AS ks""",
)
def i18(spark, sf_dir):
    rows = scores(spark, sf_dir)
    cut = rows.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY t)")).first()[0]
    return rounded(evaluation.drift(rows.filter(F.col("t") <= cut), rows.filter(F.col("t") > cut)), "psi", "ks")


@registered("i20_histogram_auc", f"{SCORES_CTE}, b AS (SELECT floor(score * 50) AS score, sum(label) AS n_pos, sum(1 - label) AS n_neg FROM x GROUP BY 1), c AS (SELECT *, sum(n_neg) OVER (ORDER BY score DESC) AS cum_neg FROM b) SELECT round(1 - sum(n_pos * (0.5::DOUBLE * n_neg + cum_neg - n_neg)) / (sum(n_pos) * sum(n_neg)), 6) AS roc_auc FROM c")
def i20(spark, sf_dir):
    return rounded(evaluation.hist_auc(scores(spark, sf_dir), 50), "roc_auc")


@registered("i21_budget_curve", "\nUNION ALL ".join(f"(SELECT {b}::DOUBLE AS budget, round(threshold, 6) AS threshold, round(benign, 6) + 0.0 AS benign_rate, round(recall, 6) + 0.0 AS recall FROM ({SCORES_CTE}, n AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n FROM x WHERE label = 0), k AS (SELECT min(score) AS threshold FROM n WHERE r <= greatest(1, floor(n * {b}::DOUBLE)::BIGINT)) SELECT any_value(threshold) AS threshold, avg((score >= threshold)::INTEGER::DOUBLE) FILTER (label = 0) AS benign, avg((score >= threshold)::INTEGER::DOUBLE) FILTER (label = 1) AS recall FROM x, k))" for b in (0.0005, 0.005, 0.05)))
def i21(spark, sf_dir):
    return rounded(evaluation.budget_curve(scores(spark, sf_dir), [0.0005, 0.005, 0.05]), "budget", "threshold", "benign_rate", "recall")


@registered("i22_grouped_auc", f"{SCORES_CTE}, p AS (SELECT a.src, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END::DOUBLE) AS auc FROM x a JOIN x b ON a.src = b.src AND a.label = 1 AND b.label = 0 GROUP BY a.src) SELECT src, round(auc, 6) AS auc FROM p")
def i22(spark, sf_dir):
    return rounded(evaluation.grouped_auc(scores(spark, sf_dir), "src"), "src", "auc")


_RECORDED = "x1 AS (SELECT *, t // 3600 AS g FROM x), a1 AS (SELECT * FROM x1 WHERE g IN (SELECT g FROM x1 WHERE label = 1))"


@registered(
    "i22_group_summary",
    f"""{SCORES_CTE}, {_RECORDED}, by_g AS (SELECT g, sum(label) AS p, sum(1 - label) AS q, max((label = 1 AND score >= 0.8)::INTEGER) AS hit, sum((label = 0 AND score >= 0.8)::INTEGER) AS fp, arg_max(label, (score, -event_id)) AS first FROM a1 GROUP BY g),
    pr AS (SELECT p.g AS g, n.g AS h, CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END::DOUBLE AS win FROM (SELECT * FROM a1 WHERE label = 1) p, (SELECT * FROM a1 WHERE label = 0) n)
    SELECT count(*) AS groups, CAST(sum(p) AS BIGINT) AS attacks, CAST(sum(q) AS BIGINT) AS benign, CAST(sum(hit) AS BIGINT) AS detected, CAST(sum(fp) AS BIGINT) AS benign_alerts, count(*) FILTER (q > 0) AS with_benign, count(*) FILTER (q > 0 AND first = 1) AS attack_first,
        round(sum(p / (p + q)::DOUBLE) FILTER (q > 0), 6) AS attack_first_by_chance, (SELECT round(avg(win), 6) FROM pr) AS pooled_auc, (SELECT round(avg(w), 6) FROM (SELECT avg(win) AS w FROM pr WHERE g = h GROUP BY g)) AS mean_auc FROM by_g""",
)
def i22_summary(spark, sf_dir):
    """Hours of the stream as recordings."""
    rows = scores(spark, sf_dir).withColumn("g", F.floor(F.col("t") / 3_600))
    return rounded(evaluation.group_summary(rows, "g", 0.8), "groups", "attacks", "benign", "detected", "benign_alerts", "with_benign", "attack_first", "attack_first_by_chance", "pooled_auc", "mean_auc")


@registered("i24_rank_agreement", f"{SCORES_CTE}, y AS (SELECT event_id, score AS a, floor(score * 20) / 20 AS b FROM x), z AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM y) SELECT round(corr(ra, rb), 6) AS spearman, round(max(abs(a - b)), 6) AS max_delta FROM z")
def i24(spark, sf_dir):
    rows = scores(spark, sf_dir).select("event_id", "score")
    return rounded(evaluation.rank_agreement(rows, rows.withColumn("score", F.floor(F.col("score") * 20) / 20)), "spearman", "max_delta")


@registered("h07_empirical_percentile", f"{SCORES_CTE} SELECT event_id, round(cume_dist() OVER (ORDER BY score), 6) AS percentile FROM x")
def h07_all(spark, sf_dir):
    """Every event against all scores."""
    rows = scores(spark, sf_dir).select("event_id", "score")
    return rounded(evaluation.percentile_of(rows, rows.select("score")), "event_id", "percentile")


@registered(
    "f14_related_alerts",
    f"""{ALERTS_CTE}, r AS (SELECT DISTINCT event_id, t, x FROM (SELECT event_id, t, unnest(['user:' || usr, 'host:' || src, 'host:' || dst]) AS x FROM a))
    SELECT q.event_id AS target, r.event_id, r.t, count(*) AS shared FROM r q JOIN r ON r.x = q.x AND r.event_id <> q.event_id WHERE q.event_id % 50 = 0 GROUP BY ALL""",
)
def f14_search_set(spark, sf_dir):
    """The stated search set, as of f13."""
    rows = alerts(spark, sf_dir)
    return graph.related_alerts(rows, rows.filter("event_id % 50 = 0").select("event_id"))


#: The documented risk floor of paths (FIXTURES.md); edges as of the operator.
PATH_RISK = 0.8
WHOLE_PATHS_CTE = PATHS_CTE.replace(f"round(risk, 6) >= {ALERT_RISK}", f"round(risk, 6) >= {PATH_RISK}").replace("p.n < 3", f"p.n < {graph.MAX_EDGES}")


@registered("f03_rank_paths", f"{WHOLE_PATHS_CTE} SELECT path, n_edges, first_t, last_t FROM scored_paths")
def f03_five_edges(spark, sf_dir):
    rows = graph.score_paths(graph.rank_paths(alerts(spark, sf_dir, PATH_RISK), min_risk=PATH_RISK), top_k=None)
    return rows.select(F.concat_ws("-", "events").alias("path"), "n_edges", "first_t", "last_t")


@registered("f04_score_paths", f"{WHOLE_PATHS_CTE} SELECT path, n_edges, score FROM scored_paths ORDER BY score DESC, first_t, last_t, events LIMIT 20")
def f04_five_edges(spark, sf_dir):
    rows = graph.score_paths(graph.rank_paths(alerts(spark, sf_dir, PATH_RISK), min_risk=PATH_RISK), top_k=20)
    return rows.select(F.concat_ws("-", "events").alias("path"), "n_edges", "score")


@registered("f05_incremental_paths", f"{WHOLE_PATHS_CTE}, m AS (SELECT quantile_disc(t, 0.5) AS cut FROM a) SELECT path FROM scored_paths, m WHERE last_t > cut")
def f05_five_edges(spark, sf_dir):
    rows = graph.cut_lineage(alerts(spark, sf_dir, PATH_RISK), "alerts")
    cut = rows.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY t)")).first()[0]
    first, tail = graph.advance_paths(rows.filter(F.col("t") <= cut), rows.limit(0), rows.select(F.lit("").alias("path_id")).limit(0))
    second, _ = graph.advance_paths(rows.filter(F.col("t") > cut), tail, first.select("path_id"))
    return second.select(F.col("path_id").alias("path"))


def _whole_graph(spark, sf_dir):
    """Edges of all alerts from PATH_RISK on; seeds are the hosts, left or reached, with an alert from ALERT_RISK on."""
    rows = graph.cut_lineage(alerts(spark, sf_dir, PATH_RISK), "alerts")
    hosts = rows.filter(F.col("risk") >= ALERT_RISK).select("risk", F.explode(F.array("src", "dst")).alias("node"))
    return rows.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count("*").cast("double").alias("weight")), hosts.groupBy("node").agg(F.max("risk").alias("seed"))


@registered("f08_risk_propagation")
def f08_converged(spark, sf_dir):
    """To a change of 1e-6, or 100 rounds; the tests iterate the same in numpy."""
    return rounded(graph.propagate(*_whole_graph(spark, sf_dir)), "node", "mass", "risk")


@registered("f09_hop_distance")
def f09_all_seeds(spark, sf_dir):
    """From all seeds until nothing new is reached; the tests search the same in Python."""
    return graph.hop_distance(*_whole_graph(spark, sf_dir))
