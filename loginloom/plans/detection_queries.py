"""Registered queries of causal features, rules, fusion and techniques, each with the SQL that it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, fusion, rules, tactics
from .fixtures import DENSE_SQL, SPARSE_SQL, auth_dense, auth_sparse

R6 = 6


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    """columns with doubles rounded, and a zero never negative."""
    kinds = dict(rows.dtypes)
    return rows.select(*[(F.round(F.col(c), R6) + 0.0).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns])


# ---- features -------------------------------------------------------------------------------------------------------

FEATURE_CTE = """, f0 AS (
    SELECT *,
        CAST(row_number() OVER (PARTITION BY usr, dst ORDER BY t, event_id) = 1 AS BIGINT) AS first_pair,
        CAST(row_number() OVER (PARTITION BY src, dst ORDER BY t, event_id) = 1 AS BIGINT) AS first_hosts,
        CAST(row_number() OVER (PARTITION BY usr, logon_id ORDER BY t, event_id) = 1 AS BIGINT) AS first_logon
    FROM e
), f AS (
    SELECT *,
        sin(2 * pi() * ((t % 86400) // 3600) / 24) AS hour_sin,
        cos(2 * pi() * ((t % 86400) // 3600) / 24) AS hour_cos,
        coalesce(ln(1.0 + t - max(t) OVER p_usr), 0.0) AS delta_user_log,
        coalesce(ln(1.0 + t - max(t) OVER p_pair), 0.0) AS delta_pair_log,
        CAST(count(*) OVER p_usr > 0 AS INTEGER) AS user_seen_before,
        CAST(count(*) OVER p_pair > 0 AS INTEGER) AS pair_seen_before,
        1 - CAST(count(*) OVER p_pair > 0 AS INTEGER) AS is_new_pair,
        count(*) OVER o_pair_1h AS pair_frequency_1h,
        1 / sqrt(count(*) OVER p_pair + 1.0) AS pair_rarity,
        count(DISTINCT dst) OVER o_usr_5m AS user_unique_dst_5m,
        count(DISTINCT dst) OVER o_usr_1h AS user_unique_dst_1h,
        count(DISTINCT dst) OVER o_usr_24h AS user_unique_dst_24h,
        count(*) OVER o_usr_5m AS user_auth_rate_5m,
        coalesce(avg(1.0 - success) OVER o_usr_15m, 0.0) AS user_failure_rate_15m,
        CAST(CASE WHEN success = 1 THEN coalesce(sum(1 - success) OVER o_usr_15m, 0) ELSE 0 END AS BIGINT) AS failures_before_success_15m,
        coalesce(avg(first_pair) OVER o_usr_1h, 0.0) AS user_new_dst_ratio_1h,
        count(DISTINCT dst) OVER o_src_1h AS src_host_unique_dst_1h,
        count(DISTINCT usr) OVER o_dst_1h AS dst_inbound_users_1h,
        1 / (coalesce(sum(first_pair) OVER p_dst, 0) + 1.0) AS destination_novelty,
        CAST(coalesce(sum(first_pair) OVER p_usr, 0) AS BIGINT) AS user_historical_degree,
        CAST(coalesce(sum(first_hosts) OVER p_src, 0) AS BIGINT) AS src_host_historical_degree,
        CAST(coalesce(sum(first_pair) OVER p_dst, 0) AS BIGINT) AS dst_historical_degree,
        -ln((count(*) OVER p_logon + 1.0) / (count(*) OVER p_usr + coalesce(sum(first_logon) OVER p_usr, 0) + 1.0)) AS rare_logon_score,
        CAST(count(*) OVER p_usr_src > 0 AS INTEGER) AS user_src_seen_before,
        CAST(count(*) OVER p_hosts > 0 AS INTEGER) AS src_dst_seen_before,
        count(DISTINCT usr) OVER o_src_1h AS src_host_unique_users_1h
    FROM f0
    WINDOW p_usr AS (PARTITION BY usr ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        p_pair AS (PARTITION BY usr, dst ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        p_dst AS (PARTITION BY dst ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        p_src AS (PARTITION BY src ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        p_usr_src AS (PARTITION BY usr, src ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        p_hosts AS (PARTITION BY src, dst ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        p_logon AS (PARTITION BY usr, logon_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        o_usr_5m AS (PARTITION BY usr ORDER BY t RANGE BETWEEN 299 PRECEDING AND 1 PRECEDING),
        o_usr_15m AS (PARTITION BY usr ORDER BY t RANGE BETWEEN 899 PRECEDING AND 1 PRECEDING),
        o_usr_1h AS (PARTITION BY usr ORDER BY t RANGE BETWEEN 3599 PRECEDING AND 1 PRECEDING),
        o_usr_24h AS (PARTITION BY usr ORDER BY t RANGE BETWEEN 86399 PRECEDING AND 1 PRECEDING),
        o_pair_1h AS (PARTITION BY usr, dst ORDER BY t RANGE BETWEEN 3599 PRECEDING AND 1 PRECEDING),
        o_src_1h AS (PARTITION BY src ORDER BY t RANGE BETWEEN 3599 PRECEDING AND 1 PRECEDING),
        o_dst_1h AS (PARTITION BY dst ORDER BY t RANGE BETWEEN 3599 PRECEDING AND 1 PRECEDING)
)"""

DOUBLES = {"hour_sin", "hour_cos", "delta_user_log", "delta_pair_log", "pair_rarity", "user_failure_rate_15m", "user_new_dst_ratio_1h", "destination_novelty", "rare_logon_score"}


def r6(name: str) -> str:
    return f"round({name}, 6) + 0.0 AS {name}"


def selected(names, doubles=DOUBLES) -> str:
    return ", ".join(r6(n) if n in doubles else n for n in names)


QUERIES, ORACLE_SQL = {}, {}

FEATURE_QUERIES = {
    "d01_hour_cyclic": ["hour_sin", "hour_cos"],
    "d02_delta_user_log": ["delta_user_log"],
    "d03_delta_pair_log": ["delta_pair_log"],
    "d04_user_seen_before": ["user_seen_before"],
    "d05_pair_seen_before": ["pair_seen_before", "is_new_pair"],
    "d06_pair_frequency_1h": ["pair_frequency_1h"],
    "d07_pair_rarity": ["pair_rarity"],
    "d08_user_unique_dst": ["user_unique_dst_5m", "user_unique_dst_1h", "user_unique_dst_24h"],
    "d09_user_auth_rate_5m": ["user_auth_rate_5m"],
    "d10_user_failure_rate_15m": ["user_failure_rate_15m"],
    "d11_failures_before_success_15m": ["failures_before_success_15m"],
    "d12_user_new_dst_ratio_1h": ["user_new_dst_ratio_1h"],
    "d13_src_host_unique_dst_1h": ["src_host_unique_dst_1h"],
    "d14_dst_inbound_users_1h": ["dst_inbound_users_1h"],
    "d15_destination_novelty": ["destination_novelty"],
    "d16_user_historical_degree": ["user_historical_degree"],
    "d17_src_host_historical_degree": ["src_host_historical_degree"],
    "d18_dst_historical_degree": ["dst_historical_degree"],
    "d19_rare_logon_score": ["rare_logon_score"],
    "d20_user_src_seen_before": ["user_src_seen_before"],
    "d21_src_dst_seen_before": ["src_dst_seen_before"],
    "d22_src_host_unique_users_1h": ["src_host_unique_users_1h"],
}


def _feature_query(names, source):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(features.with_features(source(spark, sf_dir), names), "event_id", *names)

    return run


for _name, _columns in FEATURE_QUERIES.items():
    _sparse = _name in ("d01_hour_cyclic", "d03_delta_pair_log", "d08_user_unique_dst", "d16_user_historical_degree", "d20_user_src_seen_before")
    QUERIES[_name] = _feature_query(_columns, auth_sparse if _sparse else auth_dense)
    ORACLE_SQL[_name] = f"{SPARSE_SQL if _sparse else DENSE_SQL}{FEATURE_CTE} SELECT event_id, {selected(_columns)} FROM f"
for _name, _source, _sql in (("d23_causal_features", auth_dense, DENSE_SQL), ("d23_causal_features_sparse", auth_sparse, SPARSE_SQL)):
    QUERIES[_name] = _feature_query(features.ALL, _source)
    ORACLE_SQL[_name] = f"{_sql}{FEATURE_CTE} SELECT event_id, {selected(features.ALL)} FROM f"


def registered(name: str, sql: str | None = None):
    """Puts a query into the registry under its name, with its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


@registered("d26_sample_counterfactuals")
def d26(spark, sf_dir):
    return features.counterfactuals(auth_dense(spark, sf_dir), share=0.02)


@registered(
    "d27_feature_state_coverage",
    f"""{SPARSE_SQL} SELECT count(*) AS n_events, count(DISTINCT usr) AS n_users, count(DISTINCT src) AS n_sources, count(DISTINCT dst) AS n_destinations,
        count(DISTINCT (usr, dst)) AS n_pairs, max(t) AS last_t FROM e""",
)
def d27(spark, sf_dir):
    return features.coverage(auth_sparse(spark, sf_dir))


@registered(
    "d29_security_eda",
    f"""{DENSE_SQL}, totals AS (SELECT count(*) AS events, sum(label) AS positives, sum(1 - success) AS failures, count(DISTINCT usr) AS users, count(DISTINCT src) AS sources, count(DISTINCT dst) AS destinations FROM e)
    SELECT metric, '' AS key, CAST(value AS BIGINT) AS value FROM (UNPIVOT (SELECT events::BIGINT AS events, positives::BIGINT AS positives, failures::BIGINT AS failures, users::BIGINT AS users, sources::BIGINT AS sources, destinations::BIGINT AS destinations FROM totals) ON events, positives, failures, users, sources, destinations INTO NAME metric VALUE value)
    UNION ALL SELECT 'hour', CAST((t % 86400) // 3600 AS VARCHAR), count(*) FROM e GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'top_usr', CAST(usr AS VARCHAR), count(*) FROM e GROUP BY usr ORDER BY count(*) DESC, usr LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'top_dst', CAST(dst AS VARCHAR), count(*) FROM e GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 10)""",
)
def d29(spark, sf_dir):
    return features.eda(auth_dense(spark, sf_dir))


SCALED = ["user_auth_rate_5m", "user_historical_degree", "delta_user_log", "pair_rarity"]


@registered(
    "d30_scale_robust",
    f"{DENSE_SQL}{FEATURE_CTE}, s AS (SELECT "
    + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, greatest(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 1e-6) AS s_{c}" for c in SCALED)
    + " FROM f) SELECT event_id, "
    + ", ".join(f"round(greatest(-10.0, least(10.0, ({c} - m_{c}) / s_{c})), 6) + 0.0 AS {c}" for c in SCALED)
    + " FROM f, s",
)
def d30(spark, sf_dir):
    x = features.with_features(auth_dense(spark, sf_dir), SCALED)
    return rounded(features.apply_scaler(x, features.fit_scaler(x, SCALED, "robust"), 10.0), "event_id", *SCALED)


_LOGGED = {c: (f"ln(1.0 + {c})" if c in features.COUNT_FEATURES else c) for c in SCALED}


@registered(
    "d31_scale_standard",
    f"{DENSE_SQL}{FEATURE_CTE}, s AS (SELECT "
    + ", ".join(f"avg({x}) AS m_{c}, CASE WHEN stddev_pop({x}) < 1e-6 THEN 1.0 ELSE stddev_pop({x}) END AS s_{c}" for c, x in _LOGGED.items())
    + " FROM f) SELECT event_id, "
    + ", ".join(f"round(greatest(-8.0, least(8.0, ({x} - m_{c}) / s_{c})), 6) + 0.0 AS {c}" for c, x in _LOGGED.items())
    + " FROM f, s",
)
def d31(spark, sf_dir):
    x = features.with_features(auth_dense(spark, sf_dir), SCALED)
    return rounded(features.apply_scaler(x, features.fit_scaler(x, SCALED, "standard"), 8.0, logs=True), "event_id", *SCALED)


# ---- rules ----------------------------------------------------------------------------------------------------------

CHAIN_CTE = """, reach AS (SELECT usr, t, event_id, dst AS host FROM e WHERE success = 1), c0 AS (
    SELECT e.*, (SELECT max(r.t) FROM reach r WHERE r.usr = e.usr AND r.host = e.src AND (r.t < e.t OR (r.t = e.t AND r.event_id < e.event_id))) AS last_seen,
        (SELECT max(r.t) FROM reach r WHERE r.usr = e.usr AND r.host = e.src AND r.t < e.t) AS last_strict,
        row_number() OVER (PARTITION BY usr, dst, success ORDER BY t, event_id) = 1 AS novel,
        coalesce(sum(success) OVER (PARTITION BY usr, dst ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_n
    FROM e
), c1 AS (SELECT *, CAST(coalesce(success = 1 AND novel AND last_seen >= t - 1800, false) AS INTEGER) AS hop FROM c0),
c2 AS (SELECT *, CAST(coalesce(sum(hop) OVER (PARTITION BY usr ORDER BY t RANGE BETWEEN 1800 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_hops FROM c1),
c AS (SELECT *, CAST(coalesce(last_strict >= t - 1800 AND prior_hops >= 3, false) AS INTEGER) AS chain_continues,
    CAST(coalesce(success = 1 AND last_strict >= t - 1800 AND prior_hops >= 3 AND before_n = 0, false) AS INTEGER) AS chain_hop FROM c2)"""

FANOUT_CTE = """, g0 AS (
    SELECT e.*, count(DISTINCT CASE WHEN success = 1 THEN usr END) OVER w AS fanout_accounts,
        CAST(success = 1 AND row_number() OVER (PARTITION BY src, dst, success ORDER BY t, event_id) = 1 AS BIGINT) AS first_ok,
        CAST(coalesce(sum(success) OVER (PARTITION BY src, dst ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS INTEGER) AS dst_novel
    FROM e WINDOW w AS (PARTITION BY src ORDER BY t RANGE BETWEEN 3599 PRECEDING AND 1 PRECEDING)
), g1 AS (SELECT *, CAST(coalesce(sum(first_ok) OVER (PARTITION BY src ORDER BY t RANGE BETWEEN 3599 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS fanout_novel FROM g0),
daily AS (SELECT src, t // 86400 AS day, max(fanout_accounts) AS most FROM g1 GROUP BY ALL),
base AS (SELECT src, day, CAST(coalesce(median(most) OVER (PARTITION BY src ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0) AS DOUBLE) AS baseline FROM daily),
base_calendar AS (SELECT src, day, CAST(coalesce(median(most) OVER (PARTITION BY src ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0) AS DOUBLE) AS baseline FROM daily),
g AS (SELECT g1.*, b.baseline FROM g1 JOIN base b ON b.src = g1.src AND b.day = g1.t // 86400)"""


@registered("e01_any_source_pivot", f"{DENSE_SQL} SELECT event_id, CAST(EXISTS (SELECT 1 FROM e r WHERE r.success = 1 AND r.dst = e.src AND r.t >= e.t - 1800 AND r.t < e.t) AS INTEGER) AS pivot FROM e")
def e01(spark, sf_dir):
    return rules.pivot(auth_dense(spark, sf_dir)).select("event_id", "pivot")


@registered("e02_chain_continues", f"{DENSE_SQL}{CHAIN_CTE} SELECT event_id, prior_hops, chain_continues FROM c")
def e02(spark, sf_dir):
    return rules.chain_flags(auth_dense(spark, sf_dir)).select("event_id", "prior_hops", "chain_continues")


@registered("e03_chain_hop", f"{DENSE_SQL}{CHAIN_CTE} SELECT event_id, chain_hop FROM c")
def e03(spark, sf_dir):
    return rules.chain_flags(auth_dense(spark, sf_dir)).select("event_id", "chain_hop")


@registered("e04_fanout_inputs", f"{DENSE_SQL}{FANOUT_CTE} SELECT event_id, fanout_accounts, fanout_novel, dst_novel FROM g")
def e04(spark, sf_dir):
    return rules.fanout_inputs(auth_dense(spark, sf_dir)).select("event_id", "fanout_accounts", "fanout_novel", "dst_novel")


@registered("e05_fanout_baseline", f"{SPARSE_SQL}{FANOUT_CTE} SELECT src, day, 'active' AS kind, baseline FROM base UNION ALL SELECT src, day, 'calendar', baseline FROM base_calendar")
def e05(spark, sf_dir):
    inputs = rules.fanout_inputs(auth_sparse(spark, sf_dir))
    parts = [rules.fanout_baseline(inputs, 7, k).select("src", "day", F.lit(k).alias("kind"), "baseline") for k in ("active", "calendar")]
    return parts[0].union(parts[1])


_FANOUT = "CAST(fanout_accounts >= {a} AND fanout_novel >= {n} AND baseline <= {b} AND success = 1 AND dst_novel = 1 AS INTEGER) AS fanout_hop"


@registered("e06_fanout_hop", f"{DENSE_SQL}{FANOUT_CTE} SELECT event_id, {_FANOUT.format(a=8, n=5, b=2.0)} FROM g")
def e06(spark, sf_dir):
    return rules.fanout_flags(auth_dense(spark, sf_dir)).select("event_id", "fanout_hop")


@registered("e06_fanout_hop_sparse", f"{SPARSE_SQL}{FANOUT_CTE} SELECT event_id, {_FANOUT.format(a=3, n=2, b=1e9)} FROM g")
def e06_sparse(spark, sf_dir):
    return rules.fanout_flags(auth_sparse(spark, sf_dir), accounts=3, novel=2, baseline=1e9).select("event_id", "fanout_hop")


@registered("e16_detect_rules", f"{DENSE_SQL}{CHAIN_CTE}{FANOUT_CTE} SELECT g.event_id, {_FANOUT.format(a=8, n=5, b=2.0).replace('success', 'g.success')}, c.chain_hop FROM g JOIN c ON c.event_id = g.event_id")
def e16(spark, sf_dir):
    return rules.detect(auth_dense(spark, sf_dir))


# ---- fusion ---------------------------------------------------------------------------------------------------------

SCORE_CTE = (
    CHAIN_CTE
    + FEATURE_CTE
    + """, s0 AS (
    SELECT f.*, c.chain_continues, c.chain_hop, greatest(is_new_pair::DOUBLE, destination_novelty) AS novelty,
        1 - exp(-(user_auth_rate_5m + user_unique_dst_5m) / 10.0) AS burst,
        CASE WHEN c.chain_continues = 1 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, src_host_unique_dst_1h / 5.0::DOUBLE) END AS pivot_signal
    FROM f JOIN c ON c.event_id = f.event_id
), s1 AS (
    SELECT *, least(1.0, 0.40::DOUBLE * novelty + 0.35::DOUBLE * burst + 0.25::DOUBLE * pivot_signal) AS model,
        CAST((novelty >= 0.5)::INTEGER + (burst >= 0.5)::INTEGER + (pivot_signal >= 0.5)::INTEGER AS BIGINT) AS support FROM s0
), s2 AS (SELECT *, least(1.0::DOUBLE, support / 3.0::DOUBLE) AS corroboration FROM s1),
s AS (
    SELECT *, 1 - (1 - 0.95::DOUBLE * model) * (1 - 0.05::DOUBLE * novelty) * (1 - 0.30::DOUBLE * burst) * (1 - 0.05::DOUBLE * pivot_signal) * (1 - 0.35::DOUBLE * corroboration) AS risk,
        greatest(0.0, least(1.0, 0.55::DOUBLE * model + 0.20::DOUBLE * novelty + 0.10::DOUBLE * burst + 0.10::DOUBLE * pivot_signal + 0.05::DOUBLE * corroboration)) AS risk_linear FROM s2
)"""
)
NEEDED = ["user_auth_rate_5m", "user_unique_dst_5m", "src_host_unique_dst_1h", "is_new_pair", "destination_novelty"]
CHANNELS = ["model", "novelty", "burst", "pivot_signal", "corroboration"]


def scored(spark: SparkSession, sf_dir: str, more: list[str] | None = None) -> DataFrame:
    """The scored fixture: dense events with signals and model-free risks."""
    rows = features.with_features(auth_dense(spark, sf_dir), [*NEEDED, *(more or [])])
    return fusion.scored_events(rules.chain_flags(rows))


_D = {"novelty", "burst", "pivot_signal", "model", "risk", "risk_linear", "corroboration"}


@registered("e07_explicit_signals", f"{DENSE_SQL}{SCORE_CTE} SELECT event_id, {selected(['novelty', 'burst', 'pivot_signal'], _D)} FROM s")
def e07(spark, sf_dir):
    return rounded(scored(spark, sf_dir), "event_id", "novelty", "burst", "pivot_signal")


@registered("e08_fallback_model_score", f"{DENSE_SQL}{SCORE_CTE} SELECT event_id, {r6('model')} FROM s")
def e08(spark, sf_dir):
    return rounded(scored(spark, sf_dir), "event_id", "model")


@registered("e09_fuse_linear", f"{DENSE_SQL}{SCORE_CTE} SELECT event_id, {r6('risk_linear')} FROM s")
def e09(spark, sf_dir):
    return rounded(scored(spark, sf_dir), "event_id", "risk_linear")


@registered("e10_fuse_noisy_or", f"{DENSE_SQL}{SCORE_CTE} SELECT event_id, {r6('risk')} FROM s")
def e10(spark, sf_dir):
    return rounded(scored(spark, sf_dir), "event_id", "risk")


def _without(i: int) -> str:
    parts = [f"(1 - {r}::DOUBLE * {c})" for k, (r, c) in enumerate(zip(fusion.NOISY_OR, CHANNELS)) if k != i]
    return f"risk - (1 - {' * '.join(parts)})"


@registered(
    "e11_fusion_contributions",
    f"{DENSE_SQL}{SCORE_CTE}, p AS (SELECT event_id, " + ", ".join(f"round({_without(i)}, 6) + 0.0 AS part_{c}" for i, c in enumerate(CHANNELS)) + " FROM s) SELECT *, CASE greatest("
    + ", ".join(f"part_{c}" for c in CHANNELS) + ") " + " ".join(f"WHEN part_{c} THEN '{c}'" for c in CHANNELS) + " END AS dominant FROM p",
)
def e11(spark, sf_dir):
    rows = scored(spark, sf_dir)
    parts = fusion.contributions([F.col(c) for c in CHANNELS])
    rows = rows.withColumns({f"part_{c}": F.round(p, R6) + 0.0 for c, p in zip(CHANNELS, parts)})
    return rows.withColumn("dominant", fusion.dominant({c: F.col(f"part_{c}") for c in CHANNELS})).select("event_id", *[f"part_{c}" for c in CHANNELS], "dominant")


@registered("e12_rule_floor", f"{DENSE_SQL}{SCORE_CTE} SELECT event_id, CASE WHEN chain_hop = 1 AND risk < 0.99 THEN 0.99 ELSE round(risk, 6) + 0.0 END::DOUBLE AS risk, CASE WHEN chain_hop = 1 AND risk < 0.99 THEN 'chain_hop' END AS rule_floor FROM s")
def e12(spark, sf_dir):
    return rounded(fusion.apply_floor(scored(spark, sf_dir), "chain_hop", 0.99), "event_id", "risk", "rule_floor")


@registered("e14_alert_filter", f"{DENSE_SQL}{SCORE_CTE} SELECT event_id, t, usr, src, dst, {r6('risk')} FROM s WHERE risk >= 0.8")
def e14(spark, sf_dir):
    return rounded(fusion.alerts(scored(spark, sf_dir), 0.8), "event_id", "t", "usr", "src", "dst", "risk")


@registered(
    "e15_risk_intelligence",
    f"""{DENSE_SQL}{SCORE_CTE}, i AS (SELECT event_id, support, [{', '.join(CHANNELS)}] AS v, {', '.join(f'{c} AS c_{c}' for c in CHANNELS)} FROM s),
    j AS (SELECT *, greatest(0.0, 1 - 2 * list_stddev_pop(v)) AS agreement FROM i)
    SELECT event_id, round(agreement, 6) + 0.0 AS agreement, round(0.6::DOUBLE * agreement + 0.4::DOUBLE * least(1.0::DOUBLE, support / 3.0::DOUBLE), 6) + 0.0 AS confidence,
        array_to_string(list_transform(list_sort(list_filter([{', '.join(f"{{'v': -c_{c}, 'n': '{c}'}}" for c in CHANNELS)}], lambda x: x.v <= -0.5))[1:3], lambda x: x.n), ',') AS top_channels FROM j""",
)
def e15(spark, sf_dir):
    made = fusion.risk_intelligence({c: F.col(c) for c in CHANNELS}, F.col("support").cast("double"))
    return rounded(scored(spark, sf_dir).withColumns(made), "event_id", "agreement", "confidence", "top_channels")


# ---- techniques -----------------------------------------------------------------------------------------------------

TGT_CTE = """, k0 AS (
    SELECT *, max(CASE WHEN orient_name = 'TGT' THEN t END) OVER u AS last_tgt, CAST(orient_name IN ('TGT', 'TGS') AND count(*) FILTER (orient_name IN ('TGT', 'TGS')) OVER u = 0 AS INTEGER) AS asked1 FROM e
    WINDOW u AS (PARTITION BY usr ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), k1 AS (SELECT *, CAST(orient_name = 'TGT' AND last_tgt IS NULL AS INTEGER) AS got1 FROM k0),
k2 AS (SELECT *, coalesce(sum(asked1) OVER a, 0) AS asked, coalesce(sum(got1) OVER a, 0) AS got,
    count(*) OVER z AS n_before, count(*) FILTER (auth_name = 'Kerberos') OVER z AS k_before FROM k1
    WINDOW a AS (ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), z AS (ORDER BY t, event_id ROWS BETWEEN 5000 PRECEDING AND 1 PRECEDING)),
k AS (SELECT event_id, t - last_tgt AS seconds_since_tgt, CASE WHEN asked > 0 THEN got / asked::DOUBLE ELSE 0.0 END AS tgt_coverage, CASE WHEN n_before > 0 THEN k_before / n_before::DOUBLE ELSE 0.0 END AS kerberos_share FROM k2)"""


@registered("g09_tgt_context", f"{DENSE_SQL}{TGT_CTE} SELECT event_id, seconds_since_tgt, {r6('tgt_coverage')} FROM k")
def g09(spark, sf_dir):
    return rounded(tactics.tgt_context(auth_dense(spark, sf_dir)), "event_id", "seconds_since_tgt", "tgt_coverage")


@registered("g10_kerberos_share", f"{DENSE_SQL}{TGT_CTE} SELECT event_id, {r6('kerberos_share')} FROM k")
def g10(spark, sf_dir):
    return rounded(tactics.kerberos_share(auth_dense(spark, sf_dir)), "event_id", "kerberos_share")


TACTIC_FEATURES = ["user_failure_rate_15m", "failures_before_success_15m", "user_unique_dst_24h", "user_new_dst_ratio_1h", "rare_logon_score", "dst_historical_degree", "user_historical_degree", "user_seen_before", "pair_rarity"]


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense events scored and classified; what the stream says of an event goes with it through the features, so that nothing is joined."""
    rows = features.with_features(tactics.stream_context(auth_dense(spark, sf_dir)), [*NEEDED, *TACTIC_FEATURES])
    return tactics.classify(fusion.scored_events(rules.chain_flags(rows)))


def _ramp(x: str, lo: float, hi: float) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x} - {lo}) / {hi - lo}::DOUBLE))"


def _sum(*terms: str) -> str:
    return "least(1.0::DOUBLE, " + " + ".join(f"CASE WHEN {on} THEN {w} ELSE 0.0 END::DOUBLE" for on, w in (t.split(" => ") for t in terms)) + ")"


_NEW, _RARE, _PIVOT, _BURST = "is_new_pair = 1", "dst_historical_degree <= 3", "pivot_signal >= 1.0", "user_unique_dst_5m"
_DAY, _OWN = "user_unique_dst_5m / greatest(1.0::DOUBLE, user_unique_dst_24h::DOUBLE)", "user_unique_dst_5m / greatest(1.0::DOUBLE, user_historical_degree::DOUBLE)"
_LATE, _NOTGT = "coalesce(seconds_since_tgt > 36000, false)", "seconds_since_tgt IS NULL AND tgt_coverage >= 0.5"
_TECHNIQUES = {
    "T1021": (f"chain_hop = 1 OR {_ramp('src_host_unique_dst_1h', 4, 12)} > 0", _sum("chain_hop = 1 => 1.0", f"{_ramp('src_host_unique_dst_1h', 4, 12)} > 0 => 0.55::DOUBLE * {_ramp('src_host_unique_dst_1h', 4, 12)}", f"{_NEW} => 0.2", f"{_RARE} => 0.15", f"{_PIVOT} => 0.1", "logon_id IN (1, 3) => 0.05")),
    "T1110": ("true", _sum(f"user_failure_rate_15m > 0.2 => 0.45::DOUBLE * {_ramp('user_failure_rate_15m', 0.2, 3.0)}", f"failures_before_success_15m > 0 => 0.4::DOUBLE * {_ramp('failures_before_success_15m', 1, 8)}", f"user_failure_rate_15m > 0 AND {_BURST} >= 3 => 0.2::DOUBLE * {_ramp(_BURST, 3, 15)}", "logon_id = 2 => 0.1")),
    "T1087": ("true", _sum(f"{_BURST} > 4 => 0.4::DOUBLE * {_ramp(_BURST, 4, 20)}", f"{_DAY} > 0.3 AND {_BURST} >= 3 => 0.25::DOUBLE * {_ramp(_DAY, 0.3, 1.0)}", f"user_new_dst_ratio_1h > 0.5 => 0.25::DOUBLE * {_ramp('user_new_dst_ratio_1h', 0.5, 1.0)}", f"orient_name = 'TGS' AND {_BURST} >= 4 => 0.15")),
    "T1078": (f"{_NEW} AND success = 1 AND failures_before_success_15m = 0 AND (destination_novelty > 0.7 OR {_RARE})", _sum("true => 0.45", f"rare_logon_score > 0.5 => 0.2::DOUBLE * {_ramp('rare_logon_score', 0.5, 1.0)}", f"destination_novelty > 0.7 => 0.15::DOUBLE * {_ramp('destination_novelty', 0.7, 1.0)}", f"{_RARE} => 0.12", "user_seen_before = 1 AND pair_rarity > 0.5 => 0.1")),
    "T1550.003": (f"orient_name = 'TGS' AND ({_LATE} OR {_NOTGT})", _sum(f"{_NOTGT} => 0.55", f"{_LATE} => 0.35", f"{_NEW} => 0.2", f"{_RARE} => 0.1")),
    "T1078.002": (f"usr % 7 = 0 AND (logon_id = 0 OR {_NEW} OR ({_BURST} >= 3 AND {_OWN} > 0.4))", _sum("logon_id = 0 => 0.6", f"{_BURST} >= 3 AND {_OWN} > 0.4 => 0.25", f"{_NEW} => 0.15")),
    "T1550.002": ("auth_name = 'NTLM' AND kerberos_share >= 0.5", _sum(f"true => 0.35::DOUBLE * {_ramp('kerberos_share', 0.5, 0.95)}", f"{_NEW} => 0.3", f"{_PIVOT} => 0.2", f"{_RARE} => 0.1")),
}
_SCORE = {k: "score_" + k.replace(".", "_") for k in _TECHNIQUES}
TACTIC_CTE = (
    SCORE_CTE + TGT_CTE + ", q0 AS (SELECT s.*, k.seconds_since_tgt, k.tgt_coverage, k.kerberos_share FROM s JOIN k ON k.event_id = s.event_id), q1 AS (SELECT *, "
    + ", ".join(f"round(CASE WHEN {gate} THEN {score} ELSE 0.0 END::DOUBLE, 9) AS {_SCORE[k]}" for k, (gate, score) in _TECHNIQUES.items())
    + " FROM q0), q2 AS (SELECT *, list_sort(list_filter([" + ", ".join(f"{{'m': -{_SCORE[k]}, 'id': '{k}'}}" for k in _TECHNIQUES) + "], lambda x: x.m <= -0.25)) AS ranked FROM q1), "
    + "q AS (SELECT *, ranked[1].id AS technique, -ranked[1].m AS technique_score, coalesce(-ranked[2].m, 0.0) AS second FROM q2)"
)
for _id, _key in (("T1021", "g01_lateral"), ("T1110", "g02_brute_force"), ("T1087", "g03_discovery"), ("T1078", "g04_valid_accounts"), ("T1550.003", "g05_ticket_abuse"), ("T1078.002", "g06_machine_account"), ("T1550.002", "g07_ntlm_downgrade")):
    ORACLE_SQL[_key] = f"{DENSE_SQL}{TACTIC_CTE} SELECT event_id, {r6(_SCORE[_id])} FROM q"
    QUERIES[_key] = (lambda column: lambda spark, sf_dir: rounded(classified(spark, sf_dir), "event_id", column))(_SCORE[_id])


@registered(
    "g08_classify",
    f"""{DENSE_SQL}{TACTIC_CTE} SELECT event_id, technique, {r6('technique_score')}, CASE WHEN technique IS NULL THEN 'none' WHEN chain_hop = 1 AND technique = 'T1021' THEN 'high'
        WHEN technique_score >= 0.65 AND technique_score - second >= 0.15 THEN 'high' WHEN technique_score >= 0.45 THEN 'medium' ELSE 'low' END AS confidence FROM q""",
)
def g08(spark, sf_dir):
    return rounded(classified(spark, sf_dir), "event_id", "technique", "technique_score", "confidence")
