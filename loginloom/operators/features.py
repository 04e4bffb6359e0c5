"""Causal features of an authentication event: every one sees strictly earlier seconds only.

Input E: event_id, t (seconds), usr, src, dst, logon_id, success. Novelty inside the ratio of new destinations is the one
place where an earlier row of the same second counts (stream order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import distinct_in_window, first_in_stream, open_window, stream_past, strict_past

MINUTE5, MINUTE15, HOUR, DAY = 300, 900, 3_600, 86_400


def hour_columns():
    hour = F.floor(F.pmod(F.col("t"), F.lit(DAY)) / HOUR)
    angle = 2 * F.pi() * hour / 24
    return {"hour_sin": F.sin(angle), "hour_cos": F.cos(angle)}


def _n(spec, on: Column | None) -> Column:
    return F.count("*" if on is None else F.when(on, 1)).over(spec)


def _of(value, on: Column | None) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value if on is None else F.when(on, value)


def since(*keys: str, on: Column | None = None):
    """log(1 + seconds since the keys' last event), 0 if there was none."""
    last = F.max(_of("t", on)).over(strict_past(*keys))
    return F.coalesce(F.log1p((F.col("t") - last).cast("double")), F.lit(0.0))


def seen(*keys: str, on: Column | None = None):
    return (_n(strict_past(*keys), on) > 0).cast("int")


def pair_rarity(on: Column | None = None):
    return 1 / F.sqrt(_n(strict_past("usr", "dst"), on) + 1.0)


def user_failure_rate_15m(on: Column | None = None):
    return F.coalesce(F.avg(_of(1.0 - F.col("success"), on)).over(open_window(MINUTE15, "usr")), F.lit(0.0))


def failures_before_success_15m(on: Column | None = None):
    failed = F.coalesce(F.sum(_of(1 - F.col("success"), on)).over(open_window(MINUTE15, "usr")), F.lit(0))
    return F.when(F.col("success") == 1, failed).otherwise(0).cast("long")


def rare_logon_score(on: Column | None = None):
    """-ln((n of user and logon + 1) / (n of user + kinds + 1)); kinds are the user's past distinct logon types."""
    kinds = F.coalesce(F.sum("_first_logon").over(strict_past("usr")), F.lit(0))
    return -F.log((F.col("_past_logon") + 1.0) / (_n(strict_past("usr"), on) + kinds + 1.0))


def past_firsts(flag: str, key: str):
    """How many distinct partners the key has had: the sum of first sightings in its strict past."""
    return F.coalesce(F.sum(flag).over(strict_past(key)), F.lit(0)).cast("long")


def first_sighting(*keys: str, on: Column | None = None) -> Column:
    """1 on the first row of the keys in stream order, of the rows that count."""
    if on is None:
        return first_in_stream(*keys)
    return (on & (_n(stream_past(*keys), on) == 0)).cast("int")


#: By the key whose shuffle they need: first sightings and features over the key and a partner, by partner; features over the key
#: alone; and features that count distinct partners in open windows (partner, {feature: seconds}). The windows of a key and partner
#: share one sort by time and event_id, so the partner whose times are counted comes last in PAIRS and first in DISTINCT. A flag is made
#: where it is needed first.
FLAGS = {"usr": {"logon_id": "_first_logon", "dst": "_first_pair"}, "src": {"dst": "_first_hosts"}, "dst": {"usr": "_first_pair"}}
PAIRS = {
    "usr": {
        "src": {"user_src_seen_before": lambda on: seen("usr", "src", on=on)},
        "logon_id": {"_past_logon": lambda on: _n(strict_past("usr", "logon_id"), on)},
        "dst": {
            "delta_pair_log": lambda on: since("usr", "dst", on=on),
            "pair_seen_before": lambda on: seen("usr", "dst", on=on),
            "is_new_pair": lambda on: 1 - seen("usr", "dst", on=on),
            "pair_frequency_1h": lambda on: _n(open_window(HOUR, "usr", "dst"), on),
            "pair_rarity": pair_rarity,
        },
    },
    "src": {"dst": {"src_dst_seen_before": lambda on: seen("src", "dst", on=on)}},
    "dst": {"usr": {}},
}
EXPRESSIONS = {
    "usr": {
        "delta_user_log": lambda on: since("usr", on=on),
        "user_seen_before": lambda on: seen("usr", on=on),
        "user_auth_rate_5m": lambda on: _n(open_window(MINUTE5, "usr"), on),
        "user_failure_rate_15m": user_failure_rate_15m,
        "failures_before_success_15m": failures_before_success_15m,
        "user_new_dst_ratio_1h": lambda on: F.coalesce(F.avg(_of("_first_pair", on)).over(open_window(HOUR, "usr")), F.lit(0.0)),
        "user_historical_degree": lambda on: past_firsts("_first_pair", "usr"),
        "rare_logon_score": rare_logon_score,
    },
    "src": {
        "src_host_historical_degree": lambda on: past_firsts("_first_hosts", "src"),
    },
    "dst": {
        "destination_novelty": lambda on: 1 / (past_firsts("_first_pair", "dst") + 1.0),
        "dst_historical_degree": lambda on: past_firsts("_first_pair", "dst"),
    },
}
DISTINCT = {
    "usr": [("dst", {"user_unique_dst_5m": MINUTE5, "user_unique_dst_1h": HOUR, "user_unique_dst_24h": DAY})],
    "src": [("dst", {"src_host_unique_dst_1h": HOUR}), ("usr", {"src_host_unique_users_1h": HOUR})],
    "dst": [("usr", {"dst_inbound_users_1h": HOUR})],
}
NEEDS = {"_first_pair": {"user_new_dst_ratio_1h", "destination_novelty", "user_historical_degree", "dst_historical_degree"}, "_first_hosts": {"src_host_historical_degree"}, "_first_logon": {"rare_logon_score"}, "_past_logon": {"rare_logon_score"}}
#: The order in which feature tables have their columns.
ORDER = "delta_user_log delta_pair_log user_seen_before pair_seen_before is_new_pair pair_frequency_1h pair_rarity user_auth_rate_5m user_failure_rate_15m failures_before_success_15m user_new_dst_ratio_1h user_historical_degree rare_logon_score user_src_seen_before src_host_historical_degree src_dst_seen_before destination_novelty dst_historical_degree".split()
COUNTED = [n for counts in DISTINCT.values() for _, windows in counts for n in windows]
ALL = ["hour_sin", "hour_cos", *ORDER, *COUNTED]


def with_features(events: DataFrame, names: list[str], on: Column | None = None) -> DataFrame:
    """events with the named features, after one shuffle for each of account, source and destination that they need.

    on: the rows that make history, all if None. Other rows get their features from these and leave no trace.
    """
    rows, wanted = events, lambda n: bool(NEEDS.get(n, {n}) & set(names))
    # a number of partitions, as small ones must not be merged: the sorts of a task hold all keys of its partition
    n_parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the account's features are the most, so they come last and the shuffles and sorts of the others don't carry them
    for key in ("dst", "src", "usr"):
        flags = {partner: f for partner, f in FLAGS[key].items() if wanted(f) and f not in rows.columns}
        pairs = {partner: {n: f for n, f in some.items() if wanted(n)} for partner, some in PAIRS[key].items()}
        counts = [(partner, {n: w for n, w in windows.items() if n in names}, on) for partner, windows in DISTINCT[key]]
        counts = [c for c in counts if c[1]]
        made = {n: f for n, f in EXPRESSIONS[key].items() if n in names}
        if not (counts or made or any(pairs.values())):
            continue
        rows = rows.repartition(n_parts, key)
        for partner, some in pairs.items():
            if partner in flags:
                rows = rows.withColumn(flags[partner], first_sighting(key, partner, on=on))
            if some:
                rows = rows.withColumns({n: f(on) for n, f in some.items()})
        if counts:
            rows = distinct_in_window(rows, key, counts, dealt=True)
        rows = rows.withColumns({n: f(on) for n, f in made.items()}) if made else rows
    hours = {n: c for n, c in hour_columns().items() if n in names}
    rows = rows.withColumns(hours) if hours else rows
    return rows.select(*events.columns, *names)


def causal_features(events: DataFrame) -> DataFrame:
    return with_features(events, ALL)


def coverage(events: DataFrame) -> DataFrame:
    """What a feature state holds: counts of known users, hosts and pairs, and the last time."""
    return events.agg(
        F.count("*").alias("n_events"),
        F.count_distinct("usr").alias("n_users"),
        F.count_distinct("src").alias("n_sources"),
        F.count_distinct("dst").alias("n_destinations"),
        F.count_distinct("usr", "dst").alias("n_pairs"),
        F.max("t").alias("last_t"),
    )


def with_probes(events: DataFrame, probes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """events, and probes as they would have been among them, with features (all, if not named) and _real, false for probes.

    Both see the history of real events only, in the same pass. probes: the columns of events, with event_ids of their own, and
    others, which are kept and null for events.
    """
    both = events.withColumn("_real", F.lit(True)).unionByName(probes.withColumn("_real", F.lit(False)), allowMissingColumns=True)
    return with_features(both, names or ALL, on=F.col("_real"))


def featurise_probes(events: DataFrame, probes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Features (all, if not named) that probe events would have had against the history of real ones; probes add nothing to it.

    probes: the columns of events, with event_ids of their own, and others that are kept.
    """
    return with_probes(events, probes, names).filter(~F.col("_real")).drop("_real")


#: Kinds of probes of one sampled event, and how many of each.
PROBE_PLAN = (("dst_popular", 2), ("dst_uniform", 1), ("src_popular", 2))


def picked(share: float, seed: int) -> Column:
    """Whether an event is of the hashed share."""
    return F.pmod(F.xxhash64(F.lit(seed), "event_id"), F.lit(1_000_000)) < int(share * 1_000_000)


def counterfactuals(events: DataFrame, share: float = 0.02, seed: int = 1729, plan=PROBE_PLAN) -> DataFrame:
    """Probes: the columns of events, kind, real_id; a hashed share of events, each with one end replaced, once for each of plan.

    A popular end is that of a hashed event of the same day, a uniform one any host seen up to that day. A probe that would
    be the real pair or a loop is drawn again from those hosts. Instead of drawing until it fits, one draw goes over the
    hosts that fit, which has the same distribution; only a day that knows no third host has no probe. Ids are negative.
    """
    from .windows import global_position

    kinds = [kind for kind, n in plan for _ in range(n)]
    day = F.floor(F.col("t") / DAY)
    hashed = lambda what, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "real_id", "_j"), n)
    # events in order of days, hosts in order of the days that they were first seen on
    drawn = global_position(events.select(day.alias("_day"), "event_id", "src", "dst"), ["_day", "event_id"], "_at")
    days = drawn.groupBy("_day").agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    hosts = events.select(day.alias("_day"), F.explode(F.array("src", "dst")).alias("host")).groupBy("host").agg(F.min("_day").alias("_day"))
    hosts = global_position(hosts, ["_day", "host"], "_rank").select("host", "_day", "_rank")
    known = days.select("_day").join(hosts.groupBy("_day").agg(F.max("_rank").alias("_last")), "_day", "left")
    days = days.join(known.withColumn("_hosts", F.max("_last").over(Window.partitionBy(F.lit(0)).orderBy("_day")) + 1).select("_day", "_hosts"), "_day")

    plans = F.explode(F.array(*[F.struct(F.lit(j).alias("_j"), F.lit(kind).alias("kind")) for j, kind in enumerate(kinds)])).alias("_p")
    rows = events.filter(picked(share, seed)).select("*", day.alias("_day"), F.col("event_id").alias("real_id"), plans).select("*", "_p._j", "_p.kind").drop("_p").join(F.broadcast(days), "_day")
    rows = rows.withColumn("_at", F.col("_start") + hashed("popular", F.col("_n")))
    rows = rows.join(drawn.select("_at", F.col("src").alias("_p_src"), F.col("dst").alias("_p_dst")), "_at")
    first = F.when(F.col("kind") == "dst_popular", F.col("_p_dst")).when(F.col("kind") == "src_popular", F.col("_p_src"))
    rows = rows.withColumn("_end", F.when((first != F.col("src")) & (first != F.col("dst")), first))
    for end in ("src", "dst"):
        rows = rows.join(hosts.select(F.col("host").alias(end), F.col("_rank").alias(f"_rank_{end}")), end)
    low, high = F.least("_rank_src", "_rank_dst"), F.greatest("_rank_src", "_rank_dst")
    fit = F.col("_hosts") - F.when(low == high, 1).otherwise(2)
    rows = rows.filter(F.col("_end").isNotNull() | (fit > 0)).withColumn("_draw", hashed("uniform", F.greatest(fit, F.lit(1))))
    rows = rows.withColumn("_draw", F.col("_draw") + (F.col("_draw") >= low).cast("int"))
    rows = rows.withColumn("_draw", F.col("_draw") + ((low != high) & (F.col("_draw") >= high)).cast("int"))
    rows = rows.join(hosts.select(F.col("_rank").alias("_draw"), F.col("host").alias("_other")), "_draw", "left").withColumn("_end", F.coalesce("_end", "_other"))
    is_src = F.col("kind").startswith("src")
    made = {"src": F.when(is_src, F.col("_end")).otherwise(F.col("src")), "dst": F.when(is_src, F.col("dst")).otherwise(F.col("_end")), "event_id": -1 - (F.col("event_id") * len(kinds) + F.col("_j"))}
    return rows.withColumns(made).select(*events.columns, "kind", "real_id")


def eda(events: DataFrame, top_k: int = 10) -> DataFrame:
    """metric, key, value: totals, distinct entities, hourly counts and the busiest users and destinations."""
    total = events.agg(F.count("*").alias("events"), F.sum("label").alias("positives"), F.sum(1 - F.col("success")).alias("failures"), F.count_distinct("usr").alias("users"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("destinations"))
    parts = [total.select(F.expr("stack(6, 'events', events, 'positives', positives, 'failures', failures, 'users', users, 'sources', sources, 'destinations', destinations) AS (metric, value)")).select("metric", F.lit("").alias("key"), F.col("value").cast("long"))]
    hour = F.floor(F.pmod("t", F.lit(DAY)) / HOUR).cast("string")
    parts.append(events.groupBy(hour.alias("key")).count().select(F.lit("hour").alias("metric"), "key", F.col("count").alias("value")))
    for name in ("usr", "dst"):
        busiest = events.groupBy(name).count().orderBy(F.desc("count"), name).limit(top_k)
        parts.append(busiest.select(F.lit(f"top_{name}").alias("metric"), F.col(name).cast("string").alias("key"), F.col("count").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


COUNT_FEATURES = ("pair_frequency_1h", "user_auth_rate_5m", "user_historical_degree", "dst_historical_degree")


def fit_scaler(features: DataFrame, columns: list[str], kind: str = "robust") -> DataFrame:
    """feature, center, scale: median and interquartile range, or mean and population deviation of log counts."""
    if kind == "robust":
        row = features.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in columns])
        pick = [F.struct(F.lit(c).alias("feature"), F.col(c)[1].cast("double").alias("center"), F.greatest(F.col(c)[2] - F.col(c)[0], F.lit(1e-6)).alias("scale")) for c in columns]
    else:
        value = lambda c: F.log1p(F.col(c).cast("double")) if c in COUNT_FEATURES else F.col(c).cast("double")
        row = features.agg(*[F.struct(F.avg(value(c)).alias("m"), F.stddev_pop(value(c)).alias("s")).alias(c) for c in columns])
        pick = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}.m").alias("center"), F.when(F.col(f"{c}.s") < 1e-6, 1.0).otherwise(F.col(f"{c}.s")).alias("scale")) for c in columns]
    return row.select(F.explode(F.array(*pick)).alias("r")).select("r.*")


def apply_scaler(features: DataFrame, scaler: DataFrame, clip: float, logs: bool = False) -> DataFrame:
    """The scaler's columns centred, scaled and clipped; the scaler has a row for each feature."""
    made = {}
    for r in scaler.collect():
        x = F.log1p(F.col(r.feature).cast("double")) if logs and r.feature in COUNT_FEATURES else F.col(r.feature).cast("double")
        made[r.feature] = F.greatest(F.lit(-clip), F.least(F.lit(clip), (x - r.center) / r.scale))
    return features.withColumns(made)
