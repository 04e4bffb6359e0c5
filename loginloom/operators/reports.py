"""Feedback, gates, rank statistics, categories, telemetry: table work around detection, evaluation and response."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from .studies import ACTIONS
from .windows import global_position

HOUR, DAY = 3_600, 86_400


def chronological(events: DataFrame) -> DataFrame:
    """events with `position`, from 0, by (t, event_id): range partitions numbered apart."""
    return global_position(events, ["t", "event_id"])


def resolve_ids(names: DataFrame, dictionary: DataFrame, kind: str, capacity: int, buckets: int) -> DataFrame:
    """name, id: that of the dictionary (name, id), else a bucket behind `capacity` by a hash of kind and name, or 0 for categories."""
    bucket = F.lit(0).cast("long") if kind == "category" else scalars.oov_bucket(kind, F.coalesce("name", F.lit("")), capacity, buckets)
    known = dictionary.select(F.col("name").alias("known"), "id")
    return names.join(known, F.col("name") == F.col("known"), "left").select("name", F.coalesce(F.col("id").cast("long"), bucket).alias("id"))


def ingest_summary(events: DataFrame) -> DataFrame:
    """kind, key, value: events, users, hosts, failures, span, and a count for each event id."""
    hosts = events.select(F.explode(F.array("src", "dst")).alias("host")).agg(F.count_distinct("host").alias("hosts"))
    total = events.agg(F.count("*").alias("events"), F.count_distinct("usr").alias("users"), F.sum(1 - F.col("success")).alias("failures"), (F.max("t") - F.min("t")).alias("span"))
    one = total.select(F.lit("total").alias("kind"), F.expr("stack(4, 'events', events, 'users', users, 'failures', failures, 'span', span) AS (key, value)"))
    return one.union(hosts.select(F.lit("total"), F.lit("hosts"), "hosts")).union(events.groupBy("code").count().select(F.lit("code"), F.col("code").cast("string"), "count"))


def process_novelty(events: DataFrame, starts: DataFrame) -> DataFrame:
    """event_id, dst_new_5m, dst_new_30m, src_new_1h, user_new_1h: processes first seen on a host, or of a user, around an event.

    starts: t, usr, host, process. A first start is the least time of its pair. Counts in (a, b] are differences of two
    prefix counts over the union of first starts and window ends; nothing is joined by inequality.
    """
    hosts = starts.groupBy("host", "process").agg(F.min("t").alias("t")).select(F.lit("host").alias("kind"), F.col("host").alias("key"), "t")
    users = starts.groupBy("usr", "process").agg(F.min("t").alias("t")).select(F.lit("user"), F.col("usr"), "t")
    spans = (("dst_new_5m", "host", "dst", 0, 300), ("dst_new_30m", "host", "dst", 0, 1_800), ("src_new_1h", "host", "src", -HOUR, 0), ("user_new_1h", "user", "usr", -HOUR, 300))
    ends = [F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key"), (F.col("t") + at).alias("t"), F.lit(name).alias("name"), F.lit(sign).alias("sign")) for name, kind, c, a, b in spans for at, sign in ((a, -1), (b, 1))]
    asked = events.select("event_id", F.explode(F.array(*ends)).alias("e")).select("e.kind", "e.key", "e.t", "event_id", "e.name", "e.sign", F.lit(0).alias("new"))
    first = hosts.union(users).select("kind", "key", "t", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("sign"), F.lit(1).alias("new"))
    upto = Window.partitionBy("kind", "key").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    counted = first.union(asked).withColumn("n", F.sum("new").over(upto)).filter("event_id IS NOT NULL")
    return counted.groupBy("event_id").agg(*[F.sum(F.when(F.col("name") == name, F.col("n") * F.col("sign")).otherwise(0)).alias(name) for name, *_ in spans])


def technique_metrics(rows: DataFrame) -> DataFrame:
    """One row for each technique that is injected or claimed: injected, alerted, attributed, attributed_other, false_attributions,
    detection_recall, attribution_recall, precision, false_per_10k.

    rows: truth (null for benign), technique (what was attributed), confidence, alerted. A claim is an attribution of high or medium
    confidence, whether or not the event alerted; a false one is a claim on a benign event. Precision is correct claims over correct
    and false ones: claims on another technique's events stand in that one's attributed_other. Shares of nothing are 0.
    """
    sure = F.col("confidence").isin("high", "medium") & F.col("technique").isNotNull()
    seen = rows.select("truth", F.when(sure, F.col("technique")).alias("claim"), (F.col("alerted") == 1).alias("alerted"))
    benign = seen.agg(F.count_if(F.col("truth").isNull()).alias("benign"))
    roles = F.array(F.struct(F.col("truth").alias("id"), F.lit(True).alias("is_truth")), F.struct(F.col("claim").alias("id"), F.lit(False).alias("is_truth")))
    each = seen.select("truth", "claim", "alerted", F.explode(roles).alias("role")).filter("role.id IS NOT NULL")
    injected, right = F.col("role.is_truth"), F.col("claim").eqNullSafe(F.col("truth"))
    by = each.groupBy(F.col("role.id").alias("technique")).agg(
        F.count_if(injected).alias("injected"),
        F.count_if(injected & F.col("alerted")).alias("alerted"),
        F.count_if(injected & right).alias("attributed"),
        F.count_if(injected & ~right & F.col("claim").isNotNull()).alias("attributed_other"),
        F.count_if(~injected & F.col("truth").isNull()).alias("false_attributions"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = by.join(F.broadcast(benign))
    correct, false = F.col("attributed"), F.col("false_attributions")
    return out.select("technique", "injected", "alerted", "attributed", "attributed_other", "false_attributions", share(F.col("alerted"), F.col("injected")).alias("detection_recall"), share(correct, F.col("injected")).alias("attribution_recall"), share(correct, correct + false).alias("precision"), share(10_000 * false, F.col("benign")).alias("false_per_10k"))


def combine_percentiles(members: DataFrame, names: list[str], how: str = "mean") -> DataFrame:
    """members (event_id and percentiles) with `combined`: the mean (or the `max`) of the members, as a percentile of all of these."""
    mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names) if how == "mean" else F.greatest(*names)
    rows = members.withColumn("mean", F.round(mean, 9))
    # equal means share a place: counts per mean, then a running total over the ordered means
    counts = rows.groupBy("mean").agg(F.count("*").alias("n"))
    from .windows import running_totals

    total = members.count()
    below = running_totals(counts, "mean", ["n"]).select("mean", (F.col("cum_n") / F.lit(float(max(total, 1)))).alias("combined"))
    return rows.join(below, "mean").select("event_id", "combined")


def rank_statistics(scores: DataFrame) -> DataFrame:
    """event_id, above, tied: for each positive, the benign rows strictly above it and level with it.

    scores: event_id, score, label. Benign counts are taken per score and summed from the top over range partitions.
    """
    from .windows import running_totals

    blocks = scores.groupBy("score").agg(F.sum(1 - F.col("label")).cast("long").alias("benign"))
    upto = running_totals(blocks, "score", ["benign"], descending=True)
    return scores.filter("label = 1").join(upto, "score").select("event_id", "score", (F.col("cum_benign") - F.col("benign")).alias("above"), F.col("benign").alias("tied"))


def exact_auc_ap(scores: DataFrame) -> DataFrame:
    """roc_auc, ap of all rows, exact also with ties, from the statistics of the positives."""
    from .windows import running_totals

    n_benign = scores.agg(F.sum(1 - F.col("label"))).first()[0] or 0
    pos = rank_statistics(scores)
    levels = running_totals(pos.groupBy("score", "above", "tied").agg(F.count("*").alias("n")), "score", ["n"], descending=True)
    won = F.sum(F.col("n") * (n_benign - F.col("above") - 0.5 * F.col("tied"))) / (F.sum("n") * n_benign)
    ap = F.sum(F.col("n") * F.col("cum_n") / (F.col("cum_n") + F.col("above") + F.col("tied"))) / F.sum("n")
    return levels.agg(won.alias("roc_auc"), ap.alias("ap"))


def truth_match(events: DataFrame, truth: DataFrame) -> DataFrame:
    """events with `attack`: whether its recording's truth (accounts, targets, sources) holds it; an empty list holds anyone, but for targets."""
    rows = events.join(truth, "recording", "left")
    any_of = lambda c, v: (F.size(c) == 0) | F.array_contains(c, F.col(v))
    hit = any_of("accounts", "usr") & F.array_contains("targets", F.col("dst")) & any_of("sources", "src")
    return rows.select("event_id", "recording", F.coalesce(hit.cast("int"), F.lit(0)).alias("attack"))


def hop_latency(hops: DataFrame) -> DataFrame:
    """campaign, family, interval, hops, first_alert_hop, first_action_hop, prevented, prevented_account of each campaign.

    hops: campaign, family, interval, hop (from 1), usr, alerted, acted. An action stops the rest of its campaign (prevented),
    or only what its account would have gone on to do (prevented_account).
    """
    first = lambda c: F.min(F.when(F.col(c) == 1, F.col("hop")))
    rows = hops.withColumn("_stopped", first("acted").over(Window.partitionBy("campaign", "usr")))
    rows = rows.groupBy("campaign", "family", "interval").agg(F.max("hop").alias("hops"), first("alerted").alias("first_alert_hop"), first("acted").alias("first_action_hop"), F.count_if(F.col("hop") > F.col("_stopped")).alias("prevented_account"))
    return rows.withColumn("prevented", F.coalesce(F.col("hops") - F.col("first_action_hop"), F.lit(0)))


def latency_summary(campaigns: DataFrame) -> DataFrame:
    """by (all, family, interval), value, and over the campaigns of hop_latency: campaigns, detected, detection_rate, median and mean
    first alert, and the prevented share of all hops in both meanings: one pass with grouping sets."""
    share = lambda c: F.sum(c) / F.sum("hops")
    detected = F.count("first_alert_hop")
    rows = campaigns.groupingSets([[], ["family"], ["interval"]], "family", "interval").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("campaigns"),
        detected.alias("detected"),
        (detected / F.count("*")).alias("detection_rate"),
        F.percentile("first_alert_hop", 0.5).alias("median_latency"),
        F.avg("first_alert_hop").alias("mean_latency"),
        share("prevented").alias("prevented_campaign"),
        share("prevented_account").alias("prevented_account"),
    )
    by = F.when(F.col("level") == 3, "all").when(F.col("level") == 1, "family").otherwise("interval")
    return rows.select(by.alias("by"), F.coalesce(F.col("family").cast("string"), F.col("interval").cast("string")).alias("value"), *[c for c in rows.columns if c not in ("family", "interval", "level")])


def benign_cost(events: DataFrame) -> DataFrame:
    """benign_events, alerted, acted, users_hit and both rates per 10,000 of events (usr, alerted, acted) outside campaigns."""
    on = lambda c: F.col(c) == 1
    rows = events.agg(F.count("*").alias("benign_events"), F.count_if(on("alerted")).alias("alerted"), F.count_if(on("acted")).alias("acted"), F.count_distinct(F.when(on("acted"), F.col("usr"))).alias("users_hit"))
    rate = lambda c: F.coalesce(F.try_divide(10_000 * F.col(c), F.col("benign_events")), F.lit(0.0))
    return rows.withColumns({"alerted_per_10k": rate("alerted"), "acted_per_10k": rate("acted")})


def feedback_labels(records: DataFrame) -> DataFrame:
    """alert_id, label, source, decided_by, decided_at: one verdict for each alert that analysts have settled.

    records: seq, alert_id, action, outcome, authority, approved_by, t, output. An approved disruptive action or a kept lock
    confirms; a lift by a person is benign, and so is the rejection of every action that was pending; a confirmation wins,
    then a lift, the latest record (by seq) of its kind counts, of rejections the latest by time.
    """
    disruptive = F.col("action").isin(*[a for a, (_, _, d) in ACTIONS.items() if d > 0])
    approved = (F.col("authority") == "approval") & F.col("outcome").isin("dry_run", "executed") & disruptive
    kept = F.col("outcome") == "kept"
    actor = F.nullif(F.trim(F.regexp_extract(F.coalesce("output", F.lit("")), r"^(?:lifted by|reverted by) (.*)$", 1)), F.lit(""))
    lifted = (F.col("outcome") == "reverted") & actor.isNotNull()
    kind = F.when(approved | kept, 3).when(lifted, 2).when(F.col("outcome") == "rejected", 1)
    source = F.when(approved, F.concat(F.lit("approved "), "action")).when(kept, F.lit("kept the lock")).when(lifted, F.concat(F.lit("lifted "), "action")).otherwise("rejected every action")
    settled = F.struct(source.alias("source"), F.when(lifted, actor).otherwise(F.col("approved_by")).alias("decided_by"), F.col("t").alias("decided_at"))
    latest = F.when(kind == 1, F.struct(kind.alias("kind"), F.col("t").alias("t"), -F.col("seq"))).otherwise(F.struct(kind.alias("kind"), F.col("seq").alias("t"), -F.col("seq")))
    of = lambda outcome: F.collect_set(F.when(F.col("outcome") == outcome, F.col("action")))  # noqa: E731  an alert has few actions
    by = records.groupBy("alert_id").agg(F.max_by(settled, F.when(kind.isNotNull(), latest)).alias("v"), F.max(kind).alias("kind"), F.array_except(of("pending_approval"), of("rejected")).alias("open"))
    return by.filter("kind > 1 OR (kind = 1 AND size(open) = 0)").select("alert_id", (F.col("kind") == 3).cast("int").alias("label"), "v.source", "v.decided_by", "v.decided_at")


def training_rows(verdicts: DataFrame, alerts: DataFrame, features: DataFrame, background: int, columns: list[str]) -> DataFrame:
    """event_id, label, kind and features: the alerts with a verdict, and one in `background` of the other events as benign rows."""
    labelled = alerts.join(verdicts.select("alert_id", "label"), "alert_id").select("event_id", "label")
    own = features.select("event_id", *columns)
    judged = own.join(labelled, "event_id").withColumn("kind", F.lit("feedback"))
    drawn = F.pmod(F.pmod(F.col("event_id") * F.lit(2_654_435_761), F.lit(1 << 32)), F.lit(background)) == 0  # a multiplicative hash
    rest = own.filter(drawn).join(alerts.select("event_id"), "event_id", "left_anti").withColumns({"label": F.lit(0), "kind": F.lit("background")})
    return judged.select("event_id", "label", "kind", *columns).union(rest.select("event_id", "label", "kind", *columns))


def budget_gate(actions: DataFrame, per_hour: int = 20, cooldown: int = HOUR) -> DataFrame:
    """event_id, verdict (allowed, hourly, cooldown) of unattended actions (tenant, t, event_id, usr) in stream order.

    At most per_hour an hour in a tenant, and one an account in `cooldown`; a row whose `escalation`, if there is that column, is 1 is another
    rung on an account that was acted on, so only the hourly limit holds it. What is allowed depends on what was before, so
    it is replayed; a pause longer than both windows forgets all, so a tenant's stream is cut there, and each part is a
    group of its own.
    """
    pause = max(HOUR, cooldown)
    w = Window.partitionBy("tenant").orderBy("t", "event_id")
    opens = F.coalesce((F.col("t") - F.lag("t").over(w) >= pause).cast("int"), F.lit(0))
    rung = F.coalesce(F.col("escalation").cast("int"), F.lit(0)) if "escalation" in actions.columns else F.lit(0)
    parts = actions.select("tenant", "t", "event_id", "usr", rung.alias("rung")).withColumn("_opens", opens).withColumn("part", F.sum("_opens").over(w)).drop("_opens")

    def replay(frame):
        import bisect

        import pandas as pd

        spent: list[int] = []
        last: dict[int, int] = {}
        out = []
        for t, event_id, usr, rung in sorted(zip(frame["t"], frame["event_id"], frame["usr"], frame["rung"])):
            if len(spent) - bisect.bisect_right(spent, t - HOUR) >= per_hour:
                out.append((event_id, "hourly"))
            elif cooldown and not rung and usr in last and t - last[usr] < cooldown:
                out.append((event_id, "cooldown"))
            else:
                out.append((event_id, "allowed"))
                spent.append(t)
                last[usr] = t
        return pd.DataFrame(out, columns=["event_id", "verdict"])

    return parts.groupBy("tenant", "part").applyInPandas(replay, "event_id long, verdict string")


def host_ranking(scores: DataFrame, how: str = "max") -> DataFrame:
    """day, src, host_score, rank: hosts of each day by their best event (max) or by the mean of their three best (mean)."""
    best = F.max("score") if how == "max" else F.aggregate(F.slice(F.sort_array(F.collect_list("score"), False), 1, 3), F.lit(0.0), lambda a, x: a + x) / F.least(F.lit(3), F.count("*"))
    rows = scores.groupBy(F.floor(F.col("t") / DAY).alias("day"), "src").agg(F.round(best, 9).alias("host_score"))
    return rows.withColumn("rank", F.rank().over(Window.partitionBy("day").orderBy(F.desc("host_score"))))


def telemetry_coverage(events: DataFrame, sources: dict[str, str]) -> DataFrame:
    """source, n, available: rows that each telemetry source has, by a condition on the events; sources without rows are missing."""
    sums = events.agg(*[F.count_if(F.expr(on)).alias(name) for name, on in sources.items()])
    stacked = ", ".join(f"'{n}', `{n}`" for n in sources)
    return sums.select(F.expr(f"stack({len(sources)}, {stacked}) AS (source, n)")).withColumn("available", (F.col("n") > 0).cast("int"))


def clock(events: DataFrame) -> DataFrame:
    """events with `day` and `hour` of their time."""
    return events.withColumns({"day": F.floor(F.col("t") / DAY), "hour": F.floor(F.pmod("t", F.lit(DAY)) / HOUR)})


def describe(rows: DataFrame) -> DataFrame:
    """events, attacks, benign, prevalence of labelled rows."""
    sums = rows.agg(F.count("*").alias("events"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("attacks"))
    return sums.select("events", "attacks", (F.col("events") - F.col("attacks")).alias("benign"), (F.col("attacks") / F.greatest(F.lit(1), "events")).alias("prevalence"))


# The numbered kinds of evidence, and what each says of.
EVIDENCE = (("E-001", "observed", "t"), ("E-002", "derived", "is_new"), ("E-003", "derived", "fanout"), ("E-004", "derived", "failures"), ("E-005", "model", "model"), ("E-006", "model", "risk"))


def evidence_rows(alerts: DataFrame, in_paths: DataFrame, sure: float = 0.8) -> DataFrame:
    """event_id, evidence_id, category, value, path_id, cited, technique, confidence: the evidence of each alert, one row an item.

    in_paths: event_id, path_id, score of the best path of each event that stands in one, at any place; such an alert has a seventh item,
    the path and its score. An alert is cited for its technique by its observation, the new relationship, the model and the
    path; confidence is medium in a path from the risk `sure` on, else low.
    """
    rows = alerts.join(in_paths.select("event_id", "path_id", "score"), "event_id", "left")
    none = F.lit(None).cast("string")
    item = lambda k, kind, value, path=none: F.struct(F.lit(k).alias("evidence_id"), F.lit(kind).alias("category"), value.cast("double").alias("value"), path.alias("path_id"))
    items, in_path = F.array(*[item(k, kind, F.col(c)) for k, kind, c in EVIDENCE]), F.col("path_id").isNotNull()
    items = F.when(in_path, F.concat(items, F.array(item("E-007", "derived", F.col("score"), F.col("path_id"))))).otherwise(items)
    rows = rows.select("event_id", F.when(in_path & (F.col("risk") >= sure), "medium").otherwise("low").alias("confidence"), F.explode(items).alias("e"))
    return rows.select("event_id", "e.evidence_id", "e.category", "e.value", "e.path_id", F.col("e.evidence_id").isin("E-001", "E-002", "E-005", "E-007").cast("int").alias("cited"), F.lit("T1021").alias("technique"), "confidence")


def best_paths(paths: DataFrame) -> DataFrame:
    """event_id, path_id, score: for every event of scored paths the best path that holds it, ties to the earlier one."""
    each = paths.select(F.explode("events").alias("event_id"), F.concat_ws("-", "events").alias("path_id"), "score", "first_t", "last_t", "events")
    best = F.min_by(F.struct("path_id", "score"), F.struct(-F.col("score"), "first_t", "last_t", "events"))
    return each.groupBy("event_id").agg(best.alias("b")).select("event_id", "b.path_id", "b.score")
