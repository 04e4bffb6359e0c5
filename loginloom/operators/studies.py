"""Parameter sweeps, detectors without a library of their own, response planning and reports, as table work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import severity
from .windows import earlier_in_window

HOUR, DAY = 3_600, 86_400


def chain_rule_cost(flags: DataFrame, priors: list[int]) -> DataFrame:
    """prior, flags, benign per 10,000, users, caught: the chain rule at each count of prior hops, from one pass."""
    grid = flags.sparkSession.createDataFrame([(p,) for p in priors], "prior int")
    n = flags.count()
    rows = flags.filter("chain_base = 1").join(F.broadcast(grid), F.col("prior_hops") >= F.col("prior"))
    found = rows.groupBy("prior").agg(F.count("*").alias("flags"), F.sum(1 - F.col("label")).alias("benign"), F.count_distinct("usr").alias("users"), F.sum("label").cast("long").alias("caught"))
    return grid.join(found, "prior", "left").fillna(0).select("prior", "flags", (F.col("benign") * 10_000 / F.lit(float(max(n, 1)))).alias("benign_per_10k"), "users", "caught")


def hourly_cost(flags: DataFrame, flag: str) -> DataFrame:
    hour = F.floor(F.pmod("t", F.lit(DAY)) / HOUR)
    return flags.groupBy(hour.alias("hour")).agg(F.count("*").alias("events"), F.sum(F.col(flag) * (1 - F.col("label"))).cast("long").alias("benign_flags"))


def fanout_grid(inputs: DataFrame, accounts: list[int], novel: list[int]) -> DataFrame:
    """accounts, novel, flags, rate: every shape of the rule over one pass, and a small grid."""
    grid = inputs.sparkSession.createDataFrame([(a, b) for a in accounts for b in novel], "min_accounts int, min_novel int")
    n = inputs.count()
    rows = inputs.filter("success = 1 AND dst_novel = 1").join(F.broadcast(grid), (F.col("fanout_accounts") >= F.col("min_accounts")) & (F.col("fanout_novel") >= F.col("min_novel")))
    found = rows.groupBy("min_accounts", "min_novel").agg(F.count("*").alias("flags"))
    return grid.join(found, ["min_accounts", "min_novel"], "left").fillna(0).withColumn("rate", F.col("flags") / F.lit(float(max(n, 1))))


def host_day_rank(scores: DataFrame, attackers: DataFrame) -> DataFrame:
    """day, src, rank of each attacking host among the day's hosts by its mean of three best scores."""
    w = Window.partitionBy("day", "src").orderBy(F.desc("score"), "event_id")
    best = scores.withColumn("day", F.floor(F.col("t") / DAY)).withColumn("_n", F.row_number().over(w)).filter("_n <= 3").groupBy("day", "src").agg(F.round(F.avg("score"), 9).alias("host_score"))
    # ranks count the day's better hosts; hosts of a day are pre-aggregated, events are not ranked
    return best.withColumn("rank", F.rank().over(Window.partitionBy("day").orderBy(F.desc("host_score")))).join(attackers, "src", "left_semi").select("day", "src", "host_score", "rank")


def review_queue(scores: DataFrame, share: float) -> DataFrame:
    """Of each day the best `share` of rows by score, one at least, ties by event_id."""
    rows = scores.withColumn("day", F.floor(F.col("t") / DAY))
    n = rows.groupBy("day").agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("k"))
    w = Window.partitionBy("day").orderBy(F.desc("score"), "event_id")
    return rows.withColumn("_n", F.row_number().over(w)).join(F.broadcast(n), "day").filter("_n <= k").select("day", "event_id", "score")


def lock_policy(alerts: DataFrame, action: float, prior: int = 1, window: int = HOUR, hold: int = 7_200, per_hour: int = 20, by: str = "usr") -> DataFrame:
    """day, benign_locks, benign_accounts, attack_locks, attack_hosts, refused of each day, replayed on its own.

    alerts: event_id, t, usr, src, label, score of the rows above the alert threshold. One above `action` with `prior` earlier
    alerts of its account (or of its source, by="src") in (t - window, t] locks the account for `hold`, unless it is locked
    or there were per_hour locks in the last hour (refused). What may lock is found by windows over all alerts; only these
    rows, which the action budget keeps few, are replayed in order, as the hourly cap ties all accounts of a day together.
    """
    rows = alerts.withColumn("day", F.floor(F.col("t") / DAY))
    ready = rows.withColumn("_prior", earlier_in_window(window, "day", by)).filter((F.col("score") > action) & (F.col("_prior") >= prior))

    def replay(frame):
        import bisect

        import pandas as pd

        taken: list[tuple[int, int, int, int]] = []  # t, usr, src, label of each lock, by time
        until: dict[int, int] = {}
        refused = 0
        for t, _, usr, src, label in sorted(zip(*(frame[c] for c in ("t", "event_id", "usr", "src", "label")))):
            if until.get(usr, t) > t:
                continue
            if len(taken) - bisect.bisect_right(taken, t - HOUR, key=lambda x: x[0]) >= per_hour:
                refused += 1
            else:
                taken.append((t, usr, src, label))
                until[usr] = t + hold
        benign, attack = [x for x in taken if not x[3]], [x for x in taken if x[3]]
        return pd.DataFrame({"day": [frame["day"].iloc[0]], "benign_locks": [len(benign)], "benign_accounts": [len({x[1] for x in benign})], "attack_locks": [len(attack)], "attack_hosts": [len({x[2] for x in attack})], "refused": [refused]})

    schema = "day long, benign_locks long, benign_accounts long, attack_locks long, attack_hosts long, refused long"
    return ready.select("day", "t", "event_id", "usr", "src", "label").groupBy("day").applyInPandas(replay, schema)


def score_rule(x: DataFrame) -> DataFrame:
    """A logistic of capped features."""
    z = 2.0 * F.col("is_new_pair") + 0.3 * F.least(F.col("user_unique_dst_5m").cast("double"), F.lit(10.0)) + 0.5 * F.least(F.col("failures_before_success_15m").cast("double"), F.lit(5.0)) - 3
    return x.withColumn("score", 1 / (1 + F.exp(-z)))


def score_rarity(x: DataFrame) -> DataFrame:
    return x.withColumn("score", 0.50 * F.col("pair_rarity") + 0.25 * F.col("is_new_pair") + 0.15 * F.col("destination_novelty") + 0.10 * F.col("user_new_dst_ratio_1h"))


def percentile_to_risk(p, alert_budget: float = 1e-5, action_budget: float = 1e-6, alert: float = 0.329195, action: float = 0.846394):
    """Piecewise linear: the alert budget's percentile maps to the alert threshold, the action budget's to the action one."""
    a, b = 1 - alert_budget, 1 - action_budget
    return F.when(p < a, p / a * alert).when(p < b, alert + (p - a) / (b - a) * (action - alert)).otherwise(action + (p - b) / (1 - b) * (1 - action))


def fit_classifier(train: DataFrame, columns: list[str], kind: str = "logistic", seed: int = 1729):
    """A Spark ML pipeline, classes weighted to balance."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    counts = train.agg(F.avg("label").alias("p")).first().p or 0.5
    weighted = train.withColumn("weight", F.when(F.col("label") == 1, 0.5 / max(counts, 1e-9)).otherwise(0.5 / max(1 - counts, 1e-9)))
    assembler = VectorAssembler(inputCols=columns, outputCol="raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    model = LogisticRegression(labelCol="label", weightCol="weight", regParam=0.01, maxIter=50) if kind == "logistic" else GBTClassifier(labelCol="label", weightCol="weight", maxDepth=3, maxIter=20, minInstancesPerNode=20, seed=seed)
    return Pipeline(stages=[assembler, scaler, model]).fit(weighted)


#: Nodes of an isolation tree: node 0 is the root, 2i+1 and 2i+2 the children of i; feature -1 is a leaf that held n rows.
FOREST = "tree long, node long, feature long, cut double, n long"


def fit_forest(train: DataFrame, columns: list[str], trees: int = 50, size: int = 256, seed: int = 1729) -> DataFrame:
    """The nodes (FOREST) of isolation trees, each grown in a task of its own from a hashed sample of `size` rows."""
    import numpy as np
    import pandas as pd

    n = max(1, train.count())
    share = min(1.0, 3.0 * size / n)
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    place = F.pmod(F.xxhash64(F.lit(seed), "event_id", "tree"), F.lit(1 << 30))
    drawn = train.select("event_id", *columns, tree.alias("tree")).withColumn("place", place).filter(F.col("place") < int(share * (1 << 30)))

    def grow(frame):
        frame = frame.nsmallest(size, ["place", "event_id"])
        x = frame[columns].to_numpy(float)
        rng = np.random.default_rng([seed, int(frame["tree"].iloc[0])])
        out = []

        def split(rows, depth, node):
            part = x[rows]
            spread = np.flatnonzero(part.max(0) > part.min(0)) if len(rows) else []
            if depth >= 8 or len(rows) <= 1 or not len(spread):
                out.append((node, -1, 0.0, len(rows)))
                return
            f = int(rng.choice(spread))
            at = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            out.append((node, f, at, len(rows)))
            split(rows[part[:, f] < at], depth + 1, 2 * node + 1)
            split(rows[part[:, f] >= at], depth + 1, 2 * node + 2)

        split(np.arange(len(x)), 0, 0)
        return pd.DataFrame({"tree": int(frame["tree"].iloc[0]), "node": [o[0] for o in out], "feature": [o[1] for o in out], "cut": [o[2] for o in out], "n": [o[3] for o in out]})

    return drawn.groupBy("tree").applyInPandas(grow, FOREST)


def score_forest(rows: DataFrame, forest: DataFrame, columns: list[str], size: int = 256) -> DataFrame:
    """rows with `anomaly` by a forest, whose nodes (trees * 2 * size at most) go to all tasks."""
    import numpy as np

    nodes: dict[int, dict] = {}
    for r in forest.collect():
        nodes.setdefault(r.tree, {})[r.node] = (r.feature, r.cut, r.n)

    def path(k):
        return 0.0 if k <= 1 else 2 * (np.log(k - 1) + 0.5772156649) - 2 * (k - 1) / k

    def score(batches):
        for frame in batches:
            x = frame[columns].to_numpy(float)
            total = np.zeros(len(x))
            for tree in nodes.values():
                todo = [(0, np.arange(len(x)), 0)]
                while todo:
                    node, at, depth = todo.pop()
                    f, cut, k = tree[node]
                    if f < 0:
                        total[at] += depth + path(k)
                        continue
                    left = x[at, f] < cut
                    todo += [(2 * node + 1, at[left], depth + 1), (2 * node + 2, at[~left], depth + 1)]
            yield frame.assign(anomaly=2.0 ** (-total / max(1, len(nodes)) / path(size)))

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(score, f"{schema}, anomaly double")


def isolation_forest(train: DataFrame, rows: DataFrame, columns: list[str], trees: int = 50, size: int = 256, seed: int = 1729) -> DataFrame:
    """rows with `anomaly` by trees grown from train, and `percentile`: the share of training rows with no higher anomaly."""
    from .evaluation import percentile_of

    forest = fit_forest(train, columns, trees, size, seed)
    scored = score_forest(rows, forest, columns, size)
    reference = score_forest(train.select("event_id", *columns), forest, columns, size).select(F.round("anomaly", 9).alias("score"))
    found = percentile_of(scored.select("event_id", F.round("anomaly", 9).alias("score")), reference)
    return scored.join(found.select("event_id", "percentile"), "event_id")


def baseline_experiment(rows: DataFrame, columns: list[str], per_10k: float = 25.0, seed: int = 1729, min_gain: float = 0.0) -> DataFrame:
    """detector, threshold, validation_ap, test_ap, test_recall, test_precision, test_fp_per_10k, best: four baselines on one split.

    rows: event_id, partition, label and columns. Rule and rarity are fixed scores; the logistic model and the isolation forest see
    training rows only. Thresholds keep the budget of false alarms on validation; test is scored once. best: the detector that beats every
    other's validation_ap by more than min_gain.
    """
    from pyspark.ml.functions import vector_to_array

    from . import evaluation
    from .graph import cut_lineage

    rows = cut_lineage(rows.select("event_id", "partition", "label", *columns), "baselines")
    train, judged = rows.filter("partition = 'train'"), rows.filter("partition <> 'train'")
    kept = ("event_id", "partition", "label")
    model = fit_classifier(train, columns, "logistic", seed)
    forest = fit_forest(train, columns, seed=seed)
    scored = {
        "rule": score_rule(judged),
        "rarity": score_rarity(judged),
        "logistic": model.transform(judged).withColumn("score", vector_to_array("probability")[1]),
        "isolation_forest": score_forest(judged, forest, columns).withColumnRenamed("anomaly", "score"),
    }
    out = []
    for name, x in scored.items():
        x = cut_lineage(x.select(*kept, "score"), name)
        part = {p: x.filter(F.col("partition") == p) for p in ("validation", "test")}
        ap = {p: evaluation.average_precision(evaluation.block_table(d)).first()[0] for p, d in part.items()}
        threshold = evaluation.threshold_at_budget(part["validation"], per_10k).first()[0]
        at = evaluation.operating_point(part["test"], threshold).first() if threshold is not None else None
        out.append([name, threshold, ap["validation"], ap["test"], *((at.recall, at.precision, at.fp_per_10k) if at else (None, None, None))])
    for r in out:
        others = [o[2] or 0.0 for o in out if o is not r]
        r.append(int((r[2] or 0.0) > max(others) + min_gain))
    return rows.sparkSession.createDataFrame([tuple(r) for r in out], "detector string, threshold double, validation_ap double, test_ap double, test_recall double, test_precision double, test_fp_per_10k double, best int")


# ---- response -------------------------------------------------------------------------------------------------------

# The actions of each technique, in order; '' is an alert without technique.
PLAYBOOKS = {
    "T1021": ("increase_monitoring", "notify_soc", "force_reauth", "block_network_path", "isolate_host"),
    "T1110": ("increase_monitoring", "notify_soc", "lock_account"),
    "T1087": ("increase_monitoring", "notify_soc"),
    "T1078": ("increase_monitoring", "notify_soc", "force_reauth", "reset_credentials"),
    "T1550.003": ("increase_monitoring", "notify_soc", "force_reauth", "reset_credentials"),
    "T1078.002": ("increase_monitoring", "notify_soc", "disable_service_account", "isolate_host"),
    "T1550.002": ("increase_monitoring", "notify_soc", "block_network_path", "reset_credentials"),
    "": ("increase_monitoring", "notify_soc"),
}
# Whether an action needs approval, can be undone, and how much it disrupts.
ACTIONS = {
    "increase_monitoring": (False, True, 0),
    "notify_soc": (False, True, 0),
    "force_reauth": (False, True, 1),
    "lock_account": (True, True, 3),
    "block_network_path": (True, True, 3),
    "reset_credentials": (True, False, 4),
    "isolate_host": (True, True, 5),
    "disable_service_account": (True, True, 4),
}
# How many actions of a playbook a confidence reaches.
DEPTH = {"high": 5, "medium": 3, "low": 2, "none": 2}


def playbook(spark) -> DataFrame:
    """book, step, action, held, disruption: the playbooks as a dimension table; held: never without approval."""
    rows = [(k, i, a, ACTIONS[a][0] or not ACTIONS[a][1], ACTIONS[a][2]) for k, actions in PLAYBOOKS.items() for i, a in enumerate(actions, 1)]
    return spark.createDataFrame(rows, "book string, step int, action string, held boolean, disruption int")


def response_plan(alerts: DataFrame, auto: float = 0.846394) -> DataFrame:
    """event_id, technique, step, action, mode of every alert (event_id, technique, confidence, risk).

    A technique outside the playbooks, or none, is watched. Actions that disrupt run on their own only at high confidence and
    a risk from `auto`; those that need approval or can't be undone never do.
    """
    known = F.col("technique").isin(*[k for k in PLAYBOOKS if k])
    reach = F.coalesce(*[F.when(F.col("confidence") == k, F.lit(v)) for k, v in DEPTH.items()], F.lit(2))
    rows = alerts.withColumn("book", F.when(known, F.col("technique")).otherwise("")).join(F.broadcast(playbook(alerts.sparkSession)), "book").filter(F.col("step") <= reach)
    alone = ~F.col("held") & ((F.col("disruption") == 0) | ((F.col("confidence") == "high") & (F.col("risk") >= auto)))
    return rows.select("event_id", "technique", "step", "action", F.when(alone, "auto").otherwise("approval").alias("mode"))


def corroborated(alerts: DataFrame, need: int = 2, window: int = HOUR) -> DataFrame:
    """alerts with earlier ones of the account or of the source in (t-w, t], in stream order, and whether they suffice."""
    by_user, by_host = earlier_in_window(window, "usr"), earlier_in_window(window, "src")
    return alerts.select("event_id", by_user.alias("user_before"), by_host.alias("host_before")).withColumn("corroborated", (F.greatest("user_before", "host_before") >= need).cast("int"))


def lock_intervals(alerts: DataFrame, hold: int = 7_200) -> DataFrame:
    """usr, start_t, end_t, n_alerts: locks that later alerts within the hold restart."""
    w = Window.partitionBy("usr").orderBy("t", "event_id")
    opens = F.coalesce((F.col("t") > F.lag("t").over(w) + hold).cast("int"), F.lit(1))
    rows = alerts.withColumn("_opens", opens).withColumn("_lock", F.sum("_opens").over(w))
    return rows.groupBy("usr", "_lock").agg(F.min("t").alias("start_t"), (F.max("t") + hold).alias("end_t"), F.count("*").alias("n_alerts")).drop("_lock")


def failed_containment(alerts: DataFrame, actions: DataFrame, window: int = 1_800) -> DataFrame:
    """event_id, contained_t of alerts at most `window` after the account's latest containment."""
    both = alerts.select("usr", "t", "event_id", F.lit(None).cast("long").alias("c")).union(actions.select("usr", "t", F.lit(None).cast("long"), F.col("t").cast("long")))
    last = F.max("c").over(Window.partitionBy("usr").orderBy("t").rangeBetween(Window.unboundedPreceding, -1))
    return both.withColumn("contained_t", last).filter((F.col("event_id").isNotNull()) & (F.col("t") - F.col("contained_t") <= window)).select("event_id", "contained_t")


def approval_status(records: DataFrame) -> DataFrame:
    """alert_id, action, outcome of the latest record; pending ones past their deadline time out."""
    latest = records.groupBy("alert_id", "action").agg(F.max_by(F.struct("outcome", "t"), F.struct("t", "seq")).alias("r"))
    now = records.agg(F.max("t").alias("now"))
    rows = latest.join(F.broadcast(now))
    return rows.select("alert_id", "action", F.when((F.col("r.outcome") == "pending") & (F.col("now") - F.col("r.t") > 3_600), "timeout").otherwise(F.col("r.outcome")).alias("outcome"))


def overview(scored: DataFrame, threshold: float, top: int = 8) -> DataFrame:
    """kind, key, value: totals; severities, a histogram of risk and the top entities of the alerts."""
    fired = scored.filter(F.col("risk") >= threshold)
    level = severity(F.col("risk"), "console")
    value = lambda kind, key, v: [F.lit(kind).alias("kind"), key.cast("string").alias("key"), v.cast("double").alias("value")]
    out = scored.agg(F.count("*").alias("n")).select(*value("total", F.lit("scored"), F.col("n")))
    out = out.union(fired.agg(F.count("*").alias("n")).select(*value("total", F.lit("alerts"), F.col("n"))))
    out = out.union(fired.groupBy(level.alias("key")).count().select(*value("severity", F.col("key"), F.col("count"))))
    out = out.union(fired.groupBy(F.least(F.floor(F.col("risk") * 5), F.lit(4)).alias("key")).count().select(*value("bin", F.col("key"), F.col("count"))))
    sides = F.explode(F.array(*[F.concat(F.lit(k), F.col(c).cast("string")) for k, c in (("user:", "usr"), ("host:", "src"), ("host:", "dst"))])).alias("entity")
    best = fired.select("risk", sides).groupBy("entity").agg(F.max("risk").alias("most"), F.count("*").alias("n")).orderBy(F.desc("most"), F.desc("n"), "entity").limit(top)
    return out.union(best.select(*value("entity_alerts", F.col("entity"), F.col("n")))).union(best.select(*value("entity_risk", F.col("entity"), F.col("most"))))
