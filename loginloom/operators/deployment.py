"""Label-free models of an estate: plausibility against counterfactuals, a stored profile, combinations of detectors, and the test
that leaves an attacker out."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import fresh_path
from . import features, studies
from .evaluation import percentile_of
from .graph import cut_lineage
from .windows import global_position, running_totals

DAY = 86_400


# ---- plausibility ----------------------------------------------------------------------------------------------------


def plausibility_rows(events: DataFrame, columns: list[str], share: float = 0.02, seed: int = 1729) -> tuple[DataFrame, DataFrame]:
    """Events (event_id, t and columns), and the examples of them that plausibility_examples gives. Both lie in the shared folder.

    Events and counterfactuals get their features in one pass, which is written and read again: a fit reads its examples several times,
    and the real ones are events of that pass. Examples are dealt and sorted by event_id, so that what a fit draws from them and the order of
    its sums don't hang on the order in which shuffles arrive.
    """
    n_parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = _written(events.select("event_id", "t", "usr", "src", "dst", "logon_id", "success"), "events")
    probes = features.counterfactuals(events, share, seed).drop("kind")
    rows = _written(features.with_probes(events, probes, columns).select("event_id", "t", "real_id", "_real", *columns), "plausibility")
    real, probes = rows.filter("_real").select("event_id", "t", *columns), rows.filter("NOT _real")
    own = real.filter(features.picked(share, seed)).join(probes.select(F.col("real_id").alias("event_id")), "event_id", "left_semi")
    label = lambda x, n: x.select("event_id", "t", F.lit(n).alias("label"), *columns)
    examples = label(own, 1).unionByName(label(probes, 0)).repartition(n_parts, "event_id").sortWithinPartitions("event_id")
    return real, cut_lineage(examples, "examples")


def _written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, made once; its reads skip the columns that they don't need."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plausibility_examples(events: DataFrame, columns: list[str], share: float = 0.02, seed: int = 1729) -> DataFrame:
    """event_id, t, label and columns: a hashed share of events (label 1) and their counterfactuals (label 0), five for each.

    Both have the features that they would have had at their time; the counterfactuals leave no trace in any history.
    """
    return plausibility_rows(events, columns, share, seed)[1]


def fit_plausibility(examples: DataFrame, columns: list[str], seed: int = 1729):
    """A model that tells real events from counterfactuals; no label of any attack is read."""
    return studies.fit_classifier(examples, columns, "gbt", seed)


def anomaly(model, rows: DataFrame) -> DataFrame:
    """rows with anomaly: 1 - the probability of being real."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows).withColumn("anomaly", 1 - vector_to_array("probability")[1])
    return scored.select(*rows.columns, "anomaly")


# ---- a deployment's profile ------------------------------------------------------------------------------------------


def _members(rows: DataFrame, forest: DataFrame, columns: list[str]) -> DataFrame:
    """event_id, rarity, iforest of scaled rows."""
    narrow = rows.select("event_id", "rarity", *columns)
    return studies.score_forest(narrow, forest, columns).select("event_id", F.col("rarity"), F.col("anomaly").alias("iforest"))


MEMBERS = ("rarity", "iforest")


def _scaled(rows: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Scaled columns, and the rarity score of the unscaled ones."""
    return features.apply_scaler(studies.score_rarity(rows).withColumnRenamed("score", "rarity"), scaler, 10.0, logs=True)


def onboard(rows: DataFrame, columns: list[str], path: str, alert_budget: float = 1e-3, action_budget: float = 1e-4, seed: int = 1729) -> None:
    """Learns an estate's profile from its unlabelled features and writes it as tables below path.

    rows: event_id, t, the columns and those of the rarity score. Tables: `scaler`; `forest`, the nodes of the isolation trees; `reference`,
    each member's scores and their mean percentile with how often each occurs; `manifest`, budgets and alerts expected a day. All
    rows are scored; only the trees are grown from samples, of 256 rows each.
    """
    spark = rows.sparkSession
    rows = cut_lineage(rows, "onboard")
    features.fit_scaler(rows, columns, "standard").write.mode("errorifexists").parquet(f"{path}/scaler")
    scaler = spark.read.parquet(f"{path}/scaler")
    scaled = cut_lineage(_scaled(rows, scaler, columns), "scaled")
    studies.fit_forest(scaled, columns, seed=seed).write.mode("errorifexists").parquet(f"{path}/forest")
    members = cut_lineage(_members(scaled, spark.read.parquet(f"{path}/forest"), columns), "members")
    blocks = [members.groupBy(F.col(m).alias("score")).agg(F.count("*").alias("n")).select(F.lit(m).alias("member"), "score", "n") for m in MEMBERS]
    reduce(DataFrame.union, blocks).write.mode("errorifexists").partitionBy("member").parquet(f"{path}/reference")
    means = combined(members, spark.read.parquet(f"{path}/reference"))
    means.groupBy(F.col("mean").alias("score")).agg(F.count("*").alias("n")).write.mode("errorifexists").parquet(f"{path}/combined")
    span = F.greatest(F.lit(1.0), (F.max("t") - F.min("t")) / DAY)
    daily = lambda b: F.round(F.lit(b) * F.count("*") / span, 2)
    rows.agg(F.count("*").alias("events"), F.lit(alert_budget).alias("alert_budget"), F.lit(action_budget).alias("action_budget"), daily(alert_budget).alias("alerts_per_day"), daily(action_budget).alias("actions_per_day")).write.mode("errorifexists").parquet(f"{path}/manifest")


def percentiles_in(rows: DataFrame, blocks: DataFrame, value: str, name: str) -> DataFrame:
    """rows with `name`: the share of the blocks' (score, n) occurrences at or below `value`."""
    held = blocks.select("score", F.col("n").alias("r")).unionByName(rows.select(F.col(value).alias("score")).distinct().withColumn("r", F.lit(0).cast("long")))
    steps = running_totals(held.groupBy("score").agg(F.sum("r").alias("r")), "score", ["r"])
    total = blocks.agg(F.sum("n")).first()[0] or 1
    return rows.join(steps.select(F.col("score").alias(value), (F.col("cum_r") / F.lit(float(total))).alias(name)), value)


def combined(members: DataFrame, reference: DataFrame) -> DataFrame:
    """event_id, a percentile for each member and their mean, rounded so that equal rows are equal on every machine."""
    rows = members
    for m in MEMBERS:
        rows = percentiles_in(rows, reference.filter(F.col("member") == m), m, f"p_{m}")
    mean = sum((F.col(f"p_{m}") for m in MEMBERS[1:]), F.col(f"p_{MEMBERS[0]}")) / len(MEMBERS)
    return rows.select("event_id", *[f"p_{m}" for m in MEMBERS], F.round(mean, 9).alias("mean"))


def score_with_profile(rows: DataFrame, columns: list[str], path: str) -> DataFrame:
    """event_id, member percentiles, percentile, alert, action of rows, by the profile below path and nothing else."""
    spark = rows.sparkSession
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    # percentiles read their rows twice each, so the forest's answers are kept
    members = cut_lineage(_members(_scaled(rows, read("scaler"), columns), read("forest"), columns), "members")
    found = percentiles_in(combined(members, read("reference")), read("combined"), "mean", "percentile")
    limits = read("manifest").select("alert_budget", "action_budget")
    over = lambda c: (F.col("percentile") > 1 - F.col(c)).cast("int")
    return found.join(F.broadcast(limits)).select("event_id", *[f"p_{m}" for m in MEMBERS], "percentile", over("alert_budget").alias("alert"), over("action_budget").alias("action"))


# ---- combinations of detectors ---------------------------------------------------------------------------------------


def combination_names(members: list[str]) -> list[tuple[str, str, int]]:
    """(name, operator, bit mask): every set of members by its mean, sets of two and more also by their greatest."""
    out = []
    for size in range(1, len(members) + 1):
        for held in combinations(range(len(members)), size):
            mask, names = sum(1 << i for i in held), "+".join(members[i] for i in held)
            out.append((f"mean({names})", "mean", mask))
            if size > 1:
                out.append((f"max({names})", "max", mask))
    return out


def _combined_scores(members: list[str]) -> Column:
    """An array with the score of each combination, in their order, from one array of percentiles."""
    out = []
    for _, op, mask in combination_names(members):
        own = [F.col(m) for i, m in enumerate(members) if mask >> i & 1]
        value = sum(own[1:], own[0]) / len(own) if op == "mean" else (F.greatest(*own) if len(own) > 1 else own[0])
        out.append(F.round(value, 9))
    return F.array(*out)


def combination_search(rows: DataFrame, members: list[str], calibration: Column, budgets: tuple[float, ...] = (0.01, 0.001)) -> DataFrame:
    """name, mask, budget, threshold, alerts, hits, campaigns, all_campaigns for each combination of members and each budget.

    rows: day, src, label and a percentile for each member. A combination's threshold lets the budget's share of calibration rows through (the
    score at the upper rank of 1 - budget); it is then judged on all other rows at once: alerts, attacks among them, and campaigns (day
    and attacking source) with an attack above it. Ranks come from one global order over (combination, score).
    """
    spark = rows.sparkSession
    names = combination_names(members)
    scored = cut_lineage(rows.select("day", "src", "label", calibration.alias("calibrates"), _combined_scores(members).alias("scores")), "scores")
    own = scored.filter("calibrates").select(F.posexplode("scores").alias("k", "score")).groupBy("k", "score").agg(F.count("*").alias("n"))
    steps = running_totals(global_position(own, ["k", "score"], "at"), "at", ["n"])
    n = scored.filter("calibrates").count()
    asked = [(k, b, k * n + -int(-((n - 1) * (1 - b)) // 1)) for k in range(len(names)) for b in budgets]  # each combination has n rows
    wanted = F.broadcast(spark.createDataFrame(asked, "k int, budget double, place long"))
    held = steps.join(wanted, "k").filter((F.col("place") >= F.col("cum_n") - F.col("n")) & (F.col("place") < F.col("cum_n")))
    limits = cut_lineage(held.select("k", "budget", F.col("score").alias("threshold")), "limits")  # combinations times budgets
    fired = scored.filter("NOT calibrates").select("day", "src", "label", F.posexplode("scores").alias("k", "score")).join(F.broadcast(limits), "k").filter(F.col("score") > F.col("threshold"))
    counts = fired.groupBy("k", "budget").agg(F.count("*").alias("alerts"), F.sum("label").cast("long").alias("hits"), F.count_distinct(F.when(F.col("label") == 1, F.struct("day", "src"))).alias("campaigns"))
    total = scored.filter("NOT calibrates AND label = 1").agg(F.count_distinct("day", "src").alias("all_campaigns"))
    labels = F.broadcast(spark.createDataFrame([(k, name, mask) for k, (name, _, mask) in enumerate(names)], "k int, name string, mask int"))
    every = limits.join(labels, "k").join(counts, ["k", "budget"], "left").fillna(0, ["alerts", "hits", "campaigns"]).join(F.broadcast(total))
    return every.select("name", "mask", "budget", "threshold", "alerts", "hits", "campaigns", "all_campaigns")


# ---- one attacker left out -------------------------------------------------------------------------------------------


def leave_one_attacker_out(rows: DataFrame, columns: list[str], kind: str = "logistic", least_attacks: int = 5, seed: int = 1729, fitted=None) -> DataFrame:
    """src, day, best_rank, attacks, average_precision: how an attacker that the model never saw ranks among its day.

    rows: event_id, day, src, label, columns. For each attacking source a model is fitted on the rows of all others (if they
    hold least_attacks), then scores the days on which it attacked. A rank is one more than the rows with a higher score.
    fitted: a function (training rows, columns) -> a function of rows that adds `score`, instead of Spark ML's classifiers.
    """
    from pyspark.ml.functions import vector_to_array

    def default(train: DataFrame, names: list[str]):
        model = studies.fit_classifier(train, names, kind, seed)
        return lambda x: model.transform(x).withColumn("score", vector_to_array("probability")[1])

    rows = cut_lineage(rows.select("event_id", "day", "src", "label", *columns), "loo")
    attackers = rows.filter("label = 1").groupBy("src").agg(F.count("*").alias("n"), F.collect_set("day").alias("days")).collect()  # labelled sources
    total, folds = sum(a.n for a in attackers), []
    for a in sorted(attackers):
        if total - a.n < least_attacks:
            continue
        score = (fitted or default)(rows.filter(~F.col("src").eqNullSafe(F.lit(a.src))), columns)
        folds.append(score(rows.filter(F.col("day").isin(a.days))).select(F.lit(a.src).alias("out"), "day", "src", "label", "score"))
    if not folds:
        return rows.limit(0).select("src", "day", F.lit(0).cast("long").alias("best_rank"), F.lit(0).cast("long").alias("attacks"), F.lit(0.0).alias("average_precision"))
    scored = cut_lineage(reduce(DataFrame.union, folds), "folds")
    mine = ((F.col("src") == F.col("out")) & (F.col("label") == 1)).cast("long")
    blocks = scored.groupBy("out", "day", (-F.col("score")).alias("down")).agg(F.count("*").alias("n"), F.sum(mine).alias("m"))
    steps = running_totals(global_position(blocks, ["out", "day", "down"], "at"), "at", ["n", "m"])
    first = steps.groupBy("out", "day").agg(F.min(F.col("cum_n") - F.col("n")).alias("n0"), F.min(F.col("cum_m") - F.col("m")).alias("m0"))
    held = steps.filter("m > 0").join(first, ["out", "day"]).withColumn("above", F.col("cum_n") - F.col("n") - F.col("n0")).withColumn("hits", F.col("cum_m") - F.col("m") - F.col("m0"))
    # tied attacks take the places hits + 1 .. hits + m, all with the rank of the block
    part = F.col("m") * (2 * F.col("hits") + F.col("m") + 1) / 2 / (F.col("above") + 1)
    return held.groupBy(F.col("out").alias("src"), "day").agg((F.min("above") + 1).alias("best_rank"), F.sum("m").alias("attacks"), (F.sum(part) / F.sum("m")).alias("average_precision"))


def summarize_folds(folds: DataFrame, ranks: tuple[int, ...] = (300, 1_000)) -> DataFrame:
    """host_days, how many have a best rank within each of `ranks`, the median best rank, the mean average precision."""
    return folds.agg(F.count("*").alias("host_days"), *[F.count_if(F.col("best_rank") <= r).alias(f"within_{r}") for r in ranks], F.percentile("best_rank", 0.5).alias("median_best_rank"), F.avg("average_precision").alias("mean_average_precision"))
