"""Rare-event evaluation. Scores are reduced once to a block table (score, n_pos, n_neg); metrics are queries on it, so that
ties are handled alike everywhere and the corpus is read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import global_position, running_totals


def block_table(scores: DataFrame) -> DataFrame:
    """score, n_pos, n_neg of rows (score, label)."""
    return scores.groupBy("score").agg(F.sum("label").cast("long").alias("n_pos"), F.sum(1 - F.col("label")).cast("long").alias("n_neg"))


def chronological_split(events: DataFrame, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """events with `partition`, cut by position and moved past ties in time. A part that would hold no event stays empty."""
    n = events.count()
    cuts = [int(n * train), int(n * (train + validation))]
    placed = global_position(events.select("t", "event_id"), ["t", "event_id"]).filter(F.col("position").isin([c - 1 for c in cuts]))
    at = {r.position: r.t for r in placed.collect()}
    first, second = (F.lit(at.get(c - 1)).cast("long") for c in cuts)
    return events.withColumn("partition", F.when(F.col("t") <= first, "train").when(F.col("t") <= second, "validation").otherwise("test"))


def _ranked(blocks: DataFrame) -> DataFrame:
    """blocks with cum_n_pos and cum_n_neg from the highest score down."""
    return running_totals(blocks, "score", ["n_pos", "n_neg"], descending=True)


def average_precision(blocks: DataFrame) -> DataFrame:
    """Each block's positives are credited with the precision at the block's end; null without positives, as are the other metrics."""
    rows = _ranked(blocks)
    part = F.col("n_pos") * F.col("cum_n_pos") / (F.col("cum_n_pos") + F.col("cum_n_neg"))
    return rows.agg(F.try_divide(F.sum(part), F.sum("n_pos")).alias("average_precision"))


def roc_auc(blocks: DataFrame) -> DataFrame:
    """A tied pair counts half."""
    rows = _ranked(blocks)
    below = F.sum(F.col("n_pos") * (F.lit(0.5) * F.col("n_neg") + F.col("cum_n_neg") - F.col("n_neg")))
    return rows.agg((1 - F.try_divide(below, F.sum("n_pos") * F.sum("n_neg"))).alias("roc_auc"))


def at_k(scores: DataFrame, k: int) -> DataFrame:
    """recall and precision of the k highest scores; ties go against the detector."""
    top = scores.orderBy(F.desc("score"), "label").limit(k)
    total = scores.agg(F.sum("label").alias("positives"))
    return top.agg(F.sum("label").alias("hits"), F.count("*").alias("taken")).join(F.broadcast(total)).select(F.try_divide("hits", "positives").alias("recall"), F.try_divide("hits", "taken").alias("precision"))


def threshold_at_budget(scores: DataFrame, per_10k: float) -> DataFrame:
    """The int(n * budget / 10,000)-th highest benign score."""
    n = scores.filter("label = 0").count()
    k = max(1, int(n * per_10k / 10_000))
    return scores.filter("label = 0").orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("threshold"))


def select_threshold(blocks: DataFrame, per_10k: float) -> DataFrame:
    """The lowest score whose false positives, ties included, stay within the budget."""
    n = blocks.agg(F.sum("n_neg")).first()[0]
    allowed = int(n * per_10k / 10_000)
    return _ranked(blocks).filter(F.col("cum_n_neg") <= allowed).agg(F.min("score").alias("threshold"))


def operating_point(scores: DataFrame, threshold: float) -> DataFrame:
    fired = (F.col("score") >= threshold).cast("int")
    row = scores.agg(F.sum(fired).alias("alerts"), F.sum(fired * F.col("label")).alias("tp"), F.sum(fired * (1 - F.col("label"))).alias("fp"), F.sum("label").alias("p"), F.count("*").alias("n"))
    return row.select("alerts", "tp", "fp", F.try_divide("tp", "p").alias("recall"), F.when(F.col("alerts") > 0, F.col("tp") / F.col("alerts")).otherwise(0.0).alias("precision"), F.try_divide(F.col("fp") * 10_000, F.col("n")).alias("fp_per_10k"))


def brier(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("brier"))


def lift(fired: DataFrame) -> DataFrame:
    """Recall over the benign firing rate, of rows (label, fired)."""
    rate = lambda on: F.avg(F.when(F.col("label") == on, F.col("fired").cast("double")))
    return fired.agg(rate(1).alias("recall"), rate(0).alias("benign_rate")).withColumn("lift", F.when(F.col("benign_rate") > 0, F.col("recall") / F.col("benign_rate")))


def wilson(positive: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a binomial share."""
    share = positive / n
    spread = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    middle, scale = share + z * z / (2 * n), 1 + z * z / n
    return (middle - spread) / scale, (middle + spread) / scale


def precision_gate(blocks: DataFrame, target: float, least: int = 20) -> DataFrame:
    """From the highest score down to the first block, past `least` alerts, whose Wilson lower bound misses the target."""
    rows = _ranked(blocks).withColumn("n", F.col("cum_n_pos") + F.col("cum_n_neg"))
    low, _ = wilson(F.col("cum_n_pos"), F.col("n"))
    rows = rows.withColumn("fails", (F.col("n") >= least) & (low < target))
    stop = rows.filter("fails").agg(F.max("score").alias("stop"))
    kept = rows.join(F.broadcast(stop)).filter((F.col("n") >= least) & (F.col("stop").isNull() | (F.col("score") > F.col("stop"))))
    return kept.agg(F.min("score").alias("gate"), F.max("n").alias("alerts"), F.max("cum_n_pos").alias("hits"))


def calibration(scores: DataFrame, edges: list[float]) -> DataFrame:
    """bin, n, mean_score, rate, gap over bins [edge, next edge)."""
    at = F.lit(0)
    for i, e in enumerate(edges):
        at = F.when(F.col("score") >= e, i + 1).otherwise(at)
    return scores.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("rate")).withColumn("gap", F.abs(F.col("rate") - F.col("mean_score")))


def attack_only(events: DataFrame, entity: str) -> DataFrame:
    """Entities with attacks and never a benign event."""
    rows = events.groupBy(F.col(entity).alias("entity")).agg(F.min("label").alias("least"), F.count("*").alias("n"))
    return rows.filter("least = 1").select("entity", "n")


def drift(baseline: DataFrame, current: DataFrame, bins: int = 10) -> DataFrame:
    """psi over equal bins of [0, 1] with a floor of 1e-4, and the two-sample ks distance, of scores."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    both = baseline.select("score", F.lit(1).alias("old"), F.lit(0).alias("new")).union(current.select("score", F.lit(0), F.lit(1)))
    n = both.agg(F.sum("old").alias("n_old"), F.sum("new").alias("n_new"))
    share = both.groupBy(at.alias("bin")).agg(F.sum("old").alias("old"), F.sum("new").alias("new")).join(F.broadcast(n))
    p, q = F.greatest(F.lit(1e-4), F.col("old") / F.col("n_old")), F.greatest(F.lit(1e-4), F.col("new") / F.col("n_new"))
    every = both.sparkSession.range(bins).select(F.col("id").alias("bin"))
    psi = every.join(F.broadcast(n)).join(share.select("bin", "old", "new"), "bin", "left").fillna(0, ["old", "new"]).agg(F.sum((q - p) * F.log(q / p)).alias("psi"))
    steps = running_totals(both.groupBy("score").agg(F.sum("old").alias("old"), F.sum("new").alias("new")), "score", ["old", "new"])
    ks = steps.join(F.broadcast(n)).agg(F.max(F.abs(F.col("cum_old") / F.col("n_old") - F.col("cum_new") / F.col("n_new"))).alias("ks"))
    return psi.join(ks)


def hist_auc(scores: DataFrame, bins: int = 1_000) -> DataFrame:
    """roc_auc of scores floored to bins."""
    return roc_auc(block_table(scores.withColumn("score", F.floor(F.col("score") * bins).cast("double"))))


def grouped_auc(scores: DataFrame, group: str) -> DataFrame:
    """group, auc of the groups that hold both labels."""
    rows = scores.groupBy(group, "score").agg(F.sum("label").alias("n_pos"), F.sum(1 - F.col("label")).alias("n_neg"))
    w = Window.partitionBy(group).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("below", F.sum("n_neg").over(w) - F.col("n_neg"))
    found = rows.groupBy(group).agg(F.sum("n_pos").alias("p"), F.sum("n_neg").alias("q"), F.sum(F.col("n_pos") * (F.col("below") + 0.5 * F.col("n_neg"))).alias("u"))
    return found.filter("p > 0 AND q > 0").select(group, (F.col("u") / (F.col("p") * F.col("q"))).alias("auc"))


def group_summary(scores: DataFrame, group: str, threshold: float) -> DataFrame:
    """One row over the groups (recordings, say) with an attack: groups, attacks, benign, detected (an attack at or above the threshold),
    benign_alerts, with_benign, attack_first and attack_first_by_chance among those, pooled_auc of all their rows, mean_auc within groups.

    scores: event_id, score, label and the group. A group's first is its highest score, ties to the smaller event_id; by chance it is an
    attack with the share of attacks in the group.
    """
    attack, benign = F.col("label") == 1, F.col("label") == 0
    by = scores.groupBy(group).agg(
        F.count_if(attack).alias("attacks"),
        F.count_if(benign).alias("benign"),
        F.max((attack & (F.col("score") >= threshold)).cast("int")).alias("detected"),
        F.count_if(benign & (F.col("score") >= threshold)).alias("benign_alerts"),
        F.max_by("label", F.struct("score", -F.col("event_id"))).alias("first"),
    ).filter("attacks > 0")
    mixed = F.col("benign") > 0
    total = by.agg(
        F.count("*").alias("groups"),
        F.sum("attacks").alias("attacks"),
        F.sum("benign").alias("benign"),
        F.sum("detected").cast("long").alias("detected"),
        F.sum("benign_alerts").alias("benign_alerts"),
        F.count_if(mixed).alias("with_benign"),
        F.count_if(mixed & (F.col("first") == 1)).alias("attack_first"),
        F.sum(F.when(mixed, F.col("attacks") / (F.col("attacks") + F.col("benign")))).alias("attack_first_by_chance"),
    )
    held = scores.join(by.select(group), group, "left_semi")
    pooled = roc_auc(block_table(held)).withColumnRenamed("roc_auc", "pooled_auc")
    within = grouped_auc(scores, group).agg(F.avg("auc").alias("mean_auc"))
    return total.join(F.broadcast(pooled)).join(F.broadcast(within))


def budget_curve(scores: DataFrame, budgets: list[float]) -> DataFrame:
    """budget, threshold, benign_rate, recall: thresholds at shares of benign rows, the k-th greatest."""
    out = None
    for b in budgets:
        point = threshold_at_budget(scores, b * 10_000)
        rows = scores.join(F.broadcast(point)).agg(F.first("threshold").alias("threshold"), F.avg(F.when(F.col("label") == 0, (F.col("score") >= F.col("threshold")).cast("double"))).alias("benign_rate"), F.avg(F.when(F.col("label") == 1, (F.col("score") >= F.col("threshold")).cast("double"))).alias("recall"))
        rows = rows.select(F.lit(b).alias("budget"), "threshold", "benign_rate", "recall")
        out = rows if out is None else out.union(rows)
    return out


def percentile_of(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """scores (event_id, score) with `percentile`, the share of reference scores at or below: prefix sums over distinct scores."""
    both = reference.groupBy("score").count().select("score", F.col("count").alias("r")).unionByName(scores.select("score").distinct().withColumn("r", F.lit(0).cast("long")))
    steps = running_totals(both.groupBy("score").agg(F.sum("r").alias("r")), "score", ["r"])
    n = reference.count()
    return scores.join(steps.select("score", (F.col("cum_r") / F.lit(float(n))).alias("percentile")), "score").select(*scores.columns, "percentile")


def rank_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """spearman and max_delta of two scorings (event_id, score), by average ranks."""

    def ranked(x, name):
        steps = running_totals(x.groupBy("score").count().withColumnRenamed("count", "m"), "score", ["m"])
        return x.join(steps.select("score", (F.col("cum_m") - (F.col("m") - 1) / 2).alias(f"rank_{name}")), "score").select("event_id", F.col("score").alias(f"score_{name}"), f"rank_{name}")

    both = ranked(a, "a").join(ranked(b, "b"), "event_id")
    return both.agg(F.corr("rank_a", "rank_b").alias("spearman"), F.max(F.abs(F.col("score_a") - F.col("score_b"))).alias("max_delta"))


def bootstrap(blocks: DataFrame, n: int = 2_000, seed: int = 1729, chunk: int = 20_000, together: int = 50) -> DataFrame:
    """low, high, replicates: 95 % interval of the average precision over stratified resamples of the block table.

    A resample of a class is a multinomial over the blocks. It is drawn in two steps, which has the same distribution: first
    over chunks of blocks in order of score, from the chunks' sums, then inside each chunk. A task draws `together` replicates
    of one chunk and sums their part of the precision; Spark adds the parts up, so no task holds the block table.
    """
    import numpy as np

    down = blocks.withColumn("_down", -F.col("score"))
    rows = global_position(down, ["_down"]).withColumn("chunk", F.floor(F.col("position") / chunk)).select("chunk", "position", "n_pos", "n_neg").persist()
    sums = sorted(rows.groupBy("chunk").agg(F.sum("n_pos").alias("p"), F.sum("n_neg").alias("q")).collect())
    totals = [np.array([r[c] for r in sums], dtype=np.int64) for c in ("p", "q")]
    if not sums or not totals[0].sum():
        return blocks.sparkSession.createDataFrame([(None, None, 0)], "low double, high double, replicates long")
    rows = rows.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // together))))

    def draw(rng, count, weights):
        total = weights.sum()
        return rng.multinomial(count, weights / total) if total else np.zeros(len(weights), np.int64)

    def part(frame):
        import pandas as pd

        frame = frame.sort_values("position")
        k, batch = int(frame["chunk"].iloc[0]), int(frame["batch"].iloc[0])
        own = [frame[c].to_numpy() for c in ("n_pos", "n_neg")]
        out = []
        for replicate in range(batch * together, min(n, (batch + 1) * together)):
            over, inside = np.random.default_rng([seed, replicate]), np.random.default_rng([seed, replicate, k + 1])
            counts = [draw(over, t.sum(), t) for t in totals]
            p, q = (draw(inside, c[k], w) for c, w in zip(counts, own))
            cp, cn = counts[0][:k].sum() + p.cumsum(), counts[1][:k].sum() + q.cumsum()
            out.append((replicate, float((p * cp / np.maximum(1, cp + cn)).sum() / counts[0].sum())))
        return pd.DataFrame(out, columns=["replicate", "value"])

    parts = rows.groupBy("chunk", "batch").applyInPandas(part, "replicate long, value double")
    values = parts.groupBy("replicate").agg(F.sum("value").alias("value"))
    return values.agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.count("*").alias("replicates"))
