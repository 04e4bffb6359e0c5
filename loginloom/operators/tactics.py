"""Technique classification: rules over features as column expressions, with the terms that fired as evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import stream_past, totals_before

# The least score that is reported, and the bands of confidence.
LEAST, DECISIVE, HIGH, MEDIUM = 0.25, 0.15, 0.65, 0.45


def ramp(x, lo: float, hi: float) -> Column:
    """0 up to lo, 1 from hi, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))


class Rule:
    """Terms (condition, weight, what it says), under a condition for the whole."""

    def __init__(self, gate: Column, terms: list[tuple[Column, Column | float, str]]):
        self.gate, self.terms = gate, terms

    def score(self) -> Column:
        total = reduce(lambda a, b: a + b, (F.when(on, F.lit(w) if isinstance(w, float) else w).otherwise(0.0) for on, w, _ in self.terms))
        return F.when(self.gate, F.least(F.lit(1.0), total)).otherwise(0.0)

    def evidence(self) -> Column:
        says = F.array_compact(F.array(*[F.when(self.gate & on, F.lit(text)) for on, _, text in self.terms]))
        return says


def rules() -> dict[str, Rule]:
    c = F.col
    new, rare = c("is_new_pair") == 1, c("dst_historical_degree") <= 3
    pivoted = c("pivot_signal") >= 1.0
    fanout = ramp(c("src_host_unique_dst_1h"), 4, 12)
    burst, breadth = c("user_unique_dst_5m"), c("user_unique_dst_5m") / F.greatest(F.lit(1.0), c("user_unique_dst_24h").cast("double"))
    own = c("user_unique_dst_5m") / F.greatest(F.lit(1.0), c("user_historical_degree").cast("double"))
    chained = c("chain_hop") == 1
    late = c("seconds_since_tgt") > 36_000
    no_tgt = c("seconds_since_tgt").isNull() & (c("tgt_coverage") >= 0.5)
    none_failed = c("failures_before_success_15m") == 0
    return {
        "T1021": Rule(
            chained | (fanout > 0),
            [
                (chained, 1.0, "account continued a chain"),
                (fanout > 0, 0.55 * fanout, "many destinations from the source in an hour"),
                (new, 0.20, "new account-host pair"),
                (rare, 0.15, "destination is rarely reached"),
                (pivoted, 0.10, "source was itself reached"),
                (c("logon_id").isin(1, 3), 0.05, "remote logon type"),
            ],
        ),
        "T1110": Rule(
            F.lit(True),
            [
                (c("user_failure_rate_15m") > 0.2, 0.45 * ramp(c("user_failure_rate_15m"), 0.2, 3.0), "share of failures in 15 minutes"),
                (c("failures_before_success_15m") > 0, 0.40 * ramp(c("failures_before_success_15m"), 1, 8), "failures before this success"),
                ((c("user_failure_rate_15m") > 0) & (burst >= 3), 0.20 * ramp(burst, 3, 15), "failures over many destinations"),
                (c("logon_id") == 2, 0.10, "cleartext logon"),
            ],
        ),
        "T1087": Rule(
            F.lit(True),
            [
                (burst > 4, 0.40 * ramp(burst, 4, 20), "burst of destinations"),
                ((breadth > 0.3) & (burst >= 3), 0.25 * ramp(breadth, 0.3, 1.0), "burst is much of a day's reach"),
                (c("user_new_dst_ratio_1h") > 0.5, 0.25 * ramp(c("user_new_dst_ratio_1h"), 0.5, 1.0), "most destinations were new"),
                ((c("orient_name") == "TGS") & (burst >= 4), 0.15, "service tickets over many targets"),
            ],
        ),
        "T1078": Rule(
            new & (c("success") == 1) & none_failed & ((c("destination_novelty") > 0.7) | rare),
            [
                (F.lit(True), 0.45, "new pair succeeded at once"),
                (c("rare_logon_score") > 0.5, 0.20 * ramp(c("rare_logon_score"), 0.5, 1.0), "unusual logon"),
                (c("destination_novelty") > 0.7, 0.15 * ramp(c("destination_novelty"), 0.7, 1.0), "unusual destination"),
                (rare, 0.12, "destination is rarely reached"),
                ((c("user_seen_before") == 1) & (c("pair_rarity") > 0.5), 0.10, "known account at an unfamiliar host"),
            ],
        ),
        "T1550.003": Rule(
            (c("orient_name") == "TGS") & (late | no_tgt),
            [
                (no_tgt, 0.55, "service ticket without a ticket-granting ticket"),
                (late, 0.35, "service ticket long after the ticket-granting ticket"),
                (new, 0.20, "new account-host pair"),
                (rare, 0.10, "destination is rarely reached"),
            ],
        ),
        "T1078.002": Rule(
            (c("usr") % 7 == 0) & ((c("logon_id") == 0) | new | ((burst >= 3) & (own > 0.4))),
            [
                (c("logon_id") == 0, 0.60, "interactive logon of a machine account"),
                ((burst >= 3) & (own > 0.4), 0.25, "reach beyond the account's past"),
                (new, 0.15, "new account-host pair"),
            ],
        ),
        "T1550.002": Rule(
            (c("auth_name") == "NTLM") & (c("kerberos_share") >= 0.5),
            [
                (F.lit(True), 0.35 * ramp(c("kerberos_share"), 0.5, 0.95), "NTLM where most use Kerberos"),
                (new, 0.30, "new account-host pair"),
                (pivoted, 0.20, "source was itself reached"),
                (rare, 0.10, "destination is rarely reached"),
            ],
        ),
    }


def classify(rows: DataFrame) -> DataFrame:
    """rows with a score for each technique, technique (the best one reported, or null), technique_score, confidence, evidence."""
    found = rules()
    name = lambda k: "score_" + k.replace(".", "_")
    scored = rows.withColumns({name(k): F.round(r.score(), 9) for k, r in found.items()})
    items = F.array(*[F.struct((-F.col(name(k))).alias("minus"), F.lit(k).alias("id"), r.evidence().alias("evidence")) for k, r in found.items()])
    ranked = F.sort_array(F.filter(items, lambda x: x["minus"] <= -LEAST))
    scored = scored.withColumn("_ranked", ranked)
    best, second = -F.get("_ranked", F.lit(0))["minus"], F.coalesce(-F.get("_ranked", F.lit(1))["minus"], F.lit(0.0))
    first = F.get("_ranked", F.lit(0))
    confidence = F.when(F.size("_ranked") == 0, "none").when((F.col("chain_hop") == 1) & (first["id"] == "T1021"), "high").when((best >= HIGH) & (best - second >= DECISIVE), "high").when(best >= MEDIUM, "medium").otherwise("low")
    return scored.withColumns({"technique": first["id"], "technique_score": best, "confidence": confidence, "evidence": F.array_join(F.coalesce(first["evidence"], F.array()), "; ")}).drop("_ranked")


def _with_tickets(events: DataFrame) -> DataFrame:
    """events with _last, the time of the account's last ticket-granting ticket before, and _asked and _got: 1 on an account's first request
    for tickets and on its first ticket-granting ticket."""
    is_tgt, asks = F.col("orient_name") == "TGT", F.col("orient_name").isin("TGT", "TGS")
    rows = events.withColumn("_last", F.max(F.when(is_tgt, F.col("t"))).over(stream_past("usr")))
    return rows.withColumns({"_asked": (asks & (F.coalesce(F.sum(asks.cast("int")).over(stream_past("usr")), F.lit(0)) == 0)).cast("int"), "_got": (is_tgt & F.col("_last").isNull()).cast("int")})


def _tickets() -> dict[str, Column]:
    asked, got = F.col("before__asked"), F.col("before__got")
    return {"seconds_since_tgt": F.col("t") - F.col("_last"), "tgt_coverage": F.when(asked > 0, got / asked).otherwise(0.0)}


def _share(n: int) -> dict[str, Column]:
    seen = F.least(F.col("position"), F.lit(n))
    return {"kerberos_share": F.when(seen > 0, (F.col("before__k") - F.col("older__k")) / seen).otherwise(0.0)}


def _kerberos(events: DataFrame) -> DataFrame:
    return events.withColumn("_k", (F.col("auth_name") == "Kerberos").cast("int"))


def tgt_context(events: DataFrame) -> DataFrame:
    """events with seconds_since_tgt (of the account, before this row) and tgt_coverage (accounts with a ticket-granting
    ticket among those that asked for tickets, before this row)."""
    rows = totals_before(_with_tickets(events), ["t", "event_id"], ["_asked", "_got"])
    return rows.select(*events.columns, *[c.alias(k) for k, c in _tickets().items()])


def kerberos_share(events: DataFrame, n: int = 5_000) -> DataFrame:
    """events with kerberos_share: the share of Kerberos among the last n rows before this one in stream order."""
    rows = totals_before(_kerberos(events), ["t", "event_id"], ["_k"], back=n)
    return rows.select(*events.columns, *[c.alias(k) for k, c in _share(n).items()])


def stream_context(events: DataFrame, n: int = 5_000) -> DataFrame:
    """events with what tgt_context and kerberos_share say, from one pass over the accounts and one over the stream."""
    rows = totals_before(_kerberos(_with_tickets(events)), ["t", "event_id"], ["_asked", "_got", "_k"], back=n)
    return rows.select(*events.columns, *[c.alias(k) for k, c in {**_tickets(), **_share(n)}.items()])
