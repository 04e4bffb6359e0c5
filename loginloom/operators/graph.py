"""Temporal graph work over scored events: edges, neighbours, paths, entity risk, diffusion, reach, similarity."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_dir
from .windows import strict_past

WINDOW, MAX_EDGES, MIN_RISK = 1_800, 5, 0.5


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """df as a checkpoint in the shared folder, so that iterations neither recompute nor depend on lost executors."""
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None):
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def temporal_edges(events: DataFrame) -> DataFrame:
    """Directed edges account -> destination with typed node ids; the source host stays as a column."""
    return events.select("event_id", "t", F.concat(F.lit("user:"), "usr").alias("source"), F.concat(F.lit("host:"), "dst").alias("destination"), F.concat(F.lit("host:"), "src").alias("origin"), "success", "label")


def recent_neighbors(events: DataFrame, k: int = 20, window: int | None = None) -> DataFrame:
    """event_id, n_neighbors, neighbors: the account's last k destinations strictly before the event, newest first.

    The first event of an account's second collects the k rows above it, in one sort of the account's history; the others of that
    second take its list. Within a second the order is that of event_id. Without an account there are none.
    """
    order = Window.partitionBy("usr").orderBy("t", "event_id")
    opens = F.coalesce(F.lag("t").over(order) < F.col("t"), F.lit(True))
    above = F.collect_list(F.struct(F.col("t").alias("seen"), "dst")).over(order.rowsBetween(-k, -1))
    rows = events.select("event_id", "t", "usr", F.when(opens, above).alias("above"))
    rows = rows.withColumn("above", F.last("above", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    near = F.filter("above", lambda x: x["seen"] > F.col("t") - window) if window else F.col("above")
    near = F.when(F.col("usr").isNotNull(), F.reverse(near)).otherwise(F.array().cast(rows.schema["above"].dataType))
    return rows.withColumn("above", near).select("event_id", F.size("above").cast("long").alias("n_neighbors"), F.array_join(F.transform("above", lambda x: x["dst"].cast("string")), ",").alias("neighbors"))


def rank_paths(scored: DataFrame, window: int = WINDOW, max_edges: int = MAX_EDGES, min_risk: float = MIN_RISK) -> DataFrame:
    """All time-respecting paths of 2 to max_edges risky edges: each edge leaves the host that the last one reached, later
    and within the window, to a host not yet visited.

    An edge meets those of its host and of this or the next time bucket only: an equi-join on (host, bucket), so hubs are
    split by time.
    """
    bucket = lambda t: F.floor(t / window)
    edge = scored.filter(F.col("risk") >= min_risk).select("event_id", "t", "src", "dst", "risk", "is_new", "support")
    nxt = edge.select(*[F.col(c).alias(f"n_{c}") for c in edge.columns]).withColumn("n_bucket", bucket(F.col("n_t")))
    paths = edge.select(F.array("event_id").alias("events"), F.array("src", "dst").alias("hosts"), F.col("t").alias("first_t"), F.col("t").alias("last_t"), F.col("dst").alias("at"), F.col("risk").alias("risks"), F.col("is_new").alias("news"), F.col("support").alias("supports"))
    found = []
    for _ in range(max_edges - 1):
        ahead = paths.withColumn("n_bucket", F.explode(F.array(bucket(F.col("last_t")), bucket(F.col("last_t")) + 1)))
        joined = ahead.join(nxt, (ahead["at"] == nxt["n_src"]) & (ahead["n_bucket"] == nxt["n_bucket"]))
        fits = (F.col("n_t") > F.col("last_t")) & (F.col("n_t") <= F.col("last_t") + window) & ~F.array_contains("hosts", F.col("n_dst"))
        paths = joined.filter(fits).select(
            F.concat("events", F.array("n_event_id")).alias("events"),
            F.concat("hosts", F.array("n_dst")).alias("hosts"),
            "first_t",
            F.col("n_t").alias("last_t"),
            F.col("n_dst").alias("at"),
            (F.col("risks") + F.col("n_risk")).alias("risks"),
            (F.col("news") + F.col("n_is_new")).alias("news"),
            (F.col("supports") + F.col("n_support")).alias("supports"),
        )
        found.append(paths)
    return reduce(lambda a, b: a.unionByName(b), found)


def score_paths(paths: DataFrame, top_k: int | None = 20, most_support: int = 3) -> DataFrame:
    """.55 mean risk + .20 share of new relationships + .15 (n-1)/n + .10 mean support; the best first, ties by time and ids."""
    n = F.size("events")
    score = 0.55 * F.col("risks") / n + 0.20 * F.col("news") / n + 0.15 * (n - 1) / n + 0.10 * F.least(F.lit(1.0), F.col("supports") / n / most_support)
    rows = paths.withColumns({"n_edges": n, "score": F.round(score, 6)})
    return rows if top_k is None else rows.orderBy(F.desc("score"), "first_t", "last_t", "events").limit(top_k)


def advance_paths(batch: DataFrame, tail: DataFrame, known: DataFrame, window: int = WINDOW, max_edges: int = MAX_EDGES, min_risk: float = MIN_RISK) -> tuple[DataFrame, DataFrame]:
    """(new paths, next tail): paths over the tail and the batch whose ids aren't known; edges too old to be continued go."""
    both = tail.unionByName(batch)
    paths = rank_paths(both, window, max_edges, min_risk).withColumn("path_id", F.concat_ws("-", "events"))
    last = both.agg(F.max("t").alias("last_t"))
    kept = both.join(F.broadcast(last), F.col("t") > F.col("last_t") - window * max_edges).drop("last_t")
    return paths.join(known.select("path_id"), "path_id", "left_anti"), kept


def attack_graph(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): entities with greatest risk and alert count; sessions account -> source, logons source -> destination."""
    roles = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id")) for kind, c in (("user", "usr"), ("host", "src"), ("host", "dst"))])).alias("e")
    nodes = alerts.select("event_id", "risk", roles).select("e.kind", "e.id", "event_id", "risk").groupBy("kind", "id").agg(F.max("risk").alias("max_risk"), F.count_distinct("event_id").alias("n_alerts"))
    session = alerts.select(F.lit("session").alias("kind"), F.concat(F.lit("user:"), "usr").alias("a"), F.concat(F.lit("host:"), "src").alias("b"), "risk")
    auth = alerts.select(F.lit("auth").alias("kind"), F.concat(F.lit("host:"), "src").alias("a"), F.concat(F.lit("host:"), "dst").alias("b"), "risk")
    return nodes, session.union(auth).groupBy("kind", "a", "b").agg(F.count("*").alias("n_alerts"), F.max("risk").alias("max_risk"))


def entity_roles(alerts: DataFrame) -> DataFrame:
    """kind, id, other, t, risk: each alert seen from its account, its source and its destination."""
    pick = lambda kind, own, other: F.struct(F.lit(kind).alias("kind"), F.col(own).alias("id"), F.concat(F.lit(f"{other}:"), F.col(other)).alias("other"))
    return alerts.select("t", "risk", F.explode(F.array(pick("user", "usr", "dst"), pick("source", "src", "dst"), pick("destination", "dst", "usr"))).alias("e")).select("e.*", "t", "risk")


def entity_risk(alerts: DataFrame, half_life: int = 3_600, saturation: int = 8, top_k: int = 50) -> DataFrame:
    """Entities by decayed risk mass and fan-out: .7 (1 - exp(-sum risk * .5^(age/half_life))) + .3 min(1, others/saturation)."""
    now = alerts.agg(F.max("t").alias("now"))
    rows = entity_roles(alerts).join(F.broadcast(now))
    mass = F.sum(F.col("risk") * F.pow(F.lit(0.5), (F.col("now") - F.col("t")) / half_life))
    found = rows.groupBy("kind", "id").agg(mass.alias("mass"), F.count_distinct("other").alias("others"), F.count("*").alias("n_alerts"))
    score = 0.7 * (1 - F.exp(-F.col("mass"))) + 0.3 * F.least(F.lit(1.0), F.col("others") / saturation)
    return found.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "kind", "id").limit(top_k).select("kind", "id", "score", "others", "n_alerts")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, every: int = 5) -> DataFrame:
    """node, mass, risk: damped diffusion with restart over edges (a, b, weight) from seeds (node, seed).

    Mass at nodes without out-edges is dropped. risk is the greater of 1 - exp(-mass) and the seed. The lineage is cut and
    the change looked at every few rounds.
    """
    share = edges.groupBy("a").agg(F.sum("weight").alias("out"))
    steps = cut_lineage(edges.join(share, "a").select("a", "b", (F.col("weight") / F.col("out")).alias("share")), "steps")
    nodes = cut_lineage(edges.select(F.col("a").alias("node")).union(edges.select("b")).union(seeds.select("node")).distinct().join(seeds, "node", "left").fillna({"seed": 0.0}), "nodes")
    mass = nodes.select("node", "seed", F.col("seed").alias("mass"))
    for k in range(1, max_iter + 1):
        before = mass
        got = steps.join(mass.select(F.col("node").alias("a"), "mass"), "a").groupBy(F.col("b").alias("node")).agg(F.sum(F.col("mass") * F.col("share")).alias("got"))
        mass = nodes.join(got, "node", "left").select("node", "seed", ((1 - damping) * F.col("seed") + damping * F.coalesce("got", F.lit(0.0))).alias("mass"))
        if k % every == 0 or k == max_iter:
            both = cut_lineage(mass.join(before.select("node", F.col("mass").alias("old")), "node"), "mass")
            change = both.agg(F.sum(F.abs(F.col("mass") - F.col("old")))).first()[0] or 0.0
            mass = both.drop("old")
            if change < tol:
                break
    return mass.select("node", "mass", F.greatest(1 - F.exp(-F.col("mass")), F.col("seed")).alias("risk"))


def hop_distance(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """node, hops: breadth first from the seeds along edges (a, b) until nothing new is reached, or for `most` hops;
    unreachable nodes have no row."""
    reached = seeds.select("node").distinct().withColumn("hops", F.lit(0))
    front = reached
    for k in count(1) if most is None else range(1, most + 1):
        step = edges.join(front.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        front = cut_lineage(step.join(reached, "node", "left_anti").withColumn("hops", F.lit(k)), "front")
        if not front.limit(1).count():
            break
        reached = reached.union(front)
        if k % 4 == 0:
            reached = cut_lineage(reached, "reached")
    return reached


def alert_hops(alerts: DataFrame) -> DataFrame:
    """Two hops an alert: account -> source and source -> destination."""
    hop = lambda i, a, b: F.struct(F.lit(i).alias("hop"), F.concat(F.lit(f"{a}:"), F.col(a)).alias("actor"), F.concat(F.lit(f"{b}:"), F.col(b)).alias("target"))
    return alerts.select("event_id", "t", "risk", F.explode(F.array(hop(0, "usr", "src"), hop(1, "src", "dst"))).alias("h")).select("event_id", "t", "risk", "h.*")


#: Queries and vectors of a block, and queries that are multiplied at once.
QUERIES, VECTORS, TOGETHER = 8_192, 16_384, 32


def similar_by_blocks(own: DataFrame, asked: DataFrame, k: int, n: int) -> DataFrame:
    """query_id, vec_id, raw: of each pair of blocks what can be among a query's k best once similarities are rounded.

    Components are summed in their order, as the SQL does. Rows of other length don't match.
    """
    n_q, n_v = max(1, -(-n // QUERIES)), max(1, -(-own.count() // VECTORS))
    block = lambda by, n: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("qb", block(["query_id", "q"], n_q)).withColumn("vb", every(n_v))
    right = own.withColumn("vb", block(["vec_id", "embedding"], n_v)).withColumn("qb", every(n_q))
    margin = 3e-6

    def pairs(q, v):
        import numpy as np
        import pandas as pd

        out = []
        v = v.dropna(subset=["vec_id"]).sort_values("vec_id")
        q = q.dropna(subset=["query_id"])
        for d, some in q.groupby(q["q"].map(len)):
            met = v[v["embedding"].map(len) == d]
            if not len(met):
                continue
            c = np.stack([np.asarray(x, np.float64) for x in met["embedding"]]).T.copy()
            ids, norms = met["vec_id"].to_numpy(), met["norm"].to_numpy()
            for at in range(0, len(some), TOGETHER):
                part = some.iloc[at : at + TOGETHER]
                x = np.stack([np.asarray(r, np.float64) for r in part["q"]])
                raw = np.zeros((len(part), len(ids)))
                for a in range(d):
                    raw += c[a] * x[:, a, None]
                raw = raw / norms / part["q_norm"].to_numpy()[:, None]
                for query, row in zip(part["query_id"], raw):
                    rank = np.where(np.isnan(row), np.inf, row)
                    rank[ids == query] = -np.inf
                    kth = np.partition(rank, len(rank) - k)[len(rank) - k] if len(rank) > k else -np.inf
                    near = np.flatnonzero((rank >= kth - margin) & (rank > -np.inf))
                    # of equal similarities only the k smallest ids count
                    near = near[pd.Series(rank[near]).groupby(rank[near]).cumcount().to_numpy() < k]
                    out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near], "raw": row[near]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "raw": []})

    kind = {**dict(own.dtypes), **dict(asked.dtypes)}
    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(pairs, f"query_id {kind['query_id']}, vec_id {kind['vec_id']}, raw double")


def similar(vectors: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.0) -> DataFrame:
    """query_id, rank, vec_id, similarity: cosine top-k; zero vectors and the query itself are left out.

    Blocks of queries meet blocks of vectors; each pair of blocks gives little more than k rows a query.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = vectors.select("vec_id", "embedding", norm(F.col("embedding")).alias("norm")).filter("norm > 0")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), norm(F.col("embedding")).alias("q_norm")).filter("q_norm > 0")
    found = similar_by_blocks(own, asked, k, asked.count()).withColumn("similarity", F.round("raw", 6)).filter(F.col("similarity") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


def related_alerts(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """target, event_id, t, shared: alerts that share an entity with a target alert, and how many entities."""
    entity = F.explode(F.array_distinct(F.array(F.concat(F.lit("user:"), "usr"), F.concat(F.lit("host:"), "src"), F.concat(F.lit("host:"), "dst")))).alias("entity")
    rows = alerts.select("event_id", "t", entity)
    asked = alerts.join(ids, "event_id").select(F.col("event_id").alias("target"), entity)
    return asked.join(rows, "entity").filter("target <> event_id").groupBy("target", "event_id", "t").agg(F.count("*").alias("shared"))


def entity_profile(events: DataFrame) -> DataFrame:
    """usr, n, n_dst, n_src, failures, busiest_hour: what an account does."""
    hour = F.floor(F.pmod("t", F.lit(86_400)) / 3_600)
    by_hour = events.groupBy("usr", hour.alias("hour")).count().groupBy("usr").agg(F.max_by("hour", F.struct("count", -F.col("hour"))).alias("busiest_hour"))
    total = events.groupBy("usr").agg(F.count("*").alias("n"), F.count_distinct("dst").alias("n_dst"), F.count_distinct("src").alias("n_src"), F.sum(1 - F.col("success")).cast("long").alias("failures"))
    return total.join(by_hour, "usr")


def incidents(alerts: DataFrame, gap: int = WINDOW) -> DataFrame:
    """alerts with `incident`, account and first time: an account's alerts, cut where none came for longer than gap."""
    order = Window.partitionBy("usr").orderBy("t", "event_id")
    last = F.lag("t").over(order)
    opens = F.when(last.isNull() | (F.col("t") - last > gap), F.col("t"))
    return alerts.withColumn("_opens", opens).withColumn("incident", F.concat_ws("@", "usr", F.max("_opens").over(order))).drop("_opens")


CHAIN_END = "struct<length:bigint,total:double,at:bigint>"


def chain_lengths(hops: DataFrame, by: str = "incident", every: int = 3) -> DataFrame:
    """hops with position (from 1, by t, event_id, hop), length, total (risk) and previous: the best chain that ends in each hop.

    A chain goes on with a later hop of the incident whose actor is its last target. Of the chains that reach an actor the longest
    counts, then the riskiest, then the one whose last hop came first. Hops are relaxed all at once, one layer in a round: a running
    maximum over each node's arrivals and departures, until nothing changes, after as many rounds as the longest chain has hops.
    The lineage is cut, and the change looked at, every few rounds.
    """
    order = Window.partitionBy(by).orderBy("t", "event_id", "hop")
    first = hops.withColumns({"position": F.row_number().over(order).cast("long"), "length": F.lit(1).cast("long"), "total": F.col("risk").cast("double"), "previous": F.lit(None).cast("long")})
    now = cut_lineage(first, "chains")
    arrived = Window.partitionBy(by, "_node").orderBy("position").rangeBetween(Window.unboundedPreceding, -1)
    while True:
        before = now
        for _ in range(every):
            here = F.struct("length", "total", (-F.col("position")).alias("at"))
            ends = F.array(F.struct(F.col("actor").alias("node"), F.lit(None).cast(CHAIN_END).alias("chain")), F.struct(F.col("target").alias("node"), here.alias("chain")))
            rows = now.withColumn("_e", F.explode(ends)).withColumns({"_node": F.col("_e.node"), "_chain": F.col("_e.chain")})
            rows = rows.withColumn("_best", F.max("_chain").over(arrived)).filter("_chain IS NULL")
            made = {"length": F.coalesce(F.col("_best.length"), F.lit(0)) + 1, "total": F.coalesce(F.col("_best.total"), F.lit(0.0)) + F.col("risk"), "previous": -F.col("_best.at")}
            now = rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in first.columns])
        now = cut_lineage(now, "chains")
        old = before.select(by, "position", F.struct("length", "total", "previous").alias("_old"))
        if now.join(old, [by, "position"]).filter(~F.col("_old").eqNullSafe(F.struct("length", "total", "previous"))).isEmpty():
            return now


def kill_chain(hops: DataFrame, by: str = "incident") -> DataFrame:
    """incident, node, layer, longest: a node's layer is the length of the longest chain that reaches it, 0 if none does."""
    best = chain_lengths(hops, by)
    ends = F.explode(F.array(F.struct(F.col("actor").alias("node"), F.lit(0).cast("long").alias("layer")), F.struct(F.col("target").alias("node"), F.col("length").alias("layer")))).alias("e")
    layers = best.select(by, ends).groupBy(by, "e.node").agg(F.max("e.layer").alias("layer"))
    return layers.join(best.groupBy(by).agg(F.max("length").alias("longest")), by)


def kill_chain_primary(hops: DataFrame, by: str = "incident") -> DataFrame:
    """incident, place (from 1), event_id, hop, t, actor, target, risk, length, total: the longest chronological chain of each incident.

    Ties go to the greater total risk, then to the target that was reached first. The chain is walked back from its last hop,
    a join for each place, all incidents at once.
    """
    best = chain_lengths(hops, by)
    reached = Window.partitionBy(by, "target")
    ends = best.withColumn("_first", F.min("position").over(reached))
    winner = ends.groupBy(by).agg(F.max(F.struct("length", "total", (-F.col("_first")).alias("first"), (-F.col("position")).alias("at"))).alias("w"))
    at = winner.select(by, (-F.col("w.at")).alias("position"), F.col("w.length").alias("length"), F.col("w.total").alias("total"))
    steps = best.select(by, "position", "previous", "event_id", "hop", "t", "actor", "target", "risk", F.col("length").alias("place"))
    longest = best.agg(F.max("length")).first()[0] or 0
    found = None
    for _ in range(longest):
        part = cut_lineage(at.join(steps, [by, "position"]), "walk")
        found = part if found is None else found.union(part)
        at = part.filter("previous IS NOT NULL").select(by, F.col("previous").alias("position"), "length", "total")
    columns = [by, "place", "event_id", "hop", "t", "actor", "target", "risk", "length", "total"]
    return found.select(*columns) if found is not None else at.join(steps, [by, "position"]).select(*columns)


def kill_chain_edges(hops: DataFrame, by: str = "incident") -> DataFrame:
    """hops with primary: whether an alert has a hop on its incident's primary chain."""
    main = kill_chain_primary(hops, by).select(by, "event_id").distinct().withColumn("primary", F.lit(1))
    return hops.join(main, [by, "event_id"], "left").fillna({"primary": 0})
