"""Exact centroid clustering of integer vectors by equal-average equal-variance search.

The centroids stand in the order of their component means. A vector begins at the centroid whose mean is nearest to its own and
scans outward on both sides. With d components, sums S and sums of squares Q, the squared distance D of two vectors satisfies
d * D >= (Sx - Sc)^2, so a side ends where that exceeds the best distance; and d * D >= (Sx - Sc)^2 + (Vx - Vc)^2 with
V = sqrt(d * Q - S^2), which rejects single centroids. All others are measured in integers. A bound rejects only what is strictly
farther (the one with roots by a margin for its rounding), so ties still go to the smaller number.

The vectors are kept once as integers in the shared folder; a round is one scan that sends one row of sums for each task and
centroid, and brings k rows of sums to the driver, whatever the number of vectors. Centroids (k times d integers) are the
only thing broadcast.

Cases: vectors that are null, of another length, or hold null, NaN or infinite components take no part and have no row. A null
vec_id's vector is clustered, but never a first centroid. Repeated vec_ids have a row each; among equal hashes the first
centroids go by their components. With fewer than k vectors there are as many centroids. An empty table gives an empty result.
Components saturate at +-2^27 after scaling, so that squared distances of up to 64 components fit a long. Sums of distances are
decimals that become null in the result where they exceed a long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_spool, spool, tidy

#: Scaled components beyond this saturate.
MOST = 1 << 27


def _integers(vectors: DataFrame, scale: float, dimensions: int) -> DataFrame:
    """vec_id, v: the vectors that take part, floor(scale * x) of each component."""
    x = F.col("embedding").cast("array<double>")
    whole = F.when(F.size(x) == dimensions, F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
    floor = F.transform(x, lambda e: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), e * scale))).cast("int"))
    return vectors.filter(F.coalesce(whole, F.lit(False))).select("vec_id", floor.alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors with the k least hashes of `salt:vec_id`."""
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    least = rows.filter("vec_id IS NOT NULL").orderBy(hashed, "v").limit(k).collect()
    return np.array([r.v for r in least], np.int64).reshape(len(least), -1 if least else 0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the number and squared distance of its nearest centroid, and how many distances were computed."""
    n, d = x.shape
    k = len(centroids)
    sums = centroids.sum(1)
    order = np.argsort(sums, kind="stable")
    c, s = centroids[order], sums[order]
    spread = np.sqrt(np.maximum(0, d * (c.astype(np.float64) ** 2).sum(1) - s.astype(np.float64) ** 2))
    sx = x.sum(1)
    spread_x = np.sqrt(np.maximum(0, d * (x.astype(np.float64) ** 2).sum(1) - sx.astype(np.float64) ** 2))
    best = np.full(n, np.iinfo(np.int64).max, np.int64)
    found = np.full(n, k, np.int64)
    right = np.searchsorted(s, sx)
    left = right - 1
    measured = 0
    rows = np.arange(n)
    while len(rows):
        # the nearer mean of the two next ones; a side that has ended is infinitely far
        lo, hi = left[rows], right[rows]
        gap_lo = np.where(lo >= 0, sx[rows] - s[np.maximum(lo, 0)], np.iinfo(np.int64).max)
        gap_hi = np.where(hi < k, s[np.minimum(hi, k - 1)] - sx[rows], np.iinfo(np.int64).max)
        down = gap_lo <= gap_hi
        gap = np.minimum(gap_lo, gap_hi)
        at = np.where(down, lo, hi)
        # floats only choose: their bounds are lowered by more than they can be off
        bound = gap.astype(np.float64) ** 2 * (1 - 1e-12)
        most = best[rows].astype(np.float64) * d
        goes = (gap < np.iinfo(np.int64).max) & (bound <= most * (1 + 1e-12))
        rows, at, down, bound, most = rows[goes], at[goes], down[goes], bound[goes], most[goes]
        left[rows] -= down
        right[rows] += ~down
        apart = np.maximum(0, np.abs(spread_x[rows] - spread[at]) - 1e-6 * (spread_x[rows] + spread[at]) - 1e-3)
        near = bound + apart**2 * (1 - 1e-12) <= most * (1 + 1e-12)
        some, number = rows[near], order[at[near]]
        distance = ((x[some] - centroids[number]) ** 2).sum(1)
        measured += len(some)
        better = (distance < best[some]) | ((distance == best[some]) & (number < found[some]))
        best[some[better]], found[some[better]] = distance[better], number[better]
    return found, best, measured


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64) if len(column) else np.zeros((0, 1), np.int64)


def _sums(kept: DataFrame, centroids: np.ndarray) -> list[tuple[int, list[int]]]:
    """The number of vectors of each centroid and their componentwise sums: exact, one row for each centroid reaches the driver."""
    k, d = centroids.shape

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                number, _, _ = nearest(x, centroids)
                counts += np.bincount(number, minlength=k)
                np.add.at(sums, number, x)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    part = kept.select("v").mapInArrow(tidy(run), "cluster int, n long, sums array<long>")
    each = part.select("cluster", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "value"))
    total = each.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    rows = total.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("values")).collect()
    out = [(0, [0] * d)] * k
    for r in rows:
        n, *sums = [int(v["value"]) for v in r["values"]]
        out[r["cluster"]] = (n, sums)
    return out


def _assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every kept vector."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            number, distance, _ = nearest(_matrix(batch.column(1)), centroids) if batch.num_rows else (np.zeros(0), np.zeros(0), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance.astype(np.int64))], ["vec_id", "cluster", "distance"])

    return kept.select("vec_id", "v").mapInArrow(tidy(run), f"vec_id {dict(kept.dtypes)['vec_id']}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: float = 1024.0, dimensions: int = 64, salt: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    kept = spool(_integers(vectors, scale, dimensions), "integers")
    centroids = first_centroids(kept, k, salt)
    for _ in range(rounds if len(centroids) else 0):
        moved = [[total // n for total in sums] if n else old for (n, sums), old in zip(_sums(kept, centroids), centroids.tolist())]
        centroids = np.array(moved, np.int64)
    if not len(centroids):  # no vector has an id, or there is none
        kept = kept.limit(0)
    placed = spool(_assigned(kept, centroids), "placed")
    drop_spool(kept)
    by_cluster = {r.cluster: r.inertia for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    whole = sum(by_cluster.values())
    fits = lambda v: int(v) if v < 1 << 63 else None
    facts = spark.createDataFrame([(c, fits(by_cluster[c]), fits(whole), digests[c]) for c in sorted(by_cluster)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int, rounds: int, scale: int, dimensions: int, salt: str) -> str:
    """The same by measuring every distance, one pair of table expressions for each round."""
    parts = [
        f"""v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id)) - 1 AS c, v AS z FROM v ORDER BY sha256('{salt}:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        measured = f"SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r}"
        parts.append(f"a{r} AS MATERIALIZED (SELECT * FROM ({measured}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if r < rounds:
            sums = f"SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {dimensions + 1}) AS t(i) GROUP BY c, i"
            means = f"SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS z FROM ({sums}) GROUP BY c"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.z, o.z) AS z FROM c{r} o LEFT JOIN ({means}) m ON m.c = o.c)")
    return f"""WITH {', '.join(parts)}
        SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} z ON z.c = a.c"""
