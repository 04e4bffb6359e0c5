"""Exact top-k search by columnar branch and bound.

Vectors are quantised to integers floor(scale * x) and kept in blocks, dimension by dimension (vertical layout). A block
of queries meets a block of candidates in one task: partial inner products are accumulated one block of dimensions after
another; what the remaining dimensions can still add is at most the product of the remaining masses (norms), so candidates
whose partial score plus that bound lies below a query's k-th best score so far are dropped and the survivors compacted.
Results are exact. Pairs of blocks, not of rows, are joined, and each pair returns at most k rows a query.

Queries are the rows whose vec_id is divisible by `every`; candidates all rows with another vec_id. Ties go to the smaller
vec_id.

Cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null vec_id. Vectors
of different lengths: missing components count as 0. An empty vector scores 0 with all. Rows repeated with one vec_id are
candidates each, but never of their own id; a repeated query id returns one result, of its largest vector in order of
components. With fewer than k candidates all are returned. Scores beyond the exact range of a double are computed in
integers of any length and must fit a long, else an error says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates and queries of a block.
CANDIDATES = 16_384
QUERIES = 1_024
#: Queries that share one pass over the first half of the dimensions.
TOGETHER = 64
#: Dimensions accumulated between two prunings.
DIMENSIONS = 8


def search_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, candidate, score) triples: the k best of the block for each query. q and c: dimension by row."""
    d = c.shape[0]
    cuts = list(range(0, d, DIMENSIONS)) + [d]
    mass_c = np.sqrt(np.cumsum((c * c)[::-1], axis=0)[::-1]) if d else np.zeros((0, c.shape[1]))
    mass_q = np.sqrt(np.cumsum((q * q)[::-1], axis=0)[::-1]) if d else np.zeros((0, q.shape[1]))
    # candidates of large mass are likely winners: their full scores give each query its first bound
    first = np.argsort(-(mass_c[0] if d else np.zeros(c.shape[1])), kind="stable")[: max(4 * k, 256)]
    seeds = q.T @ c[:, first]
    for at in range(0, len(qid), TOGETHER):
        some = slice(at, at + TOGETHER)
        # no bound prunes much while most of the mass remains: the first half of the blocks meets all candidates
        half = cuts[len(cuts) // 2]
        parts = np.zeros((len(qid[some]), c.shape[1]))
        for lo, hi in zip(cuts, cuts[1:]):
            if hi <= half:
                parts += q[lo:hi, some].T @ c[lo:hi]
        for i, part in enumerate(parts, at):
            others = seeds[i][cid[first] != qid[i]]
            floor = np.partition(others, len(others) - k)[len(others) - k] if len(others) >= k else -np.inf
            alive = np.flatnonzero(cid != qid[i])
            part = part[alive]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < half:
                    continue
                # the factor covers the rounding of the roots; partial scores are exact integers
                keep = part + mass_q[lo, i] * mass_c[lo, alive] * (1 + 1e-9) + 1e-6 >= floor
                if not keep.all():
                    alive, part = alive[keep], part[keep]
                part = part + q[lo:hi, i] @ c[lo:hi, alive]
                if hi < d and len(part) > k:
                    low = part - mass_q[hi, i] * mass_c[hi, alive] * (1 + 1e-9) - 1e-6
                    floor = max(floor, np.partition(low, len(low) - k)[len(low) - k])
            best = np.lexsort((cid[alive], -part))[:k]
            yield np.full(len(best), qid[i]), cid[alive[best]], part[best]


def exact_block(qid, q, cid, c, k):
    """As search_block, in Python integers, where doubles could round."""
    for i in range(len(qid)):
        scores = [(-sum(int(a) * int(b) for a, b in zip(q[:, i], c[:, j])), int(cid[j])) for j in range(len(cid)) if cid[j] != qid[i]]
        best = sorted(scores)[:k]
        for score, _ in best:
            if not -(2**63) <= -score < 2**63:
                raise OverflowError("a score doesn't fit a long")
        yield np.full(len(best), qid[i]), np.array([x[1] for x in best], np.int64), np.array([-x[0] for x in best], np.int64)


def _unpack(blob: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and a (dimension, row) array of what _pack wrote, padded with zeros to d dimensions."""
    n, own = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    ids = np.frombuffer(blob, np.int64, n, 16)
    values = np.frombuffer(blob, np.float64, n * own, 16 + 8 * n).reshape(own, n)
    return ids, np.vstack([values, np.zeros((d - own, n))]) if d > own else values


def _pack(rows: list[tuple[int, np.ndarray]]) -> bytes:
    d = max((len(v) for _, v in rows), default=0)
    values = np.zeros((d, len(rows)))
    for j, (_, v) in enumerate(rows):
        values[: len(v), j] = v
    return np.array([len(rows), d], np.int64).tobytes() + np.array([i for i, _ in rows], np.int64).tobytes() + values.tobytes()


def blocks(vectors: DataFrame, size: int, scale: float) -> DataFrame:
    """data binary: the vectors of each partition, quantised, `size` in a block."""

    def run(batches):
        import pyarrow as pa

        held: list[tuple[int, np.ndarray]] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([_pack(held)], pa.binary())], ["data"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((i, np.floor(scale * np.asarray(v, np.float64))))
                if len(held) == size:
                    yield out()
                    held = []
        if held:
            yield out()

    return vectors.mapInArrow(run, "data binary")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query."""
    spark = vectors.sparkSession
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    n_c, n_q = max(1, -(-rows.count() // CANDIDATES)), max(1, -(-asked.count() // QUERIES))
    # candidates and queries are dealt to n_c and n_q groups; each pair of groups has a key, and meets in one task
    c = blocks(rows.repartition(n_c, F.pmod(F.xxhash64("vec_id"), F.lit(n_c))), CANDIDATES, scale).select(F.pmod(F.xxhash64("data"), F.lit(n_c)).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"), F.col("data").alias("c_data"))
    q = blocks(asked.repartition(n_q), QUERIES, scale).select(F.pmod(F.xxhash64("data"), F.lit(n_q)).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c"), F.col("data").alias("q_data"))
    pairs = q.join(c, ["c", "q"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                a, b = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                d = max(int(np.frombuffer(a, np.int64, 2)[1]), int(np.frombuffer(b, np.int64, 2)[1]))
                (qid, q), (cid, c) = _unpack(a, d), _unpack(b, d)
                most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(d, 1)
                found = list((search_block if most < 2**52 else exact_block)(qid, q, cid, c, k))
                if found:
                    x, y, z = (np.concatenate(col) for col in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(z.astype(np.int64), pa.int64())], ["query_id", "vec_id", "score"])

    best = pairs.select("q_data", "c_data").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
