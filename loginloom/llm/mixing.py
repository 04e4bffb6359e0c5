"""Mixing sources to target weights by a splitting tree of multivariate hypergeometric draws.

Every source is hashed into blocks, permuted by the hash itself. A source whose target is above its size is taken whole
once and the rest again, never more than twice. The last, partial pass takes whole blocks in permuted order and ends inside
one block, at a whole document. The blocks of each pass are a source's quota; a binary tree over the output shards splits
all quotas: at each node a multivariate hypergeometric draw says how many of each source's blocks go left. The leaves draw
disjoint ranges of each source's permuted blocks: a document has as many copies as shards have drawn its block. Each shard is
shuffled by a hash of its documents.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating; together they share `share` of all words; a target
stops at `most` times its source's size and the excess is shared again by weight until none is above.

Cases: a null or empty text has size 0 and nothing of it is taken. Sources of size 0 have target 0. Repeated rows are
separate documents. An empty table gives no rows. The driver sees one sum for each source and block: MAX_SOURCES sources
at most (more are an error), BLOCKS blocks each. Reruns agree: every draw comes from `seed` and hashes of doc_id and text. Other columns pass through; names that begin with
mix_ are the operator's own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, spool

#: Blocks of one source.
BLOCKS = 128
#: Sources that the driver takes on; a mixture is stated over far fewer.
MAX_SOURCES = 20_000
#: Rows of a plan that is broadcast; a larger one is joined by a shuffle.
BROADCAST = 100_000
WEIGHTS = (3, 1, 2)


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Shares of share * sum(sizes) by weight, none above most * its size: water-filling."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if left * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        open_.difference_update(full)
        left = share * sum(sizes) - sum(out[i] for i in range(len(sizes)) if i not in open_)
        if left <= 0:
            break
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) block counts: quotas split among shards so that all shards get as many blocks, at most one apart."""
    if shards == 1:
        return quotas[None, :]
    left, n = shards // 2, int(quotas.sum())
    take = n * left // shards
    if n:
        drawn, rest, pool = np.zeros_like(quotas), take, n
        for s, q in enumerate(quotas):  # a multivariate draw, one source after another
            pool -= int(q)
            drawn[s] = rng.hypergeometric(int(q), pool, rest) if rest and q + pool else 0
            rest -= int(drawn[s])
    else:
        drawn = np.zeros_like(quotas)
    return np.vstack([split_tree(drawn, left, rng), split_tree(quotas - drawn, shards - left, rng)])


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """docs with what the plan speaks of: size in words, row_key (the permutation) and block."""
    rows = docs.withColumns(
        {
            "mix_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
            "mix_key": F.xxhash64(F.lit(seed), "doc_id", "text"),
        }
    )
    return rows.withColumn("mix_block", F.pmod(F.xxhash64("mix_key"), F.lit(BLOCKS)).cast("int"))


def _plan(slim: DataFrame, shards: int, share: float, most: float, seed: int) -> DataFrame:
    """For each source and block: copies of its documents, the last key of one copy more, and the shards of the copies."""
    spark = slim.sparkSession
    sums = slim.groupBy("source", "mix_block").agg(F.sum("mix_size").alias("words")).limit(MAX_SOURCES * BLOCKS + 1).collect()
    names = sorted({r.source for r in sums}, key=lambda x: (x is None, x or ""))
    if len(names) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    number = {x: i for i, x in enumerate(names)}
    words = np.zeros((len(names), BLOCKS), np.int64)
    for r in sums:
        words[number[r.source], r.mix_block] = r.words
    sizes = [int(x) for x in words.sum(1)]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))], share, most)
    rng = np.random.default_rng(seed)
    orders, ends_in, quotas = [], [], np.zeros(2 * len(names), np.int64)
    for i in range(len(names)):
        passes = int(goal[i] // sizes[i]) if sizes[i] else 0
        rest = goal[i] - passes * sizes[i]
        order = rng.permutation(BLOCKS)
        ends = np.cumsum(words[i, order])
        whole = int(np.searchsorted(ends, rest, side="right")) if sizes[i] else 0
        inside = float(rest - (ends[whole - 1] if whole else 0)) if whole < BLOCKS and sizes[i] else 0.0
        orders.append(order)
        ends_in.append((passes, whole, inside))
        partial = whole + (inside > 0)
        # the first pass and the second; a pass that is not whole has the blocks before its end
        quotas[2 * i : 2 * i + 2] = (partial, 0) if not passes else (BLOCKS, partial) if passes == 1 else (BLOCKS, BLOCKS)
    upto = np.cumsum(split_tree(quotas, shards, rng), axis=0)
    # where the partial pass ends: the last document, by key, whose middle lies before the end
    last = {}
    bounds = [(n, int(orders[i][w]), x) for i, n in enumerate(names) for _, w, x in [ends_in[i]] if x > 0]
    if bounds:
        inside = spark.createDataFrame(bounds, "bound_source string, bound_block int, inside double")
        order = Window.partitionBy("source").orderBy("mix_key").rangeBetween(Window.unboundedPreceding, 0)
        cut = slim.join(F.broadcast(inside), F.col("source").eqNullSafe(F.col("bound_source")) & (F.col("mix_block") == F.col("bound_block")))
        cut = cut.withColumn("upto", F.sum("mix_size").over(order)).filter(F.col("upto") - F.col("mix_size") / 2 <= F.col("inside"))
        last = {r.source: r.last for r in cut.groupBy("source").agg(F.max("mix_key").alias("last")).collect()}
    rows = []
    for i, name in enumerate(names):
        passes, whole, inside = ends_in[i]
        for at, b in enumerate(orders[i].tolist()):
            # the shards whose drawn ranges hold this block, in either pass
            drawn = [int(np.searchsorted(upto[:, 2 * i + k], at, side="right")) for k in (0, 1)]
            places = [p for p in drawn if p < shards]
            cut = at == whole and inside > 0
            rows.append((name, b, sizes[i], goal[i], cut, last.get(name) if cut else None, places))
    plan = spark.createDataFrame(rows, "mix_source string, mix_plan int, mix_source_size long, mix_target double, mix_cut boolean, mix_last long, mix_drawn array<int>")
    return F.broadcast(plan) if len(rows) <= BROADCAST else plan


def mix(docs: DataFrame, shards: int = 16, share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_places, the output shard of each copy that the mix takes.

    One pass over the texts sums the blocks; the plan, a row for each source and block with the shards that drew it, is applied
    in a second pass. In the block where a source's last pass ends, documents behind the end lose that pass's copy. Rows
    repeated in full share a key and so their copies.
    """
    keyed = _keyed(docs, seed)
    slim = spool(keyed.select("source", "mix_size", "mix_key", "mix_block"), "mix")
    rows = keyed.join(_plan(slim, shards, share, most, seed), F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("mix_block") == F.col("mix_plan")))
    behind = F.col("mix_cut") & ~F.coalesce(F.col("mix_key") <= F.col("mix_last"), F.lit(False))
    places = F.when(F.col("mix_size") == 0, F.array().cast("array<int>")).when(behind, F.slice("mix_drawn", 1, F.size("mix_drawn") - 1)).otherwise(F.col("mix_drawn"))
    return rows.withColumn("mix_places", places).drop("mix_source", "mix_plan", "mix_cut", "mix_last", "mix_drawn")


def orders(seed: int = 17):
    """Where each copy stands in its shard: a hash of its own, by which the shard is shuffled."""
    return F.transform("mix_places", lambda _, i: F.xxhash64(F.lit(seed), F.col("mix_key"), i + 1))


def draw(mixed: DataFrame, columns: list[str], seed: int = 17) -> DataFrame:
    """The documents of the mix: a row for each copy, dealt to its shard and shuffled there by a hash."""
    copy = F.explode(F.arrays_zip(F.col("mix_places").alias("shard"), orders(seed).alias("order"))).alias("mix_copy")
    rows = mixed.select("*", copy).withColumns({"mix_shard": F.col("mix_copy.shard"), "mix_order": F.col("mix_copy.order")})
    dealt = rows.repartition("mix_shard", F.pmod("mix_order", F.lit(16))).sortWithinPartitions("mix_shard", "mix_order")
    return dealt.select(*columns)
