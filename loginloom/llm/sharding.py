"""Resharding by minimum-cost flow: from old shard sizes to new capacities with the fewest bytes moved.

Rows with equal texts form a unit that stays together. A unit heavier than half a new shard is dealt into pieces by a hash
of doc_id, so that one hot text can't fill a shard. Units are hashed into blocks of their old shard. The driver sees only
sums: the old shards, their blocks, and the units above 1/512 of a shard, of which there are at most 512 a shard. It puts
those heavy units down first, then solves the flow for the rest; each flow takes a range of an old shard's bytes, which
maps to whole blocks and, where a range ends inside a block, to whole units.

Law `bytes`: shard sizes are near equal. Size of a row: UTF-8 bytes of the text (null: none) plus 1.

Cases: null texts are equal to each other; their checksum is null. Empty texts have size 1. Rows repeated with one doc_id
each get a slot. An empty table gives no rows. assign ignores other columns, rewrite carries them; a null source counts as
a source of its own.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_spool, spool, text_key

#: Blocks of one old shard.
BLOCKS = 256
#: Units above this share of a new shard are placed one by one.
HEAVY = 512
#: Parts of a shard that are numbered apart.
NUMBERED = 64


def solve_flow(supply: list[int], room: list[int], cost) -> dict[tuple[int, int], int]:
    """Minimum-cost flow from supplies to rooms (sums equal) by successive shortest paths; cost(i, j) is that of one byte.

    The graph has a node for each old and each new shard. Every path found carries as much as it can.
    """
    n, m = len(supply), len(room)
    left, free = list(supply), list(room)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    far = float("inf")
    while any(left):
        dist = [0.0 if x else far for x in left] + [far] * m
        back: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + cost(i, j) < dist[n + j]:
                        dist[n + j], back[n + j], changed = dist[i] + cost(i, j), i, True
                    if flow[i, j] and dist[n + j] - cost(i, j) < dist[i]:
                        dist[i], back[i], changed = dist[n + j] - cost(i, j), n + j, True
        end = min((j for j in range(m) if free[j]), key=lambda j: (dist[n + j], j))
        path, at = [], n + end
        while back[at] is not None:
            path.append((back[at], at))
            at = back[at]
        amount = min([left[at], free[end], *(flow[v, u - n] for u, v in path if u >= n)])
        for u, v in path:
            if u < n:
                flow[u, v - n] += amount
            else:
                flow[v, u - n] -= amount
        left[at] -= amount
        free[end] -= amount
    return {k: v for k, v in flow.items() if v}


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def assign(docs: DataFrame, shards: int = 16, old_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, source, text_hash, old_shard, shard, slot of every row, under the law `bytes`.

    A row's old shard is that of its source; new shards 0 to old_shards - 1 are the old ones, grown or shrunk. Bytes that
    stay cost nothing, bytes that move cost 1 each.
    """
    spark = docs.sparkSession
    text = F.col("text")
    slim = spool(
        docs.select(
            "doc_id",
            row_size(text).alias("size"),
            F.crc32(text).alias("text_crc32"),
            text_key(text).alias("text_key"),
            "source",
            F.pmod(F.xxhash64(F.coalesce("source", F.lit("\0"))), F.lit(old_shards)).cast("int").alias("old_shard"),
        ),
        "slim",
    )
    sums = slim.groupBy("text_key").agg(F.sum("size").alias("bytes"))
    total = slim.agg(F.sum("size")).first()[0] or 0
    capacity = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    # fewer than 2 * shards texts are heavier than half a shard
    hot = [(r.text_key, -(-2 * r.bytes * shards // total)) for r in sums.filter(F.col("bytes") * 2 * shards > total).select("text_key", "bytes").collect()] if total else []
    piece = F.lit(0)
    for key, k in hot:
        piece = F.when(F.col("text_key") == key, F.pmod(F.xxhash64("doc_id"), F.lit(k)).cast("int")).otherwise(piece)
    slim = slim.withColumn("piece", piece)
    # a unit's home is the old shard that holds most of its bytes
    held = slim.groupBy("text_key", "piece", "old_shard").agg(F.sum("size").alias("held"))
    units = held.groupBy("text_key", "piece").agg(F.sum("held").alias("bytes"), F.max_by("old_shard", F.struct("held", -F.col("old_shard"))).alias("home")).withColumn("block", F.pmod(F.xxhash64("text_key", "piece"), F.lit(BLOCKS)).cast("int"))
    units = spool(units, "units")
    is_heavy = F.col("bytes") * shards * HEAVY > total
    free = list(capacity)
    heavy = []
    for r in sorted(units.filter(is_heavy).collect(), key=lambda r: (-r.bytes, r.text_key, r.piece)):
        fits = r.home < shards and free[r.home] >= r.bytes
        to = r.home if fits else max(range(shards), key=lambda j: (free[j], -j))
        free[to] -= r.bytes
        heavy.append((r.text_key, r.piece, to))
    light = units.filter(~is_heavy)
    blocks = {(r.home, r.block): r.bytes for r in light.groupBy("home", "block").agg(F.sum("bytes").alias("bytes")).collect()}
    supply = [sum(blocks.get((i, b), 0) for b in range(BLOCKS)) for i in range(old_shards)]
    room, over = [max(0, x) for x in free], -sum(min(0, x) for x in free)
    while over:  # a heavy unit may have filled a shard beyond its capacity; the others give way
        j = max(range(shards), key=lambda j: room[j])
        cut = max(1, min(over, room[j] // 2))
        room[j] -= cut
        over -= cut
    flow = solve_flow(supply, room, lambda i, j: int(i != j))
    starts, at = [], 0
    for i in range(old_shards):
        at = 0
        for b in range(BLOCKS):
            if (i, b) in blocks:
                starts.append((i, b, at))
                at += blocks[i, b]
    target = F.lit(None).cast("int")
    for i in range(old_shards):
        inside, to = F.lit(None).cast("int"), at
        ends = []
        reach = 0
        for j in range(shards):
            if flow.get((i, j)):
                reach += flow[i, j]
                ends.append((reach, j))
        for k, (reach, j) in reversed(list(enumerate(ends))):
            inside = F.lit(j) if k == len(ends) - 1 else F.when(F.col("middle") < reach, F.lit(j)).otherwise(inside)
        target = F.when(F.col("home") == i, inside).otherwise(target)
    start = spark.createDataFrame(starts or [(0, 0, 0)], "home int, block int, start long")
    inner = Window.partitionBy("home", "block").orderBy("text_key", "piece").rowsBetween(Window.unboundedPreceding, 0)
    light = light.withColumn("upto", F.sum("bytes").over(inner)).join(F.broadcast(start), ["home", "block"]).withColumn("middle", F.col("start") + F.col("upto") - F.col("bytes") / 2)
    placed = light.select("text_key", "piece", target.alias("shard"))
    if heavy:
        placed = placed.unionByName(spark.createDataFrame(heavy, "text_key string, piece int, shard int"))
    rows = spool(slim.join(placed, ["text_key", "piece"]).withColumn("text_hash", F.unhex(F.when(F.col("text_key") != "null", F.col("text_key")))).drop("text_key", "piece").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(NUMBERED)).cast("int")), "placed")
    counts = {(r.shard, r.part): r["count"] for r in rows.groupBy("shard", "part").count().collect()}  # shards * NUMBERED rows at most
    offsets = []
    for j in range(shards):
        at = 0
        for p in range(NUMBERED):
            offsets.append((j, p, at))
            at += counts.get((j, p), 0)
    offset = spark.createDataFrame(offsets, "shard int, part int, first long")
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return rows.join(F.broadcast(offset), ["shard", "part"]).select("doc_id", "size", "text_crc32", "source", "text_hash", "old_shard", "shard", (F.col("first") + F.row_number().over(order) - 1).alias("slot"))


def affected(placed: DataFrame) -> list[int]:
    """The shards, old or new, that lose or gain a row; at most as many values as there are shards."""
    moved = placed.filter("old_shard <> shard")
    return sorted(r[0] for r in moved.select(F.explode(F.array("old_shard", "shard"))).distinct().collect())


def rewrite(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Writes the files of the affected shards, each in its folder shard=N, rows in order of slot; returns those shards.

    placed is what assign made of docs. The files of the other shards stay as they are; the folder of a shard that has lost
    all of its rows goes. Columns `shard` and `slot` of docs, as after an earlier rewrite, give way to the new ones; docs may
    be read from path. Rows are met by doc_id, text and source, repeated ones by their number among equals; all rows of one
    doc_id and text go to one shard, so it doesn't matter which of them takes which slot.
    """
    shards = affected(placed)
    if not shards:
        return shards
    spark = docs.sparkSession
    keys = ["doc_id", "text_hash", "source"]
    carried = [c for c in docs.columns if c not in ("shard", "slot")]
    # a full order, so that a task that runs again numbers its rows alike
    whole = F.xxhash64(F.to_json(F.struct(*carried)))
    number = lambda keys, *by: F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    own = docs.select(F.struct(*carried).alias("row"), F.col("doc_id").alias("d_id"), F.unhex(F.sha2("text", 256)).alias("d_hash"), F.col("source").alias("d_source"), whole.alias("whole"))
    own = own.withColumn("d_number", number(["d_id", "d_hash", "d_source"], "whole"))
    to = placed.select(*keys, "shard", "slot").withColumn("number", number(keys, "shard", "slot")).filter(F.col("shard").isin(shards))
    same = F.col("doc_id").eqNullSafe(F.col("d_id")) & F.col("text_hash").eqNullSafe(F.col("d_hash")) & F.col("source").eqNullSafe(F.col("d_source")) & (F.col("number") == F.col("d_number"))
    rows = spool(own.join(to, same).select("row.*", "shard", "slot"), "rewritten")
    held = {r[0] for r in rows.select("shard").distinct().collect()}
    rows.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    drop_spool(rows)
    # dynamic overwriting leaves partitions without new rows alone
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for shard in set(shards) - held:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        folder.getFileSystem(conf).delete(folder, True)
    return shards
