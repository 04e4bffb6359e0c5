"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct shingles of `words` words (fewer words: the whole sequence). Every set has a signature of HASHES
least hashes. Bands of ROWS of them, each column in two bands, make candidates: two sets of similarity 0.8 meet in none of the
bands with a probability of about 1e-5. The signatures of a candidate are compared in batches of BATCH hashes; after each
batch the pair goes if, from a uniform prior, the posterior probability that its similarity reaches the threshold is below
`miss`. What is left is verified on the full sets, over 64-bit hashes of shingles, so no false link stays.

Equal sets are one node. In the first rounds the nodes of a bucket (a band's value) are compared with LEADERS of them, drawn by
hash alike in all buckets, so a group of near copies costs in proportion to its size. Buckets whose nodes lie in one component
are done; in those still open after that, all nodes outside the largest component are compared with every other, in blocks of
bounded members and bytes, which are dealt over tasks. No candidate is capped or dropped but by the posterior bound.

Cases: null, empty and blank texts have empty sets, are linked with nothing and are their own component. Repeated rows are
one node, as are all texts with one set. A null doc_id takes part; a component's id is its least doc_id that isn't null, or null. A
document is kept if its doc_id is its component's id: of rows that repeat that id each one is, and where all ids are null, all are.
An empty table gives an empty result. Very long texts have as many shingles as words. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, bits_of, drop_spool, holds, mix, spool, text_chunks, tidy, words_of
from .graph import components

WORDS = 4
NUMERATOR, DENOMINATOR = 80, 100
HASHES, ROWS, BATCH = 256, 8, 32
#: Chance, after any batch, that a pair that is dropped reaches the threshold.
MISS = 1e-6
LEADERS, ROUNDS = 2, 2
#: Most members of a block, and most shingles in it on the average.
BLOCK, BLOCK_SHINGLES = 1_024, 2_000_000
#: Bits of the filters of buckets and of texts, for each row that they hold, and at most.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 27

_FACTOR = np.random.default_rng(31).integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_HASH = np.random.default_rng(32).integers(0, 2**64, HASHES, np.uint64) | np.uint64(1)
_BANDS = np.concatenate([np.random.default_rng(33 + k).permutation(HASHES).reshape(-1, ROWS) for k in range(2)])


def shingle_sets(raw: np.ndarray, at: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text raw[at[i]:at[i+1]]."""
    doc, _, _, hashed = words_of(raw, at)
    first = np.searchsorted(doc, np.arange(len(at)))
    value = np.zeros(max(0, len(doc) - words + 1), np.uint64)
    for k in range(words):
        value += hashed[k : k + len(value)] * _FACTOR[k]
    value = mix(value)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(value[a : b - words + 1]))
        elif b > a:
            out.append(mix((hashed[a:b] * _FACTOR[: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64) * M1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of HASHES 16-bit values for each set, none of them empty."""
    flat, cuts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), HASHES), np.uint16)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((flat * _HASH[k]) >> np.uint64(24), cuts).astype(np.uint16)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """The buckets of each signature, one for each band."""
    out = np.empty((len(signature), len(_BANDS)), np.uint64)
    for k, columns in enumerate(_BANDS):
        key = np.full(len(signature), k + 1, np.uint64) * M1
        for pair in np.ascontiguousarray(signature[:, columns]).view(np.uint64).T:
            key = mix(key ^ pair)
        out[:, k] = key
    return out


def least_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """For each number n of compared hashes the fewest matches with which a pair goes on.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1), which reaches the threshold with the
    probability that n + 1 throws of chance `threshold` succeed at most m times.
    """
    out = np.zeros(HASHES + 1, np.int64)
    for n in range(HASHES + 1):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                out[n] = m
                break
    return out


def goes_on(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The places of the pairs (row of x, or its only row, and row of y) that no batch has dropped."""
    at = np.arange(len(y))
    matched = np.zeros(len(y), np.int64)
    for lo in range(0, HASHES, BATCH):
        left = x[at, lo : lo + BATCH] if len(x) == len(y) else x[:, lo : lo + BATCH]
        matched = matched + (left == y[at, lo : lo + BATCH]).sum(1)
        keep = matched >= least[lo + BATCH]
        at, matched = at[keep], matched[keep]
        if not len(at):
            break
    return at


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * DENOMINATOR < max(len(a), len(b)) * NUMERATOR:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * DENOMINATOR >= (len(a) + len(b) - common) * NUMERATOR


def _fixed(rows: np.ndarray):
    """An Arrow binary array with a value for each row of a matrix."""
    import pyarrow as pa

    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())


def _matrix(column, kind=np.uint16, width: int = HASHES) -> np.ndarray:
    from .common import column_bytes

    return column_bytes(column)[0].view(kind).reshape(-1, width)


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums of each set: its name."""
    s1 = [x.sum(dtype=np.uint64) for x in sets]
    s2 = [mix(x * M2).sum(dtype=np.uint64) + np.uint64(len(x)) * M1 for x in sets]
    return np.array([s1, s2], np.uint64).T.reshape(-1, 2)


def _survey(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, n of every text; node, signature where its set isn't empty."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, _, raw, at in text_chunks(batch.column(2)):
                with np.errstate(over="ignore"):
                    sets = shingle_sets(raw, at, words)
                    held = [i for i, x in enumerate(sets) if len(x)]
                    some = [sets[i] for i in held]
                    place = np.full(len(sets), -1)
                    place[held] = np.arange(len(held))
                    place = pa.array(place, mask=place < 0)
                    node = _fixed(_digests(some)) if held else pa.array([], pa.binary())
                    signature = _fixed(signatures(some)) if held else pa.array([], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sets)), batch.column(1).slice(lo, len(sets)), pa.array([len(x) for x in sets], pa.int64()), node.take(place), signature.take(place)], ["doc_id", "text_key", "n", "node", "signature"])

    return docs.mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, n long, node binary, signature binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """bucket, node: a row for each band of a node."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                part = batch.slice(lo, 2_000)
                with np.errstate(over="ignore"):
                    keys = band_keys(_matrix(part.column(1)))
                rows = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), part.column(0).take(rows)], ["bucket", "node"])

    return nodes.select("node", "signature").mapInArrow(tidy(run), "bucket long, node binary")


def _filter_bits(n: int) -> int:
    bits = 1 << 20
    while bits < min(MOST_FILTER_BITS, FILTER_BITS * n):
        bits *= 2
    return bits


def _only(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose long `column` is in wanted, and few others: a filter of bounded size tells them before any shuffle."""
    bits = _filter_bits(wanted.count())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    return df.filter(holds(place(column), bits_of(wanted.select(place(column).alias("place")), bits), df.sparkSession))


def _shared(nodes: DataFrame) -> DataFrame:
    """bucket, node of the buckets that hold several nodes."""
    bands = _bands(nodes)
    several = spool(bands.groupBy("bucket").count().filter("count > 1").select("bucket"), "several")
    shared = spool(_only(bands, "bucket", several).join(several, "bucket", "left_semi"), "shared")
    drop_spool(several)
    return shared


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, n, signature, members (the set) of the wanted nodes, made again from one text of each."""
    some = spool(nodes.join(wanted, "node", "left_semi"), "some")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for _, _, raw, at in text_chunks(batch.column(0)):
                with np.errstate(over="ignore"):
                    sets = [x for x in shingle_sets(raw, at, words) if len(x)]
                    if not sets:
                        continue
                    node = _fixed(_digests(sets))
                cuts = np.cumsum([0, *[8 * len(x) for x in sets]])
                members = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sets), [None, pa.py_buffer(cuts), pa.py_buffer(np.concatenate(sets))])
                yield pa.RecordBatch.from_arrays([node, members.cast(pa.binary())], ["made", "members"])

    made = _only(docs, "text_key", some.select("text_key")).select("text").mapInArrow(tidy(run), "made binary, members binary")
    one = made.groupBy("made").agg(F.first("members").alias("members"))  # of many copies a task sends one
    sets = spool(some.select("node", "n", "signature").join(one, F.col("node") == F.col("made")).drop("made"), "sets")
    drop_spool(some)
    return sets


def _open(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """bucket, node, component of the buckets whose nodes lie in several components."""
    placed = shared.withColumn("component", F.col("node"))
    if labels is not None:
        placed = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    return placed.join(several.select("bucket"), "bucket", "left_semi").select("bucket", "node", "component")


def _with_leaders(open_: DataFrame, round_: int) -> DataFrame:
    """a, b: the nodes of each bucket with its leaders of other components; a bucket has LEADERS at most in a round."""
    lot = F.pmod(F.xxhash64(F.lit(-round_), "node"), F.lit(LEADERS))
    drawn = F.min_by(F.struct("node", "component"), F.xxhash64(F.lit(round_), "node"))
    leaders = open_.groupBy("bucket", lot.alias("lot")).agg(drawn.alias("leader")).select("bucket", "leader")
    met = open_.join(leaders, "bucket").filter(F.col("component") != F.col("leader.component"))
    return met.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()


def _verified(sets: DataFrame, pairs: DataFrame, least: np.ndarray) -> DataFrame:
    """a, b of the pairs that pass the signature batches and link on their full sets."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, y = _matrix(batch.column(2)), _matrix(batch.column(4))
            found = [i for i in goes_on(x, y, least).tolist() if _linked(np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64), np.frombuffer(batch.column(5)[i].as_buffer(), np.uint64))]
            rows = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], ["a", "b"])

    side = lambda c: sets.select(F.col("node").alias(c), F.col("signature").alias(f"signature_{c}"), F.col("members").alias(f"members_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "signature_a", "members_a", "signature_b", "members_b")
    return both.mapInArrow(tidy(run), "a binary, b binary")


def _labels(links: DataFrame) -> DataFrame:
    """node, component: the least node within two links, which is enough between rounds."""
    both = links.union(links.select("b", "a")).toDF("node", "other")
    one = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label"))
    two = both.join(one.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("label"))
    return spool(two.select("node", F.least("node", "label").alias("component")), "labels")


def _cells(open_: DataFrame) -> DataFrame:
    """open_ with i, j, own: the pairs of blocks that a node takes part in, and its block.

    Blocks below gx hold the nodes outside the bucket's largest component, those from gx on that component, which is never compared with itself.
    """
    each = open_.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    whole = each.groupBy("bucket").agg(F.max_by(F.struct("component", "c", "w"), F.struct("c", "component")).alias("major"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    blocks = lambda c, w: F.greatest(F.ceil(c / BLOCK), F.ceil(w / BLOCK_SHINGLES), F.lit(1)).cast("int")
    whole = whole.select("bucket", F.col("major.component").alias("major"), blocks(F.col("c") - F.col("major.c"), F.col("w") - F.col("major.w")).alias("gx"), blocks(F.col("major.c"), F.col("major.w")).alias("gy"))
    rows = open_.join(whole, "bucket").withColumn("in_major", F.col("component") == F.col("major"))
    rows = rows.withColumn("own", F.when(F.col("in_major"), F.col("gx") + F.pmod(F.xxhash64("node"), F.col("gy"))).otherwise(F.pmod(F.xxhash64("node"), F.col("gx"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    own, gx = F.col("own"), F.col("gx")
    with_major = F.transform(upto(F.col("gy")), lambda j: cell(own, gx + j))
    others = F.transform(upto(gx), lambda i: cell(F.least(i, own), F.greatest(i, own)))
    at = F.when(F.col("in_major"), F.transform(upto(gx), lambda i: cell(i, own))).otherwise(F.concat(with_major, others))
    return rows.select("bucket", "node", "component", "own", F.explode(at).alias("cell")).select("bucket", "cell.i", "cell.j", "own", "component", "node")


def _between_blocks(sets: DataFrame, cells: DataFrame, least: np.ndarray) -> DataFrame:
    """a, b: links that join components, found within each pair of blocks."""

    def run(table):
        import pyarrow as pa

        table = table.combine_chunks()
        own, at_i, at_j = (table.column(k).to_numpy() for k in ("own", "i", "j"))
        signature = _matrix(table.column("signature"))
        size = table.column("n").to_numpy()
        _, component = np.unique(np.array(table.column("component").to_pylist(), object), return_inverse=True)
        members = table.column("members").chunk(0) if table.num_rows else None
        one, other = np.flatnonzero(own == at_i), np.flatnonzero(own == at_j)
        same, found = at_i[0] == at_j[0], []
        for k, x in enumerate(one.tolist()):
            y = one[k + 1 :] if same else other
            near = np.minimum(size[y], size[x]) * DENOMINATOR >= np.maximum(size[y], size[x]) * NUMERATOR
            y = y[near & (component[y] != component[x])]
            for p in y[goes_on(signature[x : x + 1], signature[y], least)].tolist():
                if component[p] != component[x] and _linked(np.frombuffer(members[x].as_buffer(), np.uint64), np.frombuffer(members[p].as_buffer(), np.uint64)):
                    found.append((x, p))
                    component[component == component[p]] = component[x]
        nodes = table.column("node").chunk(0)
        return pa.table({"a": nodes.take(pa.array([x for x, _ in found], pa.int64())), "b": nodes.take(pa.array([p for _, p in found], pa.int64()))})

    rows = cells.join(sets, "node").select("bucket", "i", "j", "own", "component", "node", "n", "signature", "members")
    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary")


def classes(docs: DataFrame, words: int = WORDS, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every text."""
    text = F.col("text").cast("string")
    docs = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    survey = spool(_survey(docs, words), "survey")
    some = survey.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.min("text_key").alias("text_key"), F.first("signature").alias("signature"))
    nodes = spool(some, "nodes")
    shared = _shared(nodes)
    sets = _sets(docs, nodes, shared.select("node").distinct(), words)
    least = least_matches(NUMERATOR / DENOMINATOR, miss)
    links, labels = [], None
    for k in range(1, ROUNDS + 1):
        pairs = spool(_with_leaders(_open(shared, labels), k), "pairs")
        links.append(spool(_verified(sets, pairs, least), "links"))
        drop_spool(pairs, *([labels] if labels else []))
        linked = reduce(DataFrame.union, links)
        labels = _labels(linked)
    grouped = spool(components(linked), "components")
    open_ = _open(shared, grouped).join(sets.select("node", "n"), "node")
    cells = spool(_cells(open_), "cells")
    links.append(spool(_between_blocks(sets, cells, least), "links"))
    drop_spool(cells, sets, labels, grouped)
    grouped = components(linked.union(links[-1])).withColumnRenamed("node", "member")
    placed = spool(nodes.select("node", "least_id").join(grouped, F.col("node") == F.col("member"), "left").select("node", "least_id", F.coalesce("component", "node").alias("component")), "placed")
    drop_spool(shared)
    ids = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = placed.join(ids, "component").select("node", "component_id")
    found = survey.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    component_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component_id.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
