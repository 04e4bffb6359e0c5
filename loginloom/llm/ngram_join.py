"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes, and its components.

A document's set holds its distinct shingles of five words (fewer words: the whole sequence). Shingles are ordered rare
first, by an estimate of their document frequency over all texts, ties by hash. Two sets that link share at least L of the
first |x| - ceil(t|x|) + L shingles of each, for every L. Each document chooses its L by the estimated cost of its candidates:
a longer prefix meets more postings, but more shared shingles are then required before a pair is verified; a pair is held
to the smaller L of its two documents.

For a pair both prefixes are cut to what just their two sizes need: of sets of n and m that share at least o shingles, L
common ones lie in the first n - o + L and m - o + L. Near copies with edits enough to miss the bound begin with rare shingles
that nothing shares, so they hardly meet.

Each set has a sketch, the parities of how many shingles fall into each of its cells. Two sets differ by at least as many
shingles as parities, so a pair whose sketches differ by more than a link allows is passed over: where postings meet by 512
cells, and of the pairs that are left by two cells or more for each shingle. No link is lost by that, and the sets of hardly any
pair but those that link, or nearly so, are made.

Documents with equal sets are one node. Candidates come in rounds, so that a group of near copies costs in proportion
to its size: in the first ones a document is verified against the representatives of its postings (a few drawn by hash) that it
meets most often, where these lie in another component; in the last, between documents that are not yet in one component,
every pair of the prefix filter. No link between components is lost, and links within one change nothing. The sets of
candidates are made again from the texts in each round, from the documents that a bit filter lets through; the intersection is
exact over 64-bit hashes of the shingles.

Cases: null, empty and blank texts have empty sets, are linked with nothing and are their own component. Repeated rows are
one node; so are different texts of one doc_id. A document with a null doc_id takes part, known by a hash of its text; a
component's id is the least doc_id that is not null, or null if there is none. Very long texts have as many shingles as
words. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import M1, M2, bits_of, drop_spool, holds, mix, spool, text_chunks, tidy, words_of
from .graph import components

WORDS = 5
#: Share of the union that two linked sets have in common, as a fraction.
NUMERATOR, DENOMINATOR = 80, 100
#: Most shared shingles that a document asks for.
LONGEST = 3
#: Representatives of one posting in the first round and at most; a round has four times those of the one before, and as a
#: document is verified against some of those that it meets, twice as many in each round.
REPRESENTATIVES, MOST_REPRESENTATIVES, TRIED = 4, 64, 2
#: Rounds of representatives, which end early where no more than this share of the pairs that one verifies link.
ROUNDS, WORTH = 3, 0.02
#: Counters of the frequency estimate for each million documents, and at most; filters have eight bits for each of them. The
#: blocks in which both are summed.
CELLS, MOST_CELLS, BLOCKS = 1 << 20, 1 << 24, 64
#: Cells of the least sketch, a power of two, and its words, which postings carry in the last round.
SKETCH = 512
PARITIES = [f"p{k}" for k in range(SKETCH // 64)]
#: Bits of the filter of documents to verify.
NODE_BITS = 1 << 23

_FACTOR = np.random.default_rng(21).integers(0, 2**64, WORDS, np.uint64) | np.uint64(1)


def shingles(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    doc, _, _, hashed = words_of(raw, at)
    n_docs = len(at) - 1
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    value = np.zeros(max(0, len(doc) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        value += hashed[k : k + len(value)] * _FACTOR[k]
    value = mix(value)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(value[a : b - WORDS + 1]))
        elif b > a:
            short = (hashed[a:b] * _FACTOR[: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64) * M1
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Words of the parities of a set: a power of two of cells, at least SKETCH and two for each shingle."""
    cells = max(SKETCH, 1 << (2 * len(tokens) - 1).bit_length())
    cell = (tokens >> np.uint64(32)) & np.uint64(cells - 1)
    out = np.zeros(cells // 64, np.uint64)
    np.bitwise_xor.at(out, (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
    return out


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set with `size` words."""
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _blocks(array: np.ndarray):
    import pyarrow as pa
    import zlib

    parts = np.split(array, BLOCKS)
    kept = [i for i, p in enumerate(parts) if p.any()]
    n = len(kept)
    return {"block": pa.array(kept, pa.int32()), "data": pa.array([zlib.compress(parts[i].tobytes(), 1) for i in kept], pa.binary())}, n


def _merged(rows: DataFrame, dtype, size: int, add: bool) -> np.ndarray:
    """The block rows of all tasks, merged block by block on the executors; `size` values reach the driver."""
    import zlib

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(data), dtype)
                if block not in sums:
                    sums[block] = x.copy()
                elif add:
                    sums[block] += x
                else:
                    sums[block] |= x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], ["block", "data"])

    out = np.zeros(size, dtype).reshape(BLOCKS, -1)
    for r in rows.repartition(BLOCKS // 4, "block").mapInArrow(tidy(run), "block int, data binary").collect():
        out[r.block] = np.frombuffer(zlib.decompress(r.data), dtype)
    return out.reshape(-1)


def _cells(docs: DataFrame) -> int:
    """Counters of the frequency estimate: a power of two that grows with the documents, to 64 MB."""
    cells, millions = CELLS, docs.count() / 1_000_000
    while cells < min(MOST_CELLS, CELLS * millions):
        cells *= 2
    return cells


def _survey(docs: DataFrame, n_cells: int) -> DataFrame:
    """A row for each text: doc_id, key, n (set size), s1 and s2 (the set's 128-bit sum); and each task's frequency blocks."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cells = np.zeros(n_cells, np.uint32)
        names = ["doc_id", "key", "n", "s1", "s2", "block", "data"]
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for lo, hi, raw, at in text_chunks(batch.column(2)):
                sets = shingles(raw, at)
                n = hi - lo
                every = np.concatenate(sets)
                cells += np.bincount((every & np.uint64(n_cells - 1)).astype(np.int64), minlength=n_cells).astype(np.uint32)
                s1 = np.array([x.sum(dtype=np.uint64) for x in sets]).view(np.int64)
                s2 = np.array([mix(x * M2).sum(dtype=np.uint64) for x in sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array([len(x) for x in sets], pa.int64()), pa.array(s1), pa.array(s2), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        blocks, n = _blocks(cells)
        if n:
            yield pa.RecordBatch.from_arrays([pa.nulls(n, id_type), *[pa.nulls(n, pa.int64())] * 4, blocks["block"], blocks["data"]], names)

    return docs.mapInArrow(tidy(run), f"doc_id {kind}, key long, n long, s1 long, s2 long, block int, data binary")


def prefix(tokens: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of a sorted set, rare first, and how many of its shingles a partner must share.

    frequency: the estimate for each token of how many other documents hold it. The cost of L is that of reading the
    prefix's postings and of verifying the candidates that may be met L times, at most the postings divided by L.
    """
    n = len(tokens)
    need = -(-NUMERATOR * n // DENOMINATOR)
    base = n - need + 1
    longest = min(LONGEST, need)
    rank = np.frexp(frequency)[1].astype(np.uint64)  # powers of two
    key = (rank << np.uint64(58)) | (mix(tokens) >> np.uint64(6))
    most = base + longest - 1
    some = np.argpartition(key, most - 1)[:most] if most < n else np.arange(n)
    some = some[np.argsort(key[some], kind="stable")]
    posts = np.cumsum(frequency[some])
    levels = np.arange(1, longest + 1)
    reached = posts[base - 1 : base - 1 + longest]
    cost = reached + levels + n * reached / levels / 16
    level = int(np.argmin(cost)) + 1
    return tokens[some[: base + level - 1]], level


def _prefixes(docs: DataFrame, cells: np.ndarray) -> DataFrame:
    """key, n, level, tokens, sketch of every text with a set."""
    # what other shingles add to a cell is taken off, with a margin for its spread
    mean = float(cells.mean())
    load = np.maximum(0.0, cells - 1 - mean - 4 * np.sqrt(mean) * (mean > 0.5)).astype(np.float32)
    given = docs.sparkSession.sparkContext.broadcast(load)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        load = given.value
        for batch in batches:
            for lo, _, raw, at in text_chunks(batch.column(1)):
                rows = []
                for i, x in enumerate(shingles(raw, at), lo):
                    if len(x):
                        tokens, level = prefix(x, load[(x & np.uint64(len(load) - 1)).astype(np.int64)].astype(np.float64))
                        rows.append((i, len(x), level, tokens.view(np.int64), sketch(x).tobytes()))
                if rows:
                    at_row, n, level, tokens, parities = zip(*rows)
                    flat = pa.array(np.concatenate(tokens))
                    cuts = pa.array(np.cumsum([0, *map(len, tokens)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at_row)), pa.array(n, pa.int64()), pa.array(level, pa.int32()), pa.ListArray.from_arrays(cuts, flat), pa.array(parities, pa.binary())], ["key", "n", "level", "tokens", "sketch"])

    return docs.select("key", "text").mapInArrow(tidy(run), "key long, n long, level int, tokens array<long>, sketch binary")


def _postings(prefixes: DataFrame, several: DataFrame, bits: int) -> DataFrame:
    """token, node, n, level, place of the prefixes' tokens that several hold, and of few others, told by a filter of `bits` bits."""

    def mark(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[(mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)] = True
        blocks, n = _blocks(np.packbits(seen))
        if n:
            yield pa.RecordBatch.from_arrays([blocks["block"], blocks["data"]], ["block", "data"])

    packed = _merged(several.select("token").coalesce(BLOCKS).mapInArrow(tidy(mark), "block int, data binary"), np.uint8, bits // 8, False)
    given = prefixes.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        mask = given.value
        for batch in batches:
            tokens = batch.column(3)
            count = np.diff(tokens.offsets.to_numpy())
            flat = tokens.flatten().to_numpy(zero_copy_only=False)
            at = (mix(flat.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
            hit = np.flatnonzero(mask[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            owner = np.repeat(np.arange(len(count)), count)[hit]
            place = hit - (np.cumsum(count) - count)[owner]
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(flat[hit]), *(batch.column(k).take(rows) for k in range(3)), pa.array(place.astype(np.int32))], ["token", "node", "n", "level", "place"])

    return prefixes.select("node", "n", "level", "tokens").mapInArrow(tidy(run), "token long, node long, n long, level int, place int")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, members: the sets of the documents in nodes (a long column `node`), and of few others."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(NODE_BITS))
    filled = bits_of(nodes.select(place("node").alias("place")), NODE_BITS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a, b, raw, at in text_chunks(batch.column(1)):
                sets = shingles(raw, at)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                cuts = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(cuts, flat)], ["node", "members"])

    return docs.filter(holds(place("key"), filled, docs.sparkSession)).select("key", "text").mapInArrow(tidy(run), "node long, members array<long>")


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b of the pairs, and `alike`: whether their sketches differ by no more parities than linked sets of their sizes do."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = size - 2 * -(-size * NUMERATOR // (NUMERATOR + DENOMINATOR))
            alike = np.zeros(batch.num_rows, bool)
            for i, (of_a, of_b) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (of_a, of_b))
                words = min(len(x), len(y))
                alike[i] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(dtype=np.int64) <= most[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike)], ["a", "b", "alike"])

    side = lambda c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    return both.mapInArrow(tidy(run), "a long, b long, alike boolean")


def _links(docs: DataFrame, pairs: DataFrame, sketches: DataFrame) -> tuple[DataFrame, int, int]:
    """The pairs (a, b) whose sets link, how many they are, and how many were given."""
    tried = spool(_likely(pairs, sketches), "tried")
    n_tried = tried.count()
    pairs = tried.filter("alike").select("a", "b")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    sets = spool(_sets(docs, nodes).join(nodes, "node", "left_semi"), "sets")
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("of_b")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("members").alias("of_a")), "a")
    common = F.size(F.array_intersect("of_a", "of_b"))
    linked = spool(both.filter(common * DENOMINATOR >= (F.size("of_a") + F.size("of_b") - common) * NUMERATOR).select("a", "b"), "links")
    n_linked = linked.count()
    drop_spool(tried, sets)
    return linked, n_linked, n_tried


def _near(n, m):
    """Sizes that a link allows."""
    return (F.least(n, m) * DENOMINATOR) >= (F.greatest(n, m) * NUMERATOR)


def _overlap(n, m):
    """Shingles that linked sets of n and m share, at least."""
    return F.ceil((n + m) * NUMERATOR / (NUMERATOR + DENOMINATOR))


#: Sizes of one band differ by less than this factor; linked sets lie at most REACH bands apart.
BAND, REACH = 1.05, 5


def _band(n):
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(BAND)) + 1e-9).cast("int")


def _least_of_band(band, n):
    """The least size in a band that a set of n can link with."""
    return F.greatest(F.floor(F.pow(F.lit(BAND), band) - 1e-6), F.floor(n * NUMERATOR / DENOMINATOR))


def _possible(open_: DataFrame) -> DataFrame:
    """node, band, to_band, least: where a document has postings enough for a link with some size of that band.

    A document's matches with one partner are at most its postings that lie in its prefix for that band and hold another
    component there; a link needs as many as the smaller level of the two.
    """
    bands = open_.groupBy("token", "band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("level").alias("least"))
    bands = bands.groupBy("token").agg(F.collect_list(F.struct("band", "lo", "hi", "least")).alias("bands"))  # a few hundred bands at most
    near = F.filter("bands", lambda b: (F.abs(b["band"] - F.col("band")) <= REACH) & ((b["lo"] != F.col("component")) | (b["hi"] != F.col("component"))))
    rows = open_.join(bands, "token").select("node", "band", "n", "level", "place", F.explode(near).alias("b"))
    within = F.col("place") < F.col("n") - _overlap(F.col("n"), _least_of_band(F.col("b.band"), F.col("n"))) + F.col("level")
    rows = rows.filter(within).groupBy("node", "band", "level", F.col("b.band").alias("to_band")).agg(F.count("*").alias("postings"), F.min("b.least").alias("least"))
    return rows.filter(F.col("postings") >= F.least("level", "least")).select("node", "band", "to_band")


def _still_open(posts: DataFrame, grouped: DataFrame | None) -> DataFrame:
    """The postings that hold documents of several components, with `component` and the posting's `major` one."""
    placed = posts.withColumn("component", F.col("node"))
    if grouped is not None:
        placed = posts.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counted = placed.groupBy("token", "component").count().groupBy("token").agg(F.count("*").alias("n_components"), F.max_by("component", "count").alias("major"))
    return placed.join(counted.filter("n_components > 1").select("token", "major"), "token")


def _labels(links: DataFrame) -> DataFrame:
    """node, component: the least node within two links; for the next round that is enough, and costs far less than components."""
    both = links.union(links.select("b", "a")).toDF("node", "other")
    one = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label"))
    two = both.join(one.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("label"))
    return spool(two.select("node", F.least("node", "label").alias("component")), "labels")


def _met(x_place, x_n, y_place, y_n, level):
    """Whether a posting lies in the prefixes of two sets whose sizes allow a link: prefixes for just these sizes and this level."""
    beyond = level - _overlap(x_n, y_n)
    return _near(x_n, y_n) & (x_place < x_n + beyond) & (y_place < y_n + beyond)


def _with_representatives(open_: DataFrame, round_: int) -> DataFrame:
    """a, b: each document with those representatives of its postings, of other components, that it meets most often.

    A posting has a bounded number of representatives in a round, chosen by hash, so the rows are in proportion to the postings. The
    documents of a posting's largest component only wait for those of the others.
    """
    drawn = F.xxhash64(F.lit(round_), "node")  # alike for all postings, so that a document meets one representative often
    lots = min(MOST_REPRESENTATIVES, REPRESENTATIVES * 4 ** (round_ - 1))
    lot = F.pmod(F.xxhash64(F.lit(-round_), "node"), F.lit(lots))
    chosen = open_.groupBy("token", lot.alias("lot")).agg(F.min_by(F.struct("node", "n", "place", "component"), drawn).alias("r")).drop("lot")
    meets = (F.col("component") != F.col("r.component")) & _met(F.col("place"), F.col("n"), F.col("r.place"), F.col("r.n"), F.lit(1))
    counts = open_.filter("component <> major").join(chosen, "token").filter(meets).groupBy("node", F.col("r.node").alias("other")).agg(F.count("*").alias("common"))
    most = Window.partitionBy("node").orderBy(F.desc("common"), F.xxhash64("other"))  # the representatives of a prefix at most
    best = counts.withColumn("nth", F.row_number().over(most)).filter(F.col("nth") <= TRIED * 2 ** (round_ - 1))
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _short(sketches: DataFrame) -> DataFrame:
    """node and the words of its sketch folded to SKETCH cells."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            words = [folded(np.frombuffer(x.as_buffer(), np.uint64), len(PARITIES)) for x in batch.column(1)]
            columns = np.array(words, np.uint64).reshape(-1, len(PARITIES)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns)], ["node", *PARITIES])

    return sketches.select("node", "sketch").mapInArrow(tidy(run), "node long, " + ", ".join(f"{p} long" for p in PARITIES))


def _all_pairs(open_: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b: every pair of the prefix filter between documents of different components; and a table to drop afterwards."""
    open_ = open_.withColumn("band", _band(F.col("n")))
    may = spool(_possible(open_).join(_short(sketches), "node"), "possible")
    sides = open_.join(may, ["node", "band"])
    sides = sides.filter(F.col("place") < F.col("n") - _overlap(F.col("n"), _least_of_band(F.col("to_band"), F.col("n"))) + F.col("level"))
    columns = ("node", "n", "level", "place", "component", "band", "to_band", *PARITIES)
    x = sides.filter("component <> major").select("token", *[F.col(c).alias(f"x_{c}") for c in columns])
    y = sides.select(F.col("token").alias("y_token"), "major", *[F.col(c).alias(f"y_{c}") for c in columns])
    level = F.least("x_level", "y_level")
    once = (F.col("y_component") == F.col("major")) | (F.col("x_node") < F.col("y_node"))
    place = [F.col(c) for c in ("x_place", "x_n", "y_place", "y_n")]
    unlike = reduce(add, [F.bit_count(F.col(f"x_{p}").bitwiseXOR(F.col(f"y_{p}"))) for p in PARITIES])
    alike = unlike <= F.col("x_n") + F.col("y_n") - 2 * _overlap(F.col("x_n"), F.col("y_n"))
    meets = (F.col("x_component") != F.col("y_component")) & once & _met(*place, level) & alike
    same = (F.col("token") == F.col("y_token")) & (F.col("x_to_band") == F.col("y_band")) & (F.col("y_to_band") == F.col("x_band"))
    pairs = x.join(y, same & meets).groupBy(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"), level.alias("level")).agg(F.count("*").alias("common"), F.max(_met(*place, F.lit(1))).alias("met"))
    return pairs.filter(F.col("met") & (F.col("common") >= F.col("level"))).select("a", "b"), may


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every text; n_shingles is the size of its set."""
    text = F.col("text").cast("string")
    # a document without a doc_id is known by its text
    docs = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("key"), text.alias("text"))
    cells = _cells(docs)
    survey = spool(_survey(docs, cells), "survey")
    rows = survey.filter("block IS NULL").select("doc_id", "key", "n", "s1", "s2")
    counts = _merged(survey.filter("block IS NOT NULL").select("block", "data"), np.uint32, cells, True)
    nodes = rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("key").alias("node"), F.min("doc_id").alias("least_id"))
    known = nodes.select("node").distinct()
    prefixes = spool(_prefixes(docs, counts).join(known, F.col("key") == F.col("node"), "left_semi").withColumnRenamed("key", "node"), "prefixes")
    several = spool(prefixes.select(F.explode("tokens").alias("token")).groupBy("token").count().filter("count > 1").select("token"), "several")
    posts = _postings(prefixes, several, 8 * cells)
    shared = spool(posts.join(several, "token", "left_semi"), "shared")
    sketches = spool(prefixes.select("node", "n", "sketch").join(shared.select("node").distinct(), "node", "left_semi"), "sketches")
    drop_spool(prefixes, several)
    linked = shared.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    labels, open_ = None, shared
    for k in range(1, ROUNDS + 1):
        after = spool(_still_open(open_.drop("component", "major"), labels), "open")
        drop_spool(open_)
        open_ = after
        found, n_found, n_tried = _links(docs, _with_representatives(open_, k), sketches)
        linked = linked.union(found)
        if n_found <= WORTH * n_tried or k == ROUNDS:
            break
        labels = _labels(linked)
    grouped = spool(components(linked), "components")
    after = spool(_still_open(open_.drop("component", "major"), grouped), "open")
    drop_spool(open_)
    pairs, may = _all_pairs(after, sketches)
    found, n_found, _ = _links(docs, pairs, sketches)
    drop_spool(after, may, sketches)
    member = grouped.select(F.col("node").alias("member"), "component")
    placed = nodes.join(member, F.col("node") == F.col("member"), "left").select("s1", "s2", "n", "least_id", F.coalesce("component", "node").alias("component"))
    if n_found:
        between = found
        for c in ("a", "b"):
            between = between.join(grouped.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left").withColumn(c, F.coalesce(f"of_{c}", c))
        tied = components(between.select("a", "b")).toDF("part", "whole")
        placed = placed.join(tied, F.col("component") == F.col("part"), "left").select("s1", "s2", "n", "least_id", F.coalesce("whole", "component").alias("component"))
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = placed.join(least, "component").select("s1", "s2", "n", "component_id")
    out = rows.filter("n > 0").join(named, ["s1", "s2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id")))
