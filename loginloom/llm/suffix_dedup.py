"""Exact substring dedup by suffix arrays over shards of the corpus.

A byte is removed if a string of SPAN bytes that covers it also starts earlier: at a smaller doc_id, or earlier in the same
document. Strings are judged on the input; matches never cross documents.

Equal strings must meet in one shard. So each string of SPAN bytes belongs to its least hashed GRAM-byte piece; runs of
strings with one such piece form a segment, and segments are dealt by that piece. Pieces that occur once in the corpus hold
no repeats and stop there. Segments with equal bytes are collapsed, before the shuffle and after, to the earliest one, so
that many copies cost as one. A shard's segments form one text whose suffix array is built by induced sorting; permuted
common prefixes of SPAN bytes or more chain equal strings; all but the earliest start of a chain are repeats. Segments of
one very frequent piece (a common passage in many surroundings) are cut into single strings and dealt by those.

Pieces and segments are told apart by 64-bit hashes (a segment by both, 128 bits); the suffix arrays compare bytes.

Cases: a null text counts as empty; texts shorter than SPAN bytes lose nothing. Rows repeated in full are one document and
share its spans; texts that share a doc_id are ordered by a hash of theirs. A null doc_id comes first. Repeats within one
document, also overlapping ones, keep their first start. Other columns pass through `remove`; names that begin with
dedup_ are its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_of, drop_spool, holds, mix, spool, text_chunks, tidy
from .induced import permuted_prefixes, suffix_array

SPAN, GRAM = 100, 48
#: Bits of the filter of repeated pieces and of that of cut documents.
BITS, TOUCHED = 1 << 26, 1 << 22
#: Bytes of a suffix array, and of one piece's segments before they are cut into single strings.
SHARD, HOT = 700_000, 2_000_000

_BYTE = np.random.default_rng(31).integers(0, 2**64, 256, np.uint64)
_STEP = np.random.default_rng(32).integers(0, 2**64, 8, np.uint64) | np.uint64(1)
_PLACE = np.random.default_rng(33).integers(0, 2**64, 1 << 16, np.uint64) | np.uint64(1)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each `width` neighbours."""
    n, low, wide = len(x) - width + 1, x, 1
    while 2 * wide <= width:
        low = pick(low[: len(low) - wide], low[wide:])
        wide *= 2
    return pick(low[:n], low[width - wide : width - wide + n])


def _hashed(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece hash from each place, the least of each string's pieces, and the places where a whole string of a text fits."""
    room = np.diff(at) >= SPAN
    if not room.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = _BYTE[raw]
    for k in range(4):
        h = h[: len(h) - (1 << k)] * _STEP[k] + h[1 << k :]
    h = mix((h[:-32] * _STEP[4] + h[16:-16]) * _STEP[4] + h[32:])  # of GRAM bytes, three times 16
    low = _sliding(h, SPAN - GRAM + 1, np.minimum)
    begin = np.zeros(len(low) + 1, np.int64)
    np.add.at(begin, at[:-1][room], 1)
    np.add.at(begin, at[1:][room] - SPAN + 1, -1)
    return h, low, np.flatnonzero(np.cumsum(begin[:-1]) > 0)


def _leading(h: np.ndarray, low: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places of the pieces that are the least of a string that holds them."""
    pieces = SPAN - GRAM + 1
    known = np.zeros(len(low) + 2 * (pieces - 1), np.uint64)
    known[pieces - 1 + places] = low[places]
    # no string is above its pieces: a piece is the least of some string if the greatest of its strings equals it
    return np.flatnonzero((_sliding(known, pieces, np.maximum) == h) & (h != 0))


def leaders(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of every leading piece, place by place."""
    h, low, places = _hashed(raw, at)
    return h[_leading(h, low, places)] if len(places) else h[:0]


def segments(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start in it, strings, piece hash, segment hash, inner) of the segments of each text.

    inner: the piece may stand at several places of the segment, whose strings may then repeat each other.
    """
    h, low, places = _hashed(raw, at)
    if not len(places):
        none = np.zeros(0, np.int64)
        return none, none, none, h, h, none.astype(bool)
    windows = len(low)
    whole = (h[:windows] * _STEP[5] + h[26 : 26 + windows]) * _STEP[6] + h[SPAN - GRAM : SPAN - GRAM + windows]
    low_all, low, whole = low, low[places], whole[places]
    doc = np.searchsorted(at, places, side="right") - 1
    cut = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])])
    count = np.diff(np.append(cut, len(places)))
    nth = np.arange(len(places)) - np.repeat(cut, count)
    named = mix(np.add.reduceat(mix(whole) * _PLACE[nth & 0xFFFF], cut) + count.astype(np.uint64))
    pieces = SPAN - GRAM + 1
    lead = _leading(h, low_all, places)
    order = lead[np.argsort(h[lead], kind="stable")]
    close = np.flatnonzero((h[order[1:]] == h[order[:-1]]) & (order[1:] - order[:-1] < pieces))
    near = np.unique(h[order[close]])
    inner = (count > pieces) | np.isin(low[cut], near)
    return doc[cut], places[cut] - at[doc[cut]], count, low[cut], named, inner


def _with_bit(rows: DataFrame, column: str, filled: np.ndarray, bits: int) -> DataFrame:
    """The rows whose value has its bit set, so that a join need not move the others."""
    given = rows.sparkSession.sparkContext.broadcast(filled)
    at = rows.columns.index(column)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        mask = given.value
        for batch in batches:
            place = (batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
            yield batch.filter(pa.array((mask[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)))

    return rows.mapInArrow(tidy(run), rows.schema)


def _pieces(docs: DataFrame) -> DataFrame:
    """piece, n: at how many places each piece leads a string, summed for each run of texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for _, _, raw, at in text_chunks(batch.column(0), 1_000_000):
                piece, n = np.unique(leaders(raw, at), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(piece.view(np.int64)), pa.array(n, pa.int64())], ["piece", "n"])

    return docs.select("text").mapInArrow(tidy(run), "piece long, n long")


def _occurrences(docs: DataFrame, filled: np.ndarray) -> DataFrame:
    """piece, segment, doc, version, start, strings, inner, and the bytes at its first place in a run of texts."""
    given = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits = given.value
        names = ["piece", "segment", "doc", "version", "start", "strings", "inner", "bytes"]
        for batch in batches:
            ids, versions = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for lo, _, raw, at in text_chunks(batch.column(2), 1_000_000):
                doc, start, count, piece, named, inner = segments(raw, at)
                place = (piece & np.uint64(BITS - 1)).astype(np.int64)
                hit = np.flatnonzero(bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
                if not len(hit):
                    continue
                doc, start, count, piece, named, inner = doc[hit], start[hit], count[hit], piece[hit], named[hit], inner[hit]
                order = np.lexsort((start, versions[lo + doc], ids[lo + doc], named, piece))
                fresh = np.ones(len(hit), bool)
                fresh[order[1:]] = (piece[order[1:]] != piece[order[:-1]]) | (named[order[1:]] != named[order[:-1]])
                data, first = raw.tobytes(), at[doc] + start
                text = [data[a : a + c + SPAN - 1] if f else None for a, c, f in zip(first.tolist(), count.tolist(), fresh.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(piece.view(np.int64)), pa.array(named.view(np.int64)), pa.array(ids[lo + doc]), pa.array(versions[lo + doc]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(inner), pa.array(text, pa.binary())], names)

    return docs.mapInArrow(tidy(run), "piece long, segment long, doc long, version long, start int, strings int, inner boolean, bytes binary")


def repeats(texts: list[bytes], doc: np.ndarray, version: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """For each segment, the places of its strings that start earlier in some segment of the shard."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = np.frombuffer(b"\0".join(texts), np.uint8).astype(np.int64)
    begin = np.cumsum(size + 1) - size - 1
    joined += 1
    joined[(begin + size)[:-1]] = 0  # between segments; bytes are 1 to 256
    sa = suffix_array(joined, 257)
    common = permuted_prefixes(joined, sa)
    owner = np.repeat(np.arange(len(texts)), size + 1)[: len(joined)]
    inside = np.arange(len(joined)) - begin[owner]
    usable = inside <= size[owner] - SPAN
    place = sa[usable[sa]]
    chain = np.cumsum(common[place] < SPAN)
    # order of the starts: document, version, place in it
    rank = np.empty(len(texts), np.int64)
    by = np.lexsort((version, doc))
    rank[by] = np.cumsum(np.r_[0, (doc[by][1:] != doc[by][:-1]) | (version[by][1:] != version[by][:-1])])
    own = owner[place]
    when = rank[own] * (1 << 34) + start[own] + inside[place]
    cut = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
    earliest = np.repeat(np.minimum.reduceat(when, cut), np.diff(np.append(cut, len(place))))
    late = place[when > earliest]
    late.sort()
    bounds = np.searchsorted(late, np.append(begin, len(joined) + 1))
    return [late[a:b] - begin[i] for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Spans that the strings at sorted places cover."""
    if not len(places):
        return []
    gap = np.flatnonzero(places[1:] > places[:-1] + SPAN)
    return list(zip(places[np.r_[0, gap + 1]].tolist(), (places[np.r_[gap, len(places) - 1]] + SPAN).tolist()))


def _sorted_shards(groups: DataFrame) -> DataFrame:
    """doc, version, from, to: what the suffix arrays find in segments (key, doc, version, start, bytes), keys kept together."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple[int, int, int, int, bytes]] = []
        size = 0

        def out():
            doc, version, start = (np.array([h[k] for h in held], np.int64) for k in (1, 2, 3))
            found = repeats([h[4] for h in held], doc, version, start)
            rows = [(held[i][1], held[i][2], held[i][3] + a, held[i][3] + b) for i, places in enumerate(found) for a, b in _runs(places)]
            columns = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "version", "from", "to"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > SHARD and row[0] != held[-1][0]:
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield out()

    return groups.mapInArrow(tidy(run), "doc long, version long, from long, to long")


def _single_strings(hot: DataFrame) -> DataFrame:
    """key, doc, version, start, bytes: each string of the segments on its own, keyed by its bytes."""
    strings = hot.select("doc", "version", "start", "bytes", F.explode(F.sequence(F.lit(0), F.length("bytes") - SPAN)).alias("k"))
    strings = strings.select("doc", "version", (F.col("start") + F.col("k")).alias("start"), F.substring("bytes", F.col("k") + 1, SPAN).alias("bytes"))
    # equal strings collapse to their earliest start; the others are repeats, and _later finds them by the same key
    return strings.withColumn("key", F.xxhash64("bytes"))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc, version, spans (array of from, to; they may overlap) of every document that loses bytes.

    docs: doc_id, version, text, where version tells the texts of one doc_id apart.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), "version", F.col("text").cast("string").alias("text"))
    repeated = spool(_pieces(rows).groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 1").select("piece"), "pieces")
    filled = bits_of(repeated, BITS)
    occ = spool(_occurrences(rows, filled), "occurrences")
    drop_spool(repeated)
    place = F.struct("doc", "version", "start")
    groups = spool(
        occ.groupBy("piece", "segment").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.max("strings").alias("strings"), F.max("inner").alias("inner"), F.max("bytes").alias("bytes")),
        "segments",
    )
    # where a piece has one kind of segment, which repeats nothing in itself, the collapsed segment is all there is to find
    weight = groups.groupBy("piece").agg(F.sum(F.col("strings") + SPAN).alias("weight"), F.count("*").alias("kinds"), F.max("inner").alias("any_inner"))
    unsettled = spool(weight.filter("kinds > 1 OR any_inner").select("piece", "weight"), "unsettled")
    groups_ = _with_bit(groups, "piece", bits_of(unsettled.select("piece"), BITS), BITS).join(unsettled, "piece")
    flat = [F.col("first.doc").alias("doc"), F.col("first.version").alias("version"), F.col("first.start").cast("long").alias("start"), "bytes"]
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    even = groups_.filter(F.col("weight") <= HOT).select(F.col("piece").alias("key"), *flat)
    inner = _sorted_shards(even.repartition(spread, "key").sortWithinPartitions("key"))
    found = [inner]
    hot = groups_.filter(F.col("weight") > HOT).select(*flat)
    if hot.limit(1).count():
        singles = spool(_single_strings(hot), "singles")
        firsts = singles.groupBy("key", "bytes").agg(F.min(place).alias("first"))
        late = singles.join(firsts, ["key", "bytes"]).filter(place != F.col("first"))
        found.append(late.select("doc", "version", F.col("start").cast("long").alias("from"), (F.col("start") + SPAN).cast("long").alias("to")))
    # a segment that isn't the first of its kind is a repeat from end to end
    copies = occ.select("piece", "segment", "doc", "version", "start", "strings").join(groups.filter("n > 1").select("piece", "segment", "first"), ["piece", "segment"]).filter(place != F.col("first"))
    found.append(copies.select("doc", "version", F.col("start").cast("long").alias("from"), (F.col("start") + F.col("strings") + SPAN - 1).cast("long").alias("to")))
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    out = spool(every.groupBy("doc", "version").agg(F.collect_list(F.struct("from", "to")).alias("spans")), "spans")
    drop_spool(occ, groups, unsettled)
    return out


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def remove(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and what is left of the text.

    That is dedup_bytes, binary, or with as_text dedup_text, a string without the characters that a span's end cuts.

    Documents that lose nothing, told by a bit filter, pass without a shuffle.
    """
    left = "dedup_text" if as_text else "dedup_bytes"
    docs = docs.drop(left, "n_bytes", "n_removed", "n_spans")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    version = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    spans = find_spans(docs.select("doc_id", version.alias("version"), "text"))
    spans = spans.select(F.col("doc").alias("dedup_doc"), F.col("version").alias("dedup_version"), F.col("spans").alias("dedup_spans"))
    # a filter of fixed size; where it is full, more documents take the join
    place = F.pmod(F.xxhash64("dedup_doc", "dedup_version"), F.lit(TOUCHED))
    filled = bits_of(spans.select(place.alias("place")), TOUCHED)
    marked = docs.withColumns({"dedup_doc": doc, "dedup_version": version}).withColumn("dedup_touched", holds(place, filled, docs.sparkSession))
    cut = marked.filter("dedup_touched").join(spans, ["dedup_doc", "dedup_version"], "left").select(*docs.columns, "dedup_spans")
    plain = marked.filter("NOT dedup_touched")
    names = [*docs.columns, left, "n_bytes", "n_removed", "n_spans"]
    at, last = docs.columns.index("text"), len(docs.columns)

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            kept, sizes, removed, runs = [], [], [], []
            for text, found in zip(batch.column(at), batch.column(last)):
                data = (text.as_py() or "").encode()
                merged = _merged(found.as_py())
                ends = [0, *[b for _, b in merged]]
                kept.append(b"".join(data[a:b] for a, b in zip(ends, [*[a for a, _ in merged], len(data)])))
                sizes.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                runs.append(len(merged))
            if as_text:
                kept = [x.decode(errors="ignore") for x in kept]
            more = [pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *more], names)

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    cut = cut.mapInArrow(tidy(apply), f"{schema}, {left} {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    zero = F.lit(0).cast("long")
    whole = text if as_text else text.cast("binary")
    return cut.union(plain.select(*docs.columns, whole.alias(left), F.octet_length(text).cast("long"), zero, zero))
