"""Importance resampling towards a target distribution, over hashed runs of words.

Features are all runs of one to MOST_RUN consecutive words, joined by a space; a feature's bucket is the CRC-32 of its UTF-8 bytes, modulo
`buckets`. A task takes texts in chunks: Arrow's dictionary gives the chunk's words exact numbers, so the distinct features are
distinct tuples of numbers. These are grouped by their length in bytes into two-dimensional uint8 matrices; one column after the
other updates the CRCs of all rows at once, and the buckets are scattered back to the occurrences. A first pass counts buckets,
merged block by block on the executors (`buckets` sums reach the driver), a second adds up the gains of each document. Scores
are log weights plus Gumbel noise drawn from a hash of the doc_id; the highest are the sample without replacement.

Cases: null texts and texts without words have no features, weight 0 and are never drawn unless `least_words` is 0. A null doc_id
has no hash and so no score and is never drawn, but its text counts. Repeated rows are scored alike and drawn
one by one, ties beyond doc_id by a hash of the text. Empty tables: no target text gives counts of 0, no documents an empty result. A feature longer
than LONG bytes shares its length with hardly another, so its rows go through the columns in pieces of LONG bytes whose CRCs are
then joined. Memory is bounded by a chunk of texts or one longer text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, drop_spool, spool, text_chunks, tidy

MOST_RUN = 3
#: Features beyond this many bytes are cut into pieces.
LONG = 256
#: Words whose features are told apart at once.
WORDS = 300_000
CHUNK = 1_000_000
#: Blocks in which the tasks' counts are merged.
BLOCKS = 16

_INSIDE = np.ones(256, bool)
_INSIDE[[b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, np.uint32(0xEDB88320) ^ (out >> np.uint32(1)), out >> np.uint32(1))
    return out


_CRC = _crc_table()


def crc_columns(matrix: np.ndarray) -> np.ndarray:
    """The CRC-32 of each row of a uint8 matrix, column by column."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = _CRC[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def _after_zeros(n: int) -> np.ndarray:
    """What n zero bytes make of each bit of a CRC register: a linear map over bits, as 32 columns."""
    power = 1 << np.arange(32, dtype=np.uint32)
    step = _CRC[power & np.uint32(0xFF)] ^ (power >> np.uint32(8))
    out = power.astype(np.uint32)
    while n:
        if n & 1:
            out = _apply(step, out)
        step, n = _apply(step, step), n >> 1
    return out


def _apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    bits = (x[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(np.where(bits == 1, columns[None, :], np.uint32(0)), axis=1)


def crcs(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of each raw[start:start+length]: rows of equal length form matrices."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(length[order], prepend=-1)), len(order))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        n = int(length[order[a]])
        if n <= LONG:
            each = max(1, 4_000_000 // max(1, n))
            for lo in range(a, b, each):
                rows = order[lo : min(b, lo + each)]
                out[rows] = crc_columns(raw[start[rows][:, None] + np.arange(n)])
            continue
        for row in order[a:b].tolist():
            # the whole pieces of the one row form a matrix; its rest joins them at the end
            whole = n // LONG * LONG
            pieces = crc_columns(raw[start[row] : start[row] + whole].reshape(-1, LONG))
            shift = LONG
            while len(pieces) > 1:  # neighbours join, as long as there are two
                if len(pieces) % 2:  # a piece of zeros before the first changes nothing but the register's start
                    pieces = np.concatenate([np.zeros(1, np.uint32), pieces])
                pieces, shift = _apply(_after_zeros(shift), pieces[0::2]) ^ pieces[1::2], 2 * shift
            last = raw[start[row] + whole : start[row] + n]
            tail = crc_columns(last[None, :]) if len(last) else np.zeros(1, np.uint32)
            out[row] = (_apply(_after_zeros(n - whole), pieces) ^ tail)[0]
    return out


def features(raw: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every feature of the texts raw[at[i]:at[i+1]], in runs of words."""
    import pyarrow as pa

    inside = _INSIDE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    start = np.flatnonzero(begins)
    if not len(start):
        return
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    size = np.flatnonzero(ends) + 1 - start
    doc = np.searchsorted(at, start, side="right") - 1
    letters = _LOWER[raw[inside]]
    cuts = np.concatenate([[0], np.cumsum(size)])
    for lo in range(0, len(start), WORDS):
        hi = min(len(start), lo + WORDS)
        upto = min(len(start), hi + MOST_RUN - 1)  # runs that begin here end there at last
        n, base = upto - lo, cuts[lo]
        some = letters[base : cuts[upto]]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(cuts[lo : upto + 1] - base)), pa.py_buffer(some)])
        number = words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        # the words again, a space after each
        length = size[lo:upto]
        place = np.concatenate([[0], np.cumsum(length + 1)])
        joined = np.full(place[-1], 32, np.uint8)
        joined[np.arange(len(some)) + np.repeat(np.arange(n), length)] = some
        owner = doc[lo:upto]
        key = np.zeros(n, np.int64)
        for k in range(1, MOST_RUN + 1):
            m = min(hi - lo, n - k + 1)
            if m <= 0:
                break
            key = (key[: n - k + 1] << 21) | number[k - 1 :]
            rows = np.flatnonzero(owner[:m] == owner[k - 1 : k - 1 + m])
            if not len(rows):
                continue
            _, first, back = np.unique(key[rows], return_index=True, return_inverse=True)
            first = rows[first]
            crc = crcs(joined, place[first], place[first + k] - 1 - place[first])
            yield owner[rows], (crc % np.uint32(buckets)).astype(np.int64)[back]


def _n_words(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    inside = _INSIDE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    inside[1:] &= ~inside[:-1] | edge[1:-1]
    return np.diff(np.concatenate([[0], np.cumsum(inside)])[at])


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts (the one column) lie in each bucket."""
    import zlib

    parts = np.array_split(np.arange(buckets), BLOCKS)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, raw, at in text_chunks(batch.column(0), CHUNK):
                for _, bucket in features(raw, at, buckets):
                    counts += np.bincount(bucket, minlength=buckets)
        held = [i for i, p in enumerate(parts) if counts[p].any()]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([zlib.compress(counts[parts[i]].tobytes(), 1) for i in held], pa.binary())], ["block", "data"])

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(data), np.int64)
                sums[block] = sums[block] + x if block in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "data"])

    out = np.zeros(buckets, np.int64)
    rows = texts.mapInArrow(tidy(count), "block int, data binary").repartition(BLOCKS, "block").mapInArrow(tidy(merge), "block int, data binary")
    for r in rows.collect():  # BLOCKS rows
        out[parts[r.block]] = np.frombuffer(r.data, np.int64)
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share of the target over its share of the documents."""
    import math

    n, s, t = len(have), float(have.sum()), float(want.sum())
    return np.array([math.floor(1000 * math.log((float(w) + 1) * (t_all) / ((float(h) + 1) * (s_all)))) for h, w in zip(have.tolist(), want.tolist()) for t_all, s_all in [(s + n, t + n)]], np.int64)


def _weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, tie, n_words, n_features, weight of every text."""
    buckets = len(gain)
    given = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        gain = given.value
        for batch in batches:
            for lo, hi, raw, at in text_chunks(batch.column(2), CHUNK):
                n, weight = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for doc, bucket in features(raw, at, buckets):
                    n += np.bincount(doc, minlength=hi - lo)
                    np.add.at(weight, doc, gain[bucket])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(_n_words(raw, at)), pa.array(n), pa.array(weight)], ["doc_id", "tie", "n_words", "n_features", "weight"])

    return docs.mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, tie long, n_words long, n_features long, weight long")


def _numbered(rows: DataFrame, order: list) -> DataFrame:
    """rows with `place`, from 1, in the order: ranges are sorted apart and shifted by the sizes of those before, one row each."""
    spark = rows.sparkSession
    ranged = spool(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    sizes = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    offsets, at = [], 0
    for p in sorted(sizes):
        offsets.append((p, at))
        at += sizes[p]
    shift = spark.createDataFrame(offsets, "part int, offset long")
    return ranged.join(F.broadcast(shift), "part").withColumn("place", F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(*order))).drop("part", "offset")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (1 for the highest score drawn, null if not drawn) of every document."""
    text = F.col("text").cast("string")
    docs = docs.select("doc_id", F.xxhash64(text).alias("tie"), text.alias("text"))
    have = bucket_counts(docs.select("text"), buckets)
    want = bucket_counts(target.select(text.alias("text")), buckets)
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / 4294967296.0)))
    scored = spool(_weighed(docs, gains(have, want)).withColumn("score", F.col("weight") + noise), "scored")
    fit = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    drawn = percent * scored.filter(fit).count() // 100
    placed = _numbered(scored.filter(fit), [F.desc("score"), F.asc("doc_id"), F.asc("tie")])
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return placed.select(*columns, rank.alias("rank")).union(scored.filter(~fit).select(*columns, F.lit(None).cast("long")))


def sql(buckets: int, percent: int, least_words: int, seed: int) -> str:
    """The same from every feature as a string; SQL has no CRC, so that is a fold over bytes."""
    table = "list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, b))"
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        WITH crc AS MATERIALIZED (SELECT {table} AS z),
        d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT {words} AS w FROM benchmark),
        runs AS (SELECT doc_id, w, 0 AS side FROM d UNION ALL SELECT NULL, w, 1 FROM b),
        f AS MATERIALIZED (
            SELECT doc_id, side, unnest(list_concat(w,
                list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
                list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature FROM runs
        ),
        named AS MATERIALIZED (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM f)),
        hashed AS MATERIALIZED (
            SELECT feature, xor(4294967295, list_reduce(list_transform(range(0, len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1),
                lambda c, x: xor(z[xor(c, x::BIGINT) % 256 + 1], c // 256), 4294967295)) % {buckets} AS bucket FROM named, crc
        ),
        counted AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN hashed USING (feature) GROUP BY bucket),
        total AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counted),
        gain AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + {buckets}) / ((s + 1)::DOUBLE * (t_all + {buckets}))))::BIGINT AS g FROM counted, total
        ),
        weighed AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS weight FROM f JOIN hashed USING (feature) JOIN gain USING (bucket) WHERE side = 0 GROUP BY doc_id),
        scored AS (
            SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM d LEFT JOIN weighed USING (doc_id)
        ),
        placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_words >= {least_words})
        SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= {percent} * (SELECT count(*) FROM placed) // 100 THEN place END AS rank
        FROM scored s LEFT JOIN placed USING (doc_id)
    """
