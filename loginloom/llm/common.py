"""What the operators share: reading tables, cutting lineage in the shared folder, hashing in numpy."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

#: A word of the contracts: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spool(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: it outlives lost executors and has no lineage.

    The shuffle files of the write go with it; Spark makes them again if df itself is run once more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_spool(*dfs: DataFrame) -> None:
    """Deletes what spool() wrote for dfs, once nothing reads it any more."""
    for df in dfs:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def text_key(text):
    """A key of equal texts; null has its own."""
    return F.coalesce(F.sha2(text, 256), F.lit("null"))


#: What an operator keeps in a Python worker from one task to the next.
_KEPT: dict[tuple, object] = {}
#: Whether this worker's modules are set aside, so that collecting garbage doesn't walk through them in every task.
_FROZEN: list[bool] = []


def kept(key: tuple, make):
    """What this worker keeps under `key`, made if it is new; what it keeps under other keys goes."""
    if key not in _KEPT:
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Drops what operators keep in this worker and gives free memory back to the system, which Python, Arrow and C would hold."""
    import ctypes
    import gc

    import pyarrow as pa

    _KEPT.clear()
    gc.collect()
    if not _FROZEN:
        gc.freeze()
        _FROZEN.append(True)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(run):
    """`run`, a function of a task's batches, with give_back() before and after."""

    def whole(batches):
        give_back()
        yield from run(batches)
        give_back()

    return whole


M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the result."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= M2
        x ^= x >> np.uint64(27)
        x *= M3
        x ^= x >> np.uint64(31)
    return x


def column_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array, and where each value starts (one offset more than values).

    Null counts as empty. The bytes are those of the array's own buffer, so nothing is copied.
    """
    import pyarrow as pa

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Each byte's random value, A-Z as a-z; and odd factors of the first places in a word.
_BYTE = np.random.default_rng(11).integers(0, 2**64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = np.random.default_rng(12).integers(0, 2**64, 1 << 16, np.uint64) | np.uint64(1)


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, hash) of every word of the texts raw[at[i]:at[i+1]], words as of WORD, A-Z lower-cased."""
    inside = ~_SPACE[raw]
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    where = np.flatnonzero(inside)
    first = np.searchsorted(where, starts)
    length = np.diff(np.append(first, len(where)))
    place = where - np.repeat(starts, length)
    factor = _PLACE[place & 0xFFFF]
    late = np.flatnonzero(place > 0xFFFF)
    if len(late):  # places beyond the table have factors of their own
        factor[late] = mix(place[late].astype(np.uint64) * M3) | np.uint64(1)
    value = _BYTE[raw[where]] * factor
    hashed = mix(np.add.reduceat(value, first) + length.astype(np.uint64) * M1)
    return np.searchsorted(at, starts, side="right") - 1, starts, length, hashed


def text_chunks(texts, most: int = 2_000_000):
    """(first row, last row, bytes, offsets) of runs of an Arrow text column of about `most` bytes."""
    raw, at = column_bytes(texts)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


#: The blocks in which the bits of all tasks are merged.
BIT_BLOCKS = 64


def _merge_bits(rows: DataFrame, size: int) -> np.ndarray:
    """Bit blocks of all tasks, joined on the executors; `size` bytes reach the driver, packed."""
    import zlib

    def run(batches):
        import pyarrow as pa

        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(data), np.uint8)
                merged[block] = merged[block] | x if block in merged else x
        for block, x in merged.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["block", "data"])

    out = np.zeros((BIT_BLOCKS, size // BIT_BLOCKS), np.uint8)
    for r in rows.repartition(BIT_BLOCKS // 4, "block").mapInArrow(tidy(run), "block int, data binary").collect():
        out[r.block] = np.frombuffer(zlib.decompress(r.data), np.uint8)
    return out.reshape(-1)


def bits_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """A packed bit array with a bit set for each value, modulo `bits`, of the one long column."""
    import zlib

    def run(batches):
        import pyarrow as pa

        seen = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            place = (batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(seen, place >> 3, np.uint8(128) >> (place & 7).astype(np.uint8))
        for i, x in enumerate(np.split(seen, BIT_BLOCKS)):
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["block", "data"])

    return _merge_bits(hashes.mapInArrow(tidy(run), "block int, data binary"), bits // 8)


def holds(place, filled: np.ndarray, spark: SparkSession):
    """Whether the bit at `place`, a long column, is set in a packed array: it comes from a scalar subquery, so no Python runs."""
    words = np.packbits(np.unpackbits(filled), bitorder="little").view(np.int64)
    given = spark.createDataFrame([(words.tolist(),)], "words array<long>").select("words").scalar()
    return F.getbit(F.element_at(given, (F.shiftright(place, 6) + 1).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1
