"""The time frames of causal features and the rewrites that Spark has no operator for.

`strict_past` sees only earlier seconds, `open_window` (t-w, t), `closed_left` [t-w, t), `stream_past` the rows before in
(t, event_id) order. No window here lacks a partition key: a global order goes through `global_position`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def strict_past(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("t").rangeBetween(Window.unboundedPreceding, -1)


def open_window(seconds: int, *keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("t").rangeBetween(-(seconds - 1), -1)


def closed_left(seconds: int, *keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("t").rangeBetween(-seconds, -1)


def earlier_in_window(seconds: int, *keys: str) -> Column:
    """How many rows of the keys come before this one in stream order with a time in (t - seconds, t].

    The time frame also holds the row itself and those of its second that come after it; their number in stream order is
    taken off. One sort by (t, event_id) serves all of it.
    """
    rows = Window.partitionBy(*keys).orderBy("t", "event_id")
    upto = F.count("*").over(rows.rowsBetween(Window.unboundedPreceding, -1))
    before = F.count("*").over(Window.partitionBy(*keys).orderBy("t").rangeBetween(Window.unboundedPreceding, -seconds))
    return upto - before


def stream_past(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1)


def first_in_stream(*keys: str) -> Column:
    """1 on the first row of the keys in stream order, else 0."""
    return (F.row_number().over(Window.partitionBy(*keys).orderBy("t", "event_id")) == 1).cast("int")


def distinct_in_window(df: DataFrame, key: str, counts: list[tuple[str, dict[str, int], Column | None]], dealt: bool = False) -> DataFrame:
    """df with, for each name, the number of distinct partners of the same `key` in (t-w, t), after one shuffle by key.

    dealt: whether df already lies by key.

    counts: (partner column, {name: seconds}, condition of the rows that count or None). The times of a (key, partner) form runs that
    cover the queries (start, end+w). A row that opens or closes a run marks that place besides its own; the answer is the running
    sum of starts less ends over the key's places. Linear in the rows, however many a window holds. Only the row's own place carries its
    columns through the sort.
    """
    rows, marks = df if dealt else df.repartition(key), []
    names = [n for _, windows, _ in counts for n in windows]
    others = [c for c in df.columns if c != key]
    row, no_row = F.struct(*others).alias("_row"), F.lit(None).cast(df.select(F.struct(*others)).schema[0].dataType).alias("_row")
    sign = lambda name=None, value=0: [F.lit(value if n == name else 0).alias(n) for n in names]
    for i, (partner, windows, on) in enumerate(counts):
        held = F.lit(True) if on is None else F.coalesce(on, F.lit(False))
        rows = rows.withColumn(f"_held{i}", F.when(held, F.col("t")))
        # the rows that count before and after; of rows that don't, the values aren't used
        times = Window.partitionBy(key, partner).orderBy("t", "event_id")
        rows = rows.withColumns({f"_last{i}": F.last(f"_held{i}", ignorenulls=True).over(times.rowsBetween(Window.unboundedPreceding, -1)), f"_next{i}": F.expr(f"lead(_held{i}) IGNORE NULLS OVER (PARTITION BY {key}, {partner} ORDER BY t, event_id)")})
        last, after = F.col(f"_last{i}"), F.col(f"_next{i}")
        for name, w in windows.items():
            marks.append(F.when(held & (last.isNull() | (F.col("t") >= last + w)), F.struct((2 * F.col("t") + 2).alias("_place"), no_row, *sign(name, 1))))
            marks.append(F.when(held & (after.isNull() | (after >= F.col("t") + w)), F.struct((2 * (F.col("t") + w)).alias("_place"), no_row, *sign(name, -1))))
    own = F.struct((2 * F.col("t") + 1).alias("_place"), row, *sign())
    every = rows.select(key, F.inline(F.array_compact(F.array(own, *marks))))
    upto = Window.partitionBy(key).orderBy("_place").rangeBetween(Window.unboundedPreceding, 0)
    summed = every.withColumns({n: F.sum(n).over(upto).cast("long") for n in names}).filter("_row IS NOT NULL")
    return summed.select(*[c if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns], *names)


def rolling_split(df: DataFrame, seconds: int, keys: list[str], made: dict[str, Column], bucket: int = 86_400) -> DataFrame:
    """Aggregates over (t-w, t) for keys that a single task couldn't hold: each time bucket of a key is a task of its own.

    Rows also go to the next bucket, as its tail; windows must not be longer than a bucket. `made` maps names to aggregates,
    without their window.
    """
    if seconds > bucket:
        raise ValueError("a window is longer than a bucket")
    own = F.floor(F.col("t") / bucket)
    rows = df.withColumn("_own", own).withColumn("_bucket", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy(*keys, "_bucket").orderBy("t").rangeBetween(-(seconds - 1), -1)
    for name, column in made.items():
        rows = rows.withColumn(name, column.over(w))
    return rows.filter("_own = _bucket").drop("_own", "_bucket")


def global_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """df with its place, from 0, in a total order: range partitions are numbered apart and shifted by their offsets.

    The driver sees one row for each partition. The range-partitioned rows are read twice, so an order with ties must end
    in a unique column.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    ranged = ranged.persist()
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    offsets, at = [], 0
    for p in sorted(counts):
        offsets.append((p, at))
        at += counts[p]
    shift = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _offset long")
    inner = Window.partitionBy("_part").orderBy(*order)
    return ranged.join(F.broadcast(shift), "_part").withColumn(name, F.col("_offset") + F.row_number().over(inner) - 1).drop("_part", "_offset")


def running_totals(df: DataFrame, order: str, values: list[str], descending: bool = False) -> DataFrame:
    """df (unique `order`) with cum_<value>: sums up to and including the row, by two levels of prefixes."""
    key = F.col(order).desc() if descending else F.col(order).asc()
    ranged = df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()).persist()
    sums = ranged.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values]).collect()
    rows, at = [], [0] * len(values)
    for r in sorted(sums, key=lambda r: r["_part"]):
        rows.append((r["_part"], *at))
        at = [a + (r[v] or 0) for a, v in zip(at, values)]
    kinds = dict(df.dtypes)
    schema = "_part int" + "".join(f", _{v} {'double' if kinds[v] in ('double', 'float') else 'long'}" for v in values)
    shift = df.sparkSession.createDataFrame(rows or [(0, *at)], schema)
    upto = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(shift), "_part")
    for v in values:
        out = out.withColumn(f"cum_{v}", F.col(f"_{v}") + F.sum(v).over(upto))
    return out.drop("_part", *[f"_{v}" for v in values])


def totals_before(df: DataFrame, order: list[str], values: list[str], back: int | None = None) -> DataFrame:
    """df with position (from 0) in a total order, before_<value>: sums of whole numbers over the rows before, after one range shuffle.

    back: also older_<value>, the same sums `back` rows earlier (0 where there are not so many). They come from the row's own partition; for its
    first `back` rows they are broadcast, `back` rows of each partition at most. The driver sees one row for each partition.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()).persist()
    sums = ranged.groupBy("_part").agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in values]).collect()
    shifts, at = [], [0] * (1 + len(values))
    for r in sorted(sums, key=lambda r: r["_part"]):
        shifts.append((r["_part"], r["n"], *at))
        at = [a + (r[c] or 0) for a, c in zip(at, ["n", *values])]
    schema = "_part int, _size long, _start long" + "".join(f", _start_{v} long" for v in values)
    shift = df.sparkSession.createDataFrame(shifts or [(0, 0, *at)], schema)
    inner = Window.partitionBy("_part").orderBy(*order)
    rows = ranged.join(F.broadcast(shift), "_part").withColumn("_row", F.row_number().over(inner) - 1)
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"position": F.col("_start") + F.col("_row"), **{f"before_{v}": F.col(f"_start_{v}") + F.coalesce(F.sum(v).over(earlier), F.lit(0)) for v in values}})
    olds = []
    if back is not None:
        rows = rows.withColumns({f"_lag_{v}": F.lag(f"before_{v}", back).over(inner) for v in values})
        border = rows.filter(F.col("_row") + back >= F.col("_size")).select((F.col("position") + back).alias("position"), *[F.col(f"before_{v}").alias(f"_border_{v}") for v in values])
        olds = [F.coalesce(f"_lag_{v}", f"_border_{v}", F.lit(0)).cast("long").alias(f"older_{v}") for v in values]
        rows = rows.join(F.broadcast(border), "position", "left")
    return rows.select(*df.columns, "position", *[f"before_{v}" for v in values], *olds)
