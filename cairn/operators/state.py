"""Keyed state as batch plans, and rank selection without gathering a group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from cairn.runtime import settle

#: Keys' histories are cut into slices of this length, so that no task holds the whole history of a key.
SLICE_US = 3_600_000_000
#: Parts in which a range of values is counted, and values that may be ordered row by row.
PARTS, MOST = 4096, 1_000_000


def seconds(ts: Column) -> Column:
    """Microseconds since the epoch of a zoneless timestamp, as bigint."""
    return F.unix_micros(ts.cast("timestamp"))


def _hourly(events: DataFrame, ts: str) -> DataFrame:
    """``events`` with ``us`` and ``__hour``, the slice of time that a task works on; no time is the first slice."""
    us = seconds(F.col(ts))
    return events.withColumn("us", us).withColumn("__hour", F.coalesce(F.floor(us / SLICE_US), F.lit(-(1 << 62))))


def _carried(rows: DataFrame, totals: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with what their slice takes over from the earlier ones; null keys are a key."""
    t = totals.withColumnsRenamed({k: f"__t{i}" for i, k in enumerate((*keys, "__hour"))})
    same = [F.col(k).eqNullSafe(F.col(f"__t{i}")) for i, k in enumerate(keys)]
    on = reduce(and_, same, F.col("__hour") == F.col(f"__t{len(keys)}"))
    return rows.join(t, on).drop(*(f"__t{i}" for i in range(len(keys) + 1)))


def _before(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)


def segments(events: DataFrame, key: str, ts: str, order: str, gap_us: int) -> DataFrame:
    """``events`` with ``segment``, which grows where the key was silent for ``gap_us`` or longer.

    Numbered within each slice of time; the slices' totals, one row each, carry the numbers on. A row without
    time is a segment of its own.
    """
    w = Window.partitionBy(key, "__hour").orderBy(ts, order)
    e = _hourly(events, ts).withColumn("__inner", F.when(F.row_number().over(w) > 1, F.coalesce((F.col("us") - F.lag("us").over(w) >= gap_us).cast("bigint"), F.lit(1))).otherwise(0))
    e = e.withColumn("__run", F.sum("__inner").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = e.groupBy(key, "__hour").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.sum("__inner").alias("inner"))
    silent = F.col("first") - F.lag("last").over(Window.partitionBy(key).orderBy("__hour"))
    t = t.withColumn("new", F.coalesce((silent >= gap_us).cast("bigint"), F.lit(1)))
    t = t.select(key, "__hour", (F.col("new") + F.coalesce(F.sum(F.col("new") + F.col("inner")).over(_before(key)), F.lit(0))).alias("__carry"))
    e = _carried(e, t, key)
    return e.withColumn("segment", F.col("__carry") + F.col("__run")).drop("__inner", "__run", "__carry", "__hour")


def handoffs(signals: DataFrame, key: str, ts: str, order: str, ttl_us: int, fires_at: int = 3) -> DataFrame:
    """``signals`` with ``count`` and ``fired``: a counter that each signal refreshes for ``ttl_us``, that fires
    and starts anew at ``fires_at``. Silence of exactly the time to live ends it."""
    s = _hourly(segments(signals, key, ts, order, ttl_us), ts)
    s = s.withColumn("__nth", F.row_number().over(Window.partitionBy(key, "segment", "__hour").orderBy(ts, order)))
    t = s.groupBy(key, "segment", "__hour").agg(F.count("*").alias("n"))
    t = t.select(key, "segment", "__hour", F.coalesce(F.sum("n").over(_before(key, "segment")), F.lit(0)).alias("__carry"))
    s = _carried(s, t, key, "segment")
    s = s.withColumn("count", ((F.col("__carry") + F.col("__nth") - 1) % fires_at + 1).cast("int"))
    return s.withColumn("fired", F.col("count") == fires_at).drop("us", "segment", "__hour", "__nth", "__carry")


def token_bucket(events: DataFrame, key: str, ts: str, order: str, per_us: int | None, burst: int, idle_us: int = 3_600_000_000) -> DataFrame:
    """(key, order, allowed, retry_us): whether each event finds a token, and if not when one will be there; one comes
    every ``per_us``, at most ``burst``. None is no rate at all: the bucket is never filled again, and ``idle_us`` is
    given as the time to wait.

    After silence of ``burst * per_us`` a bucket is full whatever was before, so histories are cut there. The
    stretches are sorted by Spark and read as a stream of batches with the level as the only state.
    Amounts are whole microseconds' worth of tokens; time that runs backwards brings none.
    """
    full, cost = (burst, 1) if per_us is None else (burst * per_us, per_us)
    s = segments(events, key, ts, order, (1 << 62) if per_us is None else full).select(key, "segment", "us", order)
    s = s.repartition(F.col(key), F.col("segment")).sortWithinPartitions(key, "segment", "us", order)
    kind = StructType([events.schema[key], events.schema[order], StructField("allowed", BooleanType()), StructField("retry_us", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, level, at = None, 0, None
        for batch in batches:
            out, retry = [], []
            for k, segment, us in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if stretch != (k, segment):
                    stretch, level, at = (k, segment), full, us
                level = min(full, level + (max(0, us - at) if per_us is not None and us is not None and at is not None else 0))
                out.append(level >= cost)
                retry.append(0 if out[-1] else idle_us if per_us is None else cost - level)
                level, at = level - cost * out[-1], us
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(out, pa.bool_()), pa.array(retry, pa.int64())], [key, order, "allowed", "retry_us"])

    return s.mapInArrow(run, kind)


def in_force(events: DataFrame, key: str, ts: str, order: str, starts: Column, ttl_us: int) -> DataFrame:
    """``events`` with ``in_force``: whether an earlier event of the key that ``starts`` it is within its time to live."""
    w = Window.partitionBy(key, "__hour").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    e = _hourly(events, ts).withColumn("__start", F.when(starts, F.col("us")))
    t = e.groupBy(key, "__hour").agg(F.max("__start").alias("m"))
    t = t.select(key, "__hour", F.max("m").over(_before(key)).alias("__carry"))
    e = _carried(e.withColumn("__last", F.max("__start").over(w)), t, key)
    last = F.coalesce("__last", "__carry")
    return e.withColumn("in_force", F.coalesce(F.col("us") - last < ttl_us, F.lit(False))).drop("us", "__hour", "__start", "__last", "__carry")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the latest row of ``right`` at or before its time, null if there is none.

    Both sides are laid in one order per key and slice of time, and the last value is carried forward, over
    slices by their last values; no pairs are formed. Rows of ``right`` without value do not count; of several
    at one time the greatest value holds.
    """
    a = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(key, ts, F.lit(0).alias("__side"), F.col(value).alias("__v")).filter("__v is not null")
    both = _hourly(a.unionByName(b, allowMissingColumns=True), ts)
    w = Window.partitionBy(key, "__hour").orderBy(ts, "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    t = both.filter("__side = 0").groupBy(key, "__hour").agg(F.max_by("__v", F.struct("us", "__v")).alias("v"))
    t = both.select(key, "__hour").distinct().join(t, [key, "__hour"], "left")
    t = t.select(key, "__hour", F.last("v", ignorenulls=True).over(_before(key)).alias("__carry"))
    both = _carried(both.withColumn("__local", F.last("__v", ignorenulls=True).over(w)), t, key)
    return both.filter("__side = 1").withColumn(value, F.coalesce("__local", "__carry")).drop("__side", "__v", "us", "__hour", "__local", "__carry")


def at_ranks(df: DataFrame, label: str, value: str, sought: DataFrame, most: int = MOST) -> DataFrame:
    """``sought`` (label, index, and any other columns) with ``value``: the value of that index from 0 among the label's
    values in order. Values must be neither null nor NaN, and an index below their number.

    The range of each label is counted in ``PARTS`` equal parts, of which only the one that holds the index is looked at
    again, until it has at most ``most`` values or one value only; so no label's values are gathered or sorted as a
    whole, however they are spread. A null label is one.
    """
    spans = df.groupBy(label).agg(F.min(value).alias("__low"), F.max(value).alias("__high"), F.count("*").alias("__n"))
    want = sought.select(label, "index").distinct()
    zero = F.lit(0).cast("bigint")
    now = settle(_same(want, spans, label).select(label, "index", "__low", "__high", "__n", zero.alias("__skip"), (F.col("__n") + 1).alias("__was")))
    # a range that infinite values keep from getting narrower is ordered as it is
    while not now.filter((F.col("__n") > most) & (F.col("__low") < F.col("__high")) & (F.col("__n") < F.col("__was"))).isEmpty():
        inside = _same(df.select(label, value), now, label).filter(F.col(value).between(F.col("__low"), F.col("__high")))
        share = F.try_divide(F.col(value) - F.col("__low"), F.col("__high") - F.col("__low"))
        part = F.when(F.isnan(share), PARTS - 1).otherwise(F.least(F.floor(share * PARTS), F.lit(PARTS - 1)))
        counts = inside.withColumn("__was", F.col("__n")).groupBy(label, "index", "__skip", "__was", F.coalesce(part, F.lit(0)).alias("part")).agg(F.min(value).alias("__low"), F.max(value).alias("__high"), F.count("*").alias("__n"))
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(label, "index").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("__skip", F.col("__skip") + before)
        now = settle(counts.filter((F.col("index") >= F.col("__skip")) & (F.col("index") < F.col("__skip") + F.col("__n"))).drop("part"))
    inside = _same(df.select(label, value), now, label).filter(F.col(value).between(F.col("__low"), F.col("__high")))
    counts = inside.groupBy(label, "index", "__skip", value).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(label, "index").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) + F.col("__skip")
    found = counts.withColumn("__end", upto).filter((F.col("index") < F.col("__end")) & (F.col("index") >= F.col("__end") - F.col("__n")))
    return _same(sought, found.select(label, F.col("index").alias("__index"), value), label).filter("index = __index").drop("__index")


def _same(left: DataFrame, right: DataFrame, label: str) -> DataFrame:
    """``left`` with the columns of the rows of ``right`` that have its label, nulls being equal."""
    r = right.withColumnRenamed(label, "__label")
    shared = [c for c in r.columns if c in left.columns]
    return left.join(r.drop(*shared), left[label].eqNullSafe(r["__label"])).drop("__label")


def quantiles(df: DataFrame, label: str, value: str, at: list[float]) -> DataFrame:
    """(label, q, value): nearest-rank quantiles, index half-even-rounded q * (n - 1); nulls and NaN are left out."""
    v = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(label, value)
    n = v.groupBy(label).agg(F.count("*").alias("n")).withColumn("q", F.explode(F.array(*map(F.lit, at))))
    return at_ranks(v, label, value, n.select(label, "q", F.bround(F.col("q") * (F.col("n") - 1)).cast("bigint").alias("index"))).select(label, "q", value)


def interpolated(df: DataFrame, label: str, value: str, at: list[float]) -> DataFrame:
    """(label, q, value): quantiles between the two values about q * (n - 1), in proportion; nulls and NaN are left out."""
    v = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(label, value)
    n = v.groupBy(label).agg(F.count("*").alias("n")).withColumn("q", F.explode(F.array(*map(F.lit, at)))).withColumn("place", F.col("q") * (F.col("n") - 1))
    both = n.withColumn("index", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))))
    found = at_ranks(v, label, value, both.select(label, "q", "place", "index"))
    low, high = F.min_by(value, "index"), F.max_by(value, "index")
    return found.groupBy(label, "q").agg((low + (high - low) * (F.first("place") - F.floor(F.first("place")))).alias(value))


def histogram(df: DataFrame, label: str, value: str, bounds: list[float]) -> DataFrame:
    """(label, le, count, sum, total): cumulative counts at or below each bound and at infinity.

    Null and NaN are left out. Counted in one pass, without a row per value and bound.
    """
    v = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    at = [F.sum((F.col(value) <= b).cast("bigint")).alias(f"b{i}") for i, b in enumerate(bounds)]
    g = v.groupBy(label).agg(*at, F.count("*").alias("total"), F.round(F.sum(value), 4).alias("sum"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)] + [F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("count"))]
    return g.select(label, "total", "sum", F.inline(F.array(*rows)))


def increments(df: DataFrame, labels: list[str], value: str) -> DataFrame:
    """(labels, total, rejected): counters by labels. They only grow: negative, null and NaN amounts are rejected and counted."""
    ok = F.coalesce((F.col(value) >= 0) & ~F.isnan(value), F.lit(False))
    total = F.coalesce(F.sum(F.when(ok, F.col(value))), F.lit(0.0))
    return df.groupBy(*labels).agg(F.round(total, 4).alias("total"), F.sum((~ok).cast("bigint")).alias("rejected"))
