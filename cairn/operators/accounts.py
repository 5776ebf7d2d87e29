"""Accounts: locking after failures, single-use tokens and their replay, expiry, roles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cairn.operators.state import _before, _carried, _hourly, seconds

# Roles, each with those whose rights it has.
GRANTS = {"admin": ("admin", "kb_admin", "operator", "user"), "kb_admin": ("kb_admin", "operator", "user"), "operator": ("operator", "user"), "user": ("user",)}


def has_role(role: Column, needed: str) -> Column:
    """Whether a role has the rights of another; unknown and null roles have none."""
    return F.coalesce(role.isin(*(r for r, has in GRANTS.items() if needed in has)), F.lit(False))


def lockouts(attempts: DataFrame, key: str, ts: str, order: str, failed: Column, most: int, lock_us: int) -> DataFrame:
    """``attempts`` with ``failures`` in a row up to each and ``locked_until`` (microseconds): ``lock_us`` after a failure
    that is at least the ``most``-th. A success starts anew.

    Counted within slices of time, over which sums are carried, so no key's history is one task.
    """
    a = _hourly(attempts, ts).withColumn("__ok", F.when(failed, 0).otherwise(1))
    w = Window.partitionBy(key, "__hour").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    t = a.groupBy(key, "__hour").agg(F.sum("__ok").alias("n"))
    t = t.select(key, "__hour", F.coalesce(F.sum("n").over(_before(key)), F.lit(0)).alias("__carry"))
    a = _carried(a.withColumn("__in", F.sum("__ok").over(w)), t, key).withColumn("__run", F.col("__carry") + F.col("__in")).drop("__carry", "__in")
    w = Window.partitionBy(key, "__run", "__hour").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    t = a.groupBy(key, "__run", "__hour").agg(F.sum(1 - F.col("__ok")).alias("n"))
    t = t.select(key, "__run", "__hour", F.coalesce(F.sum("n").over(_before(key, "__run")), F.lit(0)).alias("__carry"))
    a = _carried(a.withColumn("__in", F.sum(1 - F.col("__ok")).over(w)), t, key, "__run")
    a = a.withColumn("failures", F.when(F.col("__ok") == 1, 0).otherwise(F.col("__carry") + F.col("__in")).cast("bigint"))
    locked = F.when((F.col("__ok") == 0) & (F.col("failures") >= most), F.col("us") + lock_us)
    return a.withColumn("locked_until", locked).drop("us", "__hour", "__ok", "__run", "__in", "__carry")


def consumers(uses: DataFrame, token: str, ts: str, order: str, expires: str) -> DataFrame:
    """The one use of each token that consumes it: the first that comes before its end."""
    w = Window.partitionBy(token).orderBy(ts, order)
    return uses.filter(F.col(ts) < F.col(expires)).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def rotations(uses: DataFrame, user: str, token: str, ts: str, order: str, issued: str, expires: str) -> DataFrame:
    """(order, verdict) of each use of a single-use token: ``ok`` consumes it, ``expired`` comes too late, and ``replay`` is
    a use of a token that was consumed or revoked before; it revokes all tokens of the user issued until then.

    Whether a token was consumed is told by its first use; revocation needs only the time of the user's last replay,
    which is carried along the uses of a user in the order of time, sorted by Spark and read as a stream.
    """
    w = Window.partitionBy(token).orderBy(ts, order)
    u = uses.select(user, order, seconds(F.col(ts)).alias("us"), seconds(F.col(issued)).alias("issued"), seconds(F.col(expires)).alias("expires"), F.row_number().over(w).alias("n"), seconds(F.min(ts).over(Window.partitionBy(token))).alias("first"))
    u = u.withColumn("again", (F.col("n") > 1) & (F.col("first") < F.col("expires"))).select(user, "us", order, "issued", "expires", "again")
    u = u.repartition(F.col(user)).sortWithinPartitions(user, "us", order)
    kind = StructType([uses.schema[order], StructField("verdict", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, replayed = None, None
        for batch in batches:
            out = []
            for k, us, issued_at, end, again in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                if k != who:
                    who, replayed = k, None
                if again or (replayed is not None and issued_at < replayed):
                    replayed = us
                    out.append("replay")
                else:
                    out.append("ok" if us < end else "expired")
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.string())], [order, "verdict"])

    return u.mapInArrow(run, kind)


def purged(tokens: DataFrame, expires: str, now: Column, keep_days: int = 1) -> DataFrame:
    """Tokens that have not ended more than ``keep_days`` ago."""
    return tokens.filter(F.col(expires) >= now - F.make_interval(days=F.lit(max(0, keep_days))))
