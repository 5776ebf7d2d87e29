"""Metrics, keyed state, orders and general analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators import state
from cairn.runtime import table

HOUR = 3_600_000_000
#: Bounds of the value histogram.
BOUNDS = [0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def counter_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return _events(spark, sf_dir).groupBy("event_type", (k % 10).alias("k10")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.histogram(_events(spark, sf_dir), "event_type", "value", BOUNDS)


def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.quantiles(_events(spark, sf_dir), "event_type", "value", [0.5, 0.9, 0.99])


def interpolated_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = state.interpolated(_events(spark, sf_dir), "event_type", "value", [0.5, 0.9])
    return found.groupBy("event_type").agg(*(F.round(F.max(F.when(F.col("q") == q, F.col("value"))), 6).alias(n) for q, n in ((0.5, "p50"), (0.9, "p90"))))


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.token_bucket(_events(spark, sf_dir), "user_id", "ts", "event_id", 8 * HOUR, 3)


def handoff_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter("event_type = 'error'")
    return state.handoffs(e, "user_id", "ts", "event_id", 72 * HOUR).select("event_id", "count", "fired")


def revoked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = state.in_force(_events(spark, sf_dir), "user_id", "ts", "event_id", F.col("event_type") == "error", 12 * HOUR)
    return e.select("event_id", F.col("in_force").alias("revoked"))


def first_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return _events(spark, sf_dir).withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("user_id", "event_type", "event_id")


def as_of_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    buys = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return state.as_of(buys, views, "user_id", "ts", "view_id").select("event_id", "view_id")


def tumbling_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _events(spark, sf_dir).groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("events"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "events")


def sliding_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _events(spark, sf_dir).groupBy(F.window("ts", "12 hours", "6 hours")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "events", "total")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _events(spark, sf_dir).groupBy(F.session_window("ts", "4 hours"), "user_id").agg(F.count("*").alias("events"), F.max("ts").alias("last"))
    return g.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "events", "last")


def distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("users"))


def cube_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def rollup_ships(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
    return t.rollup("year", "month").agg(F.count("*").alias("lines"))


def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return t.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(f"n_{c.lower()}") for c in ("F", "O", "P")))


def flags_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    a, b = t.filter("l_quantity > 25").select("l_partkey"), t.filter("l_discount > 0.05").select("l_partkey")
    return a.intersect(b)


def orders_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return t.select("o_custkey").exceptAll(t.filter("o_totalprice > 200000").select("o_custkey")).groupBy("o_custkey").agg(F.count("*").alias("orders"))


def recent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("nth", F.row_number().over(w)).filter("nth <= 3").select("o_custkey", "o_orderkey", "nth")


def counter_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.increments(_events(spark, sf_dir).withColumn("value", F.col("value") - 30), ["event_type"], "value")


def principal_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every user by the customer that the user stands for; users that stand for none have none."""
    u = table(spark, sf_dir, "users").filter("user_id is not null").select("user_id", F.expr("try_cast(substr(customer_id, 2) as bigint)").alias("who")).distinct()
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("who"), F.lit(1).alias("known")), table(spark, sf_dir, "orders")
    mine = o.join(u.select(F.col("who").alias("o_custkey")).filter("o_custkey is not null").distinct(), "o_custkey", "left_semi").groupBy(F.col("o_custkey").alias("who")).agg(F.count("*").alias("orders"))
    j = u.join(c, "who", "left").join(mine, "who", "left")
    return j.select("user_id", F.when(F.col("known") == 1, F.col("who")).alias("customer"), F.when(F.col("known") == 1, F.coalesce("orders", F.lit(0))).alias("orders"))


def ownership_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order of somebody else looks the same as no order."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    asked = o.filter("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("asked"), (F.col("o_custkey") - F.col("o_orderkey") % 3).alias("who"))
    known = asked.join(c.select(F.col("c_custkey").alias("who")), "who", "left_semi")
    j = known.join(o.select(F.col("o_orderkey").alias("asked"), F.col("o_custkey").alias("who"), "o_orderstatus"), ["asked", "who"], "left")
    return j.select("asked", "who", F.coalesce("o_orderstatus", F.lit("not found")).alias("status"))


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("net"), F.max("l_shipdate").alias("shipped"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderdate")
    return o.join(li, "l_orderkey").select("l_orderkey", "o_orderstatus", "lines", "net", F.datediff("shipped", "o_orderdate").cast("bigint").alias("days"))


QUERIES = {
    f.__name__: f
    for f in (
        counter_by_label, latency_histogram, latency_quantiles, interpolated_quantiles, token_bucket, handoff_fold, revoked_events, first_use, as_of_view, tumbling_hours, sliding_hours, user_sessions,
        distinct_users, cube_flags, rollup_ships, pivot_status, flags_common, orders_left, recent_orders, ownership_check, nested_orders, counter_rejections, principal_orders,
    )
}

_H = HOUR
SQL = {
    "counter_by_label": "SELECT event_type, (json_extract_string(props, '$.k')::int % 10)::int AS k10, count(*)::bigint AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "latency_histogram": "WITH b AS (SELECT unnest([" + ", ".join(map(str, BOUNDS)) + "]::double[]) AS le UNION ALL SELECT 'inf'::double), v AS (SELECT * FROM events WHERE value IS NOT NULL AND NOT isnan(value)), t AS (SELECT event_type, count(*)::bigint AS total, round(sum(value), 4) AS sum FROM v GROUP BY 1) SELECT t.*, le, (SELECT count(*) FROM v WHERE v.event_type = t.event_type AND v.value <= b.le)::bigint AS count FROM t CROSS JOIN b",
    "latency_quantiles": "WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value)) SELECT event_type, q, value FROM v JOIN (SELECT unnest([0.5, 0.9, 0.99]::double[]) AS q) ON i = round_even(q * (n - 1), 0)",
    "interpolated_quantiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1",
    "token_bucket": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        f AS (SELECT user_id, event_id, n, us, {16 * _H}::bigint AS level, true AS allowed FROM e WHERE n = 1
              UNION ALL
              SELECT e.user_id, e.event_id, e.n, e.us, CASE WHEN least({24 * _H}, level + e.us - f.us) >= {8 * _H} THEN least({24 * _H}, level + e.us - f.us) - {8 * _H} ELSE least({24 * _H}, level + e.us - f.us) END, least({24 * _H}, level + e.us - f.us) >= {8 * _H}
              FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
        SELECT user_id, event_id, allowed, CASE WHEN allowed THEN 0 ELSE {8 * _H} - level END::bigint AS retry_us FROM f""",
    "handoff_fold": f"""WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events WHERE event_type = 'error'),
        s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {72 * _H} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM e),
        n AS (SELECT event_id, (row_number() OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) - 1) % 3 + 1 AS count FROM s) SELECT event_id, count::int AS count, count = 3 AS fired FROM n""",
    "revoked_events": f"SELECT event_id, coalesce(epoch_us(ts) - epoch_us(max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) < {12 * _H}, false) AS revoked FROM events",
    "first_use": "SELECT user_id, event_type, arg_min(event_id, ts) AS event_id FROM events GROUP BY 1, 2",
    "as_of_view": "SELECT b.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON b.user_id = v.user_id AND b.ts >= v.ts",
    "tumbling_hours": "SELECT time_bucket(INTERVAL 6 hours, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*)::bigint AS events FROM events GROUP BY 1, 2",
    "sliding_hours": "SELECT start, count(*)::bigint AS events, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL 6 hours, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 hours * k AS start, value FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY 1",
    "user_sessions": f"WITH e AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {4 * _H} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS seg FROM e) SELECT user_id, min(ts) AS start, count(*)::bigint AS events, max(ts) AS last FROM s GROUP BY user_id, seg",
    "cube_flags": "SELECT l_returnflag, l_linestatus, count(*)::bigint AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup_ships": "SELECT year::int AS year, month::int AS month, count(*)::bigint AS lines FROM (SELECT year(l_shipdate) AS year, month(l_shipdate) AS month FROM lineitem) GROUP BY ROLLUP (year, month)",
    "pivot_status": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::bigint AS n_f, count(*) FILTER (o_orderstatus = 'O')::bigint AS n_o, count(*) FILTER (o_orderstatus = 'P')::bigint AS n_p FROM orders GROUP BY 1",
    "flags_common": "SELECT l_partkey FROM lineitem WHERE l_quantity > 25 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.05",
    "orders_left": "SELECT o_custkey, count(*)::bigint AS orders FROM orders WHERE NOT o_totalprice > 200000 GROUP BY 1",
    "recent_orders": "SELECT o_custkey, o_orderkey, nth FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::int AS nth FROM orders) WHERE nth <= 3",
    "ownership_check": "SELECT a.o_orderkey AS asked, a.who, coalesce(o.o_orderstatus, 'not found') AS status FROM (SELECT o_orderkey, o_custkey - o_orderkey % 3 AS who FROM orders WHERE o_orderkey % 20 = 0) a LEFT JOIN orders o ON o.o_orderkey = a.o_orderkey AND o.o_custkey = a.who WHERE a.who IN (SELECT c_custkey FROM customer)",
    "counter_rejections": "SELECT event_type, round(coalesce(sum(CASE WHEN value >= 30 THEN value - 30 END), 0), 4) AS total, sum(CASE WHEN value >= 30 THEN 0 ELSE 1 END)::bigint AS rejected FROM events GROUP BY 1",
    "principal_orders": "SELECT u.user_id, c.c_custkey AS customer, CASE WHEN c.c_custkey IS NOT NULL THEN (SELECT count(*) FROM orders WHERE o_custkey = c.c_custkey) END::bigint AS orders FROM (SELECT DISTINCT user_id, try_cast(substr(customer_id, 2) AS bigint) AS who FROM users WHERE user_id IS NOT NULL) u LEFT JOIN customer c ON c.c_custkey = u.who",
    "nested_orders": "SELECT l_orderkey, o_orderstatus, count(*)::bigint AS lines, round(sum(l_extendedprice * (1 - l_discount)), 4) AS net, datediff('day', any_value(o_orderdate), max(l_shipdate))::bigint AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2",
}
