"""Window and sequence queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quality, relational
from .base import query


@query("WIN_02_lag_interval", "WITH {LINES}, d AS (SELECT DISTINCT l_partkey, day FROM lines WHERE l_quantity > 25), g AS (SELECT l_partkey, day - lag(day) OVER (PARTITION BY l_partkey ORDER BY day) AS gap FROM d) SELECT l_partkey, round(avg(gap), 4) AS mean_gap FROM g GROUP BY 1 HAVING count(gap) > 0")
def _(t):
    d = t.lines.where("l_quantity > 25").select("l_partkey", "day").distinct()
    g = d.withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy("l_partkey").orderBy("day"))))
    return g.groupBy("l_partkey").agg(F.round(F.avg("gap"), 4).alias("mean_gap")).where("mean_gap IS NOT NULL")


@query("WIN_03_reorder_cadence", "WITH {LINES}, d AS (SELECT DISTINCT l_partkey, day FROM lines), g AS (SELECT l_partkey, day, day - lag(day) OVER (PARTITION BY l_partkey ORDER BY day) AS gap FROM d), f AS (SELECT l_partkey, count(*) AS n_days, avg(gap) AS m, DATE '2001-11-30' - max(day) AS since FROM g GROUP BY 1) SELECT l_partkey, n_days, since AS days_since, round(since / m, 6) AS urgency FROM f WHERE n_days >= 3 AND since / m >= 0.9")
def _(t):
    return quality.cadence(t.lines, "l_partkey", "day", "2001-11-30").select("l_partkey", "n_days", F.col("days_since").cast("long").alias("days_since"), F.round("urgency", 6).alias("urgency"))


@query("WIN_04_rolling_last_n", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events WHERE event_type = 'view') SELECT user_id, CASE WHEN count(*) >= 3 THEN round(avg(value), 6) END AS rate FROM r WHERE rn <= 10 GROUP BY 1")
def _(t):
    last = relational.top_k(t.events.where("event_type = 'view'"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10)
    return last.groupBy("user_id").agg(F.when(F.count("*") >= 3, F.round(F.avg("value"), 6)).alias("rate"))


@query("WIN_06_last_known", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS marker FROM events")
def _(t):
    value = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return relational.last_known(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], value, "marker").select("event_id", "marker")


@query("WIN_07_sessions", "WITH x AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM x) SELECT user_id, session::BIGINT AS session, count(*) AS n FROM s GROUP BY 1, 2")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = t.events.withColumn("fresh", F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL '30' MINUTE"), 0).otherwise(1))
    return x.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("WIN_09_share_of_total", "SELECT p_brand, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS share FROM part GROUP BY 1")
def _(t):
    return relational.share_of_total(t.part.groupBy("p_brand").agg(F.count("*").alias("n")), "n", "share")


@query("WIN_10_top_products", "WITH c AS (SELECT p_type, l_partkey, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) SELECT p_type, l_partkey, n, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, l_partkey) AS rank FROM c QUALIFY rank <= 3")
def _(t):
    c = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_type", "l_partkey").agg(F.count("*").alias("n"))
    return relational.top_k(c, ["p_type"], [F.desc("n"), F.col("l_partkey")], 3)


@query("WIN_11_running_headcount", "WITH s AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS d), e AS (SELECT CAST(ts AS DATE) AS d, sum(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END)::BIGINT AS delta FROM events GROUP BY 1) SELECT CAST(s.d AS VARCHAR) AS d, sum(coalesce(delta, 0)) OVER (ORDER BY s.d)::BIGINT AS headcount FROM s LEFT JOIN e ON e.d = s.d WHERE s.d BETWEEN (SELECT min(d) FROM e) AND (SELECT max(d) FROM e)")
def _(t):
    delta = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    e = t.events.groupBy(F.to_date("ts").alias("d")).agg(F.sum(delta).alias("delta"))
    days = relational.day_spine(e, "d").join(e, "d", "left")  # one row a day: a bounded window
    return days.select(F.col("d").cast("string").alias("d"), F.sum(F.coalesce("delta", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("d")).alias("headcount"))


@query("WIN_13_ranks", "SELECT s_suppkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS q FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000))")
def _(t):
    w = Window.partitionBy("s_nationkey").orderBy(F.floor(F.col("s_acctbal") / 1000))
    q = F.ntile(4).over(Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey"))
    return t.supplier.select("s_suppkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), q.cast("long").alias("q"))
