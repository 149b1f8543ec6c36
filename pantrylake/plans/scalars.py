"""Scalar functions over the driver's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, stats, text, units
from .base import query


@query("STR_01_description_key", "SELECT p_partkey, upper(trim(regexp_replace(replace(p_name || '/' || p_type, '/', ' '), '\\s+', ' ', 'g'))) AS key FROM part")
def _(t):
    return t.part.select("p_partkey", text.description_key(F.concat_ws("/", "p_name", "p_type")).alias("key"))


@query("STR_02_dedup_key", "SELECT p_partkey, upper(regexp_replace(regexp_replace(trim('x ' || p_name), '^[A-Za-z]\\s+', ''), '\\s+', '', 'g')) AS key FROM part")
def _(t):
    return t.part.select("p_partkey", text.dedup_key(F.concat(F.lit("x "), "p_name")).alias("key"))


@query("STR_05_token_set", "SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(p_name || ' 10/20'), '[A-Z][A-Z]+|[0-9]+(?:[/.,%-][0-9]+)*%?'))), ' ') AS tokens FROM part")
def _(t):
    return t.part.select("p_partkey", F.array_join(F.sort_array(text.tokens(F.concat("p_name", F.lit(" 10/20")))), " ").alias("tokens"))


@query("STR_13_jaccard", "WITH a AS (SELECT a.p_partkey, list_distinct(regexp_extract_all(lower(a.p_name), '[a-z]+')) x, list_distinct(regexp_extract_all(lower(b.p_name), '[a-z]+')) y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 64) SELECT p_partkey, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS score FROM a")
def _(t):
    b = t.part.select((F.col("p_partkey") - 64).alias("p_partkey"), text.words(F.col("p_name")).alias("y"))
    return t.part.join(b, "p_partkey").select("p_partkey", text.jaccard(text.words(F.col("p_name")), F.col("y")).alias("score"))


@query("UNT_19_as_purchased", "SELECT p_partkey, CASE WHEN p_size > 5 THEN 10 / (p_size / 100.0::DOUBLE) ELSE 10.0 END AS quantity FROM part")
def _(t):
    return t.part.select("p_partkey", units.as_purchased(F.lit(10.0), F.when(F.col("p_size") > 5, F.col("p_size").cast("double"))).alias("quantity"))


@query("UNT_22_line_math", "WITH {LINES} SELECT l_orderkey, l_linenumber, l_partkey, abs(l_quantity * 1000 - ext::DOUBLE) > 2 AND abs(l_quantity * 1000 - ext::DOUBLE) / ext::DOUBLE * 100 > 5 AND NOT (round(ext::DOUBLE / 1000) BETWEEN 1 AND 50 AND abs(round(ext::DOUBLE / 1000) * 1000 - ext::DOUBLE) <= 0.1) AS flagged FROM lines")
def _(t):
    x = t.lines.withColumn("m", units.line_math(F.col("l_quantity"), F.lit(1000.0), F.col("ext").cast("double")))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.col("m.flagged").alias("flagged"))


@query("DAT_01_month_bounds", "SELECT DISTINCT CAST(date_trunc('month', o_orderdate)::DATE AS VARCHAR) AS first, CAST(last_day(o_orderdate) AS VARCHAR) AS last, CAST((date_trunc('month', o_orderdate) - INTERVAL 2 MONTH)::DATE AS VARCHAR) AS before FROM orders")
def _(t):
    d = F.to_date("o_orderdate")
    return t.orders.select(F.trunc(d, "month").cast("string").alias("first"), F.last_day(d).cast("string").alias("last"), F.add_months(F.trunc(d, "month"), -2).cast("string").alias("before")).distinct()


@query("DAT_02_biweekly_bucket", "SELECT CAST((DATE '2026-01-05' + CAST(floor((CAST(o_orderdate AS DATE) - DATE '2026-01-05') / 14.0) AS INT) * 14) AS VARCHAR) AS bucket, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(dates.biweekly_bucket(F.to_date("o_orderdate")).cast("string").alias("bucket")).agg(F.count("*").alias("n"))


@query("DAT_03_weekday_rule", "SELECT isodow(o_orderdate) - 1 AS weekday, count(*) AS n, CASE WHEN isodow(o_orderdate) >= 6 THEN 2 ELSE 3 END AS slots FROM orders GROUP BY 1, 3")
def _(t):
    w = F.weekday("o_orderdate").cast("long")
    return t.orders.groupBy(w.alias("weekday"), F.when(w >= 5, 2).otherwise(3).alias("slots")).agg(F.count("*").alias("n"))


@query("DAT_04_prep_date", "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT CAST(d AS VARCHAR) AS d, CAST(d - CASE isodow(d) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS VARCHAR) AS prep FROM d")
def _(t):
    d = t.orders.select(F.to_date("o_orderdate").alias("d")).distinct()
    return d.select(F.col("d").cast("string").alias("d"), dates.prep_date(F.col("d")).cast("string").alias("prep"))


@query("DAT_08_elapsed_share", "SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, round(day(o_orderdate) / day(last_day(o_orderdate)), 6) AS share FROM orders")
def _(t):
    d = F.to_date("o_orderdate")
    return t.orders.select(d.cast("string").alias("d"), F.round(dates.elapsed_share(d), 6).alias("share")).distinct()


@query("MTH_01_guarded_division", "SELECT l_suppkey, CASE WHEN count(*) FILTER (l_quantity > 49) = 0 THEN 0 ELSE round(count(*) FILTER (l_returnflag = 'R') / count(*) FILTER (l_quantity > 49), 4) END AS ratio FROM lineitem GROUP BY 1")
def _(t):
    g = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_quantity") > 49).alias("b"))
    return g.select("l_suppkey", F.round(stats.ratio(F.col("a"), F.col("b")), 4).alias("ratio"))


@query("MTH_04_histogram_peaks", "WITH h AS (SELECT floor(o_totalprice / 20000)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1) SELECT bin, n FROM h a WHERE n > coalesce((SELECT n FROM h b WHERE b.bin = a.bin - 1), 0) AND n >= coalesce((SELECT n FROM h b WHERE b.bin = a.bin + 1), 0)")
def _(t):
    h = t.orders.groupBy(F.floor(F.col("o_totalprice") / 20000).alias("bin")).agg(F.count("*").alias("n"))
    near = lambda step, name: h.select((F.col("bin") + step).alias("bin"), F.col("n").alias(name))
    x = h.join(near(1, "below"), "bin", "left").join(near(-1, "above"), "bin", "left")
    return x.where((F.col("n") > F.coalesce("below", F.lit(0))) & (F.col("n") >= F.coalesce("above", F.lit(0)))).select("bin", "n")


@query("ARR_01_sorted_head", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_suppkey)))[1:3], ',') AS vendors FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.slice(F.sort_array(F.collect_set("l_suppkey")), 1, 3).cast("array<string>"), ",").alias("vendors"))


@query("ARR_02_union_of_arrays", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(flatten(list([l_returnflag, l_linestatus])))), '') AS flags FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("l_returnflag", "l_linestatus"))))), "").alias("flags"))


@query("MAP_01_lookup_with_default", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS code FROM customer")
def _(t):
    table = F.create_map(F.lit("BUILDING"), F.lit(1), F.lit("MACHINERY"), F.lit(2))
    return t.customer.select("c_custkey", F.coalesce(F.try_element_at(table, F.col("c_mktsegment")), F.lit(0)).alias("code"))


@query("JSN_01_json_field", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.sum(F.from_json("props", "k long")["k"]).alias("total"))


@query("JSN_02_array_update", "SELECT user_id, array_to_string(list_transform(list_sort(list(CAST(json_extract_string(props, '$.k') AS BIGINT))), lambda x: x + 1), ',') AS ks FROM events WHERE event_type = 'error' GROUP BY 1")
def _(t):
    ks = F.sort_array(F.collect_list(F.from_json("props", "k long")["k"]))
    return t.events.where("event_type = 'error'").groupBy("user_id").agg(F.array_join(F.transform(ks, lambda x: x + 1).cast("array<string>"), ",").alias("ks"))
