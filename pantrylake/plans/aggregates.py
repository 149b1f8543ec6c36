"""Aggregations, quality rules and business queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats, units
from ..operators import quality, relational
from .base import money, query


@query("AGG_01_group_count", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("AGG_02_sum_count_distinct", "WITH {LINES} SELECT l_suppkey, count(*) AS n, sum(ext)::DOUBLE AS spend, count(DISTINCT l_partkey) AS n_products FROM lines GROUP BY 1")
def _(t):
    return t.lines.groupBy("l_suppkey").agg(F.count("*").alias("n"), money("ext").alias("spend"), F.countDistinct("l_partkey").alias("n_products"))


@query("AGG_03_mean_and_max", "WITH {LINES} SELECT l_partkey, l_suppkey, round(avg(price), 4) AS mean_price, max(CAST(day AS VARCHAR)) AS last_day FROM lines WHERE day BETWEEN DATE '2001-05-01' AND DATE '2001-07-31' GROUP BY 1, 2")
def _(t):
    near = t.lines.where("day BETWEEN DATE'2001-05-01' AND DATE'2001-07-31'")
    return near.groupBy("l_partkey", "l_suppkey").agg(F.round(F.avg("price"), 4).alias("mean_price"), F.max("day").cast("string").alias("last_day"))


@query("AGG_04_global", "SELECT count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most, sum(l_quantity) AS total FROM lineitem")
def _(t):
    return t.lineitem.agg(F.count("*").alias("n"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.sum("l_quantity").alias("total"))


@query("AGG_05_having", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("AGG_06_filtered", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@query("AGG_07_outer_count", "SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 48) ON l_partkey = p_partkey GROUP BY 1")
def _(t):
    counts = t.lineitem.where("l_quantity > 48").groupBy("l_partkey").agg(F.count("*").alias("_n"))
    return t.part.join(counts, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce("_n", F.lit(0)).alias("n"))


@query("AGG_08_distinct_variants", "SELECT l_partkey, l_suppkey, count(DISTINCT CASE WHEN l_quantity > 10 THEN l_quantity END) AS variants FROM lineitem GROUP BY 1, 2")
def _(t):
    return t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.countDistinct(F.when(F.col("l_quantity") > 10, F.col("l_quantity"))).alias("variants"))


@query("AGG_09_mode_with_support", "WITH c AS (SELECT l_partkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY l_partkey)::BIGINT AS total, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_quantity) rn FROM c) SELECT l_partkey, l_quantity, n, total FROM r WHERE rn = 1 AND n >= 3 AND n >= 0.1 * total")
def _(t):
    return relational.mode_with_support(t.lineitem, ["l_partkey"], "l_quantity", 3, 0.1)


@query("AGG_10_mode_or_unanimous", "WITH c AS (SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT *, sum(n) OVER w AS total, count(*) OVER w AS k, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY n DESC, l_returnflag) rn FROM c WINDOW w AS (PARTITION BY l_partkey, l_suppkey)) SELECT l_partkey, l_suppkey, l_returnflag, CASE WHEN k = 1 THEN 'unanimous' WHEN n >= 0.7 * total AND n >= 2 THEN 'mode' ELSE 'ambiguous' END AS verdict FROM r WHERE rn = 1")
def _(t):
    w = Window.partitionBy("l_partkey", "l_suppkey")
    c = t.lineitem.groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    r = c.withColumn("total", F.sum("n").over(w)).withColumn("k", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "l_returnflag"))).where("rn = 1")
    return r.select("l_partkey", "l_suppkey", "l_returnflag", F.when(F.col("k") == 1, "unanimous").when((F.col("n") >= 0.7 * F.col("total")) & (F.col("n") >= 2), "mode").otherwise("ambiguous").alias("verdict"))


@query("AGG_11_exact_median", "WITH {LINES} SELECT l_partkey, median(price) AS median_price, count(*) AS n FROM lines GROUP BY 1 HAVING count(*) >= 4")
def _(t):
    return t.lines.groupBy("l_partkey").agg(F.median("price").alias("median_price"), F.count("*").alias("n")).where("n >= 4")


@query("AGG_12_quarter_month_rollup", "WITH {LINES}, d AS (SELECT quarter(day) AS q, month(day) AS m, ext FROM lines WHERE year(day) = 1998) SELECT q, m, count(*) AS n, sum(ext)::DOUBLE AS spend FROM d GROUP BY ROLLUP (q, m)")
def _(t):
    d = t.lines.where("day >= DATE'1998-01-01' AND day < DATE'1999-01-01'").select(F.quarter("day").cast("long").alias("q"), F.month("day").cast("long").alias("m"), "ext")
    return d.rollup("q", "m").agg(F.count("*").alias("n"), money("ext").alias("spend"))


@query("AGG_13_crosstab", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@query("AGG_14_contributors", "WITH {LINES} SELECT l_partkey, sum(ext)::DOUBLE AS spend, array_to_string(list_sort(list_distinct(list(c_mktsegment)))[1:3], ',') AS segments FROM lines JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def _(t):
    rows = t.lines.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy("l_partkey").agg(money("ext").alias("spend"), F.array_join(F.slice(F.sort_array(F.collect_set("c_mktsegment")), 1, 3), ",").alias("segments"))


@query("AGG_15_multi_unit_totals", "SELECT l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN 'oz' WHEN l_linenumber % 3 = 1 THEN 'floz' ELSE 'ct' END AS base, sum(l_quantity * CASE WHEN l_linenumber % 3 = 0 THEN 16 WHEN l_linenumber % 3 = 1 THEN 8 ELSE 12 END) AS total FROM lineitem GROUP BY 1, 2")
def _(t):
    unit = F.when(F.col("l_linenumber") % 3 == 0, "lb").when(F.col("l_linenumber") % 3 == 1, "cup").otherwise("doz")
    base = F.when(units.unit_kind(F.col("unit")) == "weight", "oz").when(units.unit_kind(F.col("unit")) == "volume", "floz").otherwise("ct")
    rows = t.lineitem.withColumn("unit", unit)
    return rows.groupBy("l_partkey", base.alias("base")).agg(F.sum(units.to_base(F.col("l_quantity"), F.col("unit"))).alias("total"))


@query("AGG_16_ratio_forms", "SELECT l_suppkey, round(sum(CAST(l_discount AS DECIMAL(9,2)) * CAST(l_quantity AS DECIMAL(9,2)))::DOUBLE / sum(CAST(l_quantity AS DECIMAL(9,2)))::DOUBLE, 6) AS ratio_of_sums, round(sum(CAST(l_discount AS DECIMAL(9,2)))::DOUBLE / count(*), 6) AS mean_of_ratios FROM lineitem GROUP BY 1")
def _(t):
    q, d = F.col("l_quantity").cast("decimal(9,2)"), F.col("l_discount").cast("decimal(9,2)")
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum(d * q).cast("double") / F.sum(q).cast("double"), 6).alias("ratio_of_sums"), F.round(F.sum(d).cast("double") / F.count("*"), 6).alias("mean_of_ratios"))


@query("AGG_18_age_buckets", "WITH {LINES}, m AS (SELECT p_partkey, max(day) AS last FROM part LEFT JOIN lines ON l_partkey = p_partkey AND l_quantity > 40 GROUP BY 1), a AS (SELECT DATE '2001-11-30' - last AS age FROM m) SELECT CASE WHEN age IS NULL THEN 'none' WHEN age <= 30 THEN 'fresh' WHEN age <= 90 THEN 'aging' WHEN age <= 365 THEN 'stale' ELSE 'cold' END AS bucket, count(*) AS n FROM a GROUP BY 1")
def _(t):
    last = t.lines.where("l_quantity > 40").groupBy("l_partkey").agg(F.max("day").alias("last"))
    age = F.datediff(F.lit("2001-11-30").cast("date"), "last")
    bucket = F.when(age.isNull(), "none").when(age <= 30, "fresh").when(age <= 90, "aging").when(age <= 365, "stale").otherwise("cold")
    return t.part.join(last, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("AGG_20_field_coverage", "SELECT source, count(*) AS n, count(*) FILTER (text IS NOT NULL AND text <> '') AS has_text, count(*) FILTER (lang IS NOT NULL AND lang <> '') AS has_lang FROM documents GROUP BY ROLLUP (source)")
def _(t):
    return quality.coverage(t.documents, "source", ["text", "lang"])


@query("AGG_21_majority_label", "WITH c AS (SELECT l_orderkey, s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) SELECT l_orderkey, s_nationkey, n FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, s_nationkey) = 1")
def _(t):
    c = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("l_orderkey", "s_nationkey").agg(F.count("*").alias("n"))
    return relational.latest_per_key(c, ["l_orderkey"], [F.desc("n"), F.col("s_nationkey")])


@query("AGG_22_dominance_rule", "SELECT l_orderkey, CASE WHEN count(*) FILTER (l_returnflag = 'N') >= 0.9 * count(*) THEN 'N' ELSE 'default' END AS account, count(DISTINCT l_returnflag) > 1 AS mixed FROM lineitem GROUP BY 1")
def _(t):
    flag = F.count_if(F.col("l_returnflag") == "N")
    return t.lineitem.groupBy("l_orderkey").agg(F.when(flag >= 0.9 * F.count("*"), "N").otherwise("default").alias("account"), (F.countDistinct("l_returnflag") > 1).alias("mixed"))


@query("AGG_23_wilson_interval", "WITH g AS (SELECT l_suppkey, count(*)::DOUBLE n, count(*) FILTER (l_returnflag = 'R')::DOUBLE h FROM lineitem GROUP BY 1), z AS (SELECT *, h / n p, 1.959963984540054 z FROM g) SELECT l_suppkey, round((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 6) AS high FROM z")
def _(t):
    g = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("h"))
    low, high = stats.wilson(F.col("h"), F.col("n"))
    return g.select("l_suppkey", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("AGG_24_first_last_change", "WITH {LINES} SELECT l_partkey, arg_min(price, (day, l_orderkey, l_linenumber, ext, l_quantity)) AS first_price, arg_max(price, (day, l_orderkey, l_linenumber, ext, l_quantity)) AS last_price FROM lines GROUP BY 1")
def _(t):
    key = F.struct("day", "l_orderkey", "l_linenumber", "ext", "l_quantity")
    return t.lines.groupBy("l_partkey").agg(F.min_by("price", key).alias("first_price"), F.max_by("price", key).alias("last_price"))


@query("AGG_25_conditional_credits", "WITH {LINES} SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN greatest(0, ext - 20000) ELSE 0 END)::DOUBLE AS credits FROM lines GROUP BY 1")
def _(t):
    return t.lines.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.greatest(F.lit(0), F.col("ext") - 20000)).otherwise(0)).cast("double").alias("credits"))


@query("AGG_26_agreement_rates", "WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber >= 3) SELECT count(*) FILTER (a.l_partkey IS NOT NULL AND b.l_partkey IS NOT NULL) AS matched, count(*) FILTER (b.l_partkey IS NULL) AS left_only, count(*) FILTER (a.l_partkey IS NULL) AS right_only FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey")
def _(t):
    a = t.lineitem.where("l_linenumber <= 4").select("l_orderkey", "l_partkey", F.lit(1).alias("a")).distinct()
    b = t.lineitem.where("l_linenumber >= 3").select("l_orderkey", "l_partkey", F.lit(1).alias("b")).distinct()
    return a.join(b, ["l_orderkey", "l_partkey"], "full_outer").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"))


@query("AGG_27_closest_path", "WITH {LINES}, s AS (SELECT l_orderkey, sum(ext)::DOUBLE a, sum(ext) FILTER (l_returnflag <> 'R')::DOUBLE b FROM lines GROUP BY 1) SELECT o_orderkey, CASE WHEN abs(a - o_totalprice) <= abs(coalesce(b, 0) - o_totalprice) THEN 'all' ELSE 'kept' END AS winner, round(abs(a - coalesce(b, 0)), 2) AS spread FROM orders JOIN s ON l_orderkey = o_orderkey")
def _(t):
    s = t.lines.groupBy("l_orderkey").agg(money("ext").alias("a"), F.coalesce(F.sum(F.when(F.col("l_returnflag") != "R", F.col("ext"))).cast("double"), F.lit(0.0)).alias("b"))
    total = F.col("o_totalprice")
    return t.orders.join(s, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.when(F.abs(F.col("a") - total) <= F.abs(F.col("b") - total), "all").otherwise("kept").alias("winner"), F.round(F.abs(F.col("a") - F.col("b")), 2).alias("spread"))


@query("AGG_28_dominant_prefix", "WITH c AS (SELECT p_brand, left(p_name, 1) AS pre, count(*) AS n FROM part GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS total FROM c) SELECT p_brand, pre, n FROM s WHERE n >= 0.1 * total AND n < total AND total - n >= 2")
def _(t):
    c = t.part.groupBy("p_brand", F.substring("p_name", 1, 1).alias("pre")).agg(F.count("*").alias("n"))
    return c.withColumn("total", F.sum("n").over(Window.partitionBy("p_brand"))).where("n >= 0.1 * total AND n < total AND total - n >= 2").select("p_brand", "pre", "n")


@query("AGG_29_clipped_rate", "SELECT l_suppkey, least(round_even(100.0::DOUBLE * count(*) FILTER (l_discount > 0.02) / count(*) FILTER (l_quantity > 20), 1), 100.0) AS rate FROM lineitem GROUP BY 1")
def _(t):
    g = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_discount") > 0.02).alias("a"), F.count_if(F.col("l_quantity") > 20).alias("b"))
    return g.select("l_suppkey", stats.percent_clipped(F.col("a"), F.col("b")).alias("rate"))


@query("AGG_31_month_series_by_type", "WITH {LINES}, m AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(day))::DATE FROM lines), (SELECT max(day) FROM lines), INTERVAL 1 MONTH))::DATE AS month), ty AS (SELECT DISTINCT p_type FROM part), s AS (SELECT p_type, date_trunc('month', day)::DATE AS month, sum(ext)::DOUBLE AS spend FROM lines JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) SELECT p_type, CAST(m.month AS VARCHAR) AS month, coalesce(spend, 0) AS spend FROM m CROSS JOIN ty LEFT JOIN s USING (p_type, month)")
def _(t):
    lines = t.lines
    spine = relational.month_spine(lines, "day").crossJoin(t.part.select("p_type").distinct())
    s = lines.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_type", F.trunc("day", "month").alias("month")).agg(money("ext").alias("spend"))
    return spine.join(s, ["p_type", "month"], "left").select("p_type", F.col("month").cast("string").alias("month"), F.coalesce("spend", F.lit(0.0)).alias("spend"))


@query("AGG_32_cube_and_sketch", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("DQ_01_upsert_merge", "WITH {LINES}, base AS (SELECT l_orderkey, l_partkey, max(ext)::DOUBLE ext, max(l_discount) d, bool_or(l_returnflag = 'R') edited FROM lines WHERE l_linenumber <= 4 GROUP BY 1, 2), inc AS (SELECT l_orderkey, l_partkey, max(ext)::DOUBLE ext, CASE WHEN max(l_discount) > 0.05 THEN max(l_discount) END d, false edited FROM lines WHERE l_linenumber >= 3 GROUP BY 1, 2) SELECT coalesce(b.l_orderkey, i.l_orderkey) AS l_orderkey, coalesce(b.l_partkey, i.l_partkey) AS l_partkey, CASE WHEN i.l_orderkey IS NULL OR (b.l_orderkey IS NOT NULL AND b.edited) THEN b.ext ELSE i.ext END AS ext, CASE WHEN i.l_orderkey IS NULL OR (b.l_orderkey IS NOT NULL AND b.edited) THEN b.d ELSE coalesce(i.d, b.d) END AS d FROM base b FULL JOIN inc i ON b.l_orderkey = i.l_orderkey AND b.l_partkey = i.l_partkey")
def _(t):
    key = ["l_orderkey", "l_partkey"]
    old = t.lines.where("l_linenumber <= 4").groupBy(*key).agg(F.max("ext").cast("double").alias("ext"), F.max("l_discount").alias("d"), F.bool_or(F.col("l_returnflag") == "R").alias("edited"))
    new = t.lines.where("l_linenumber >= 3").groupBy(*key).agg(F.max("ext").cast("double").alias("ext"), F.when(F.max("l_discount") > 0.05, F.max("l_discount")).alias("d"), F.lit(False).alias("edited"))
    return quality.merge_upsert(old, new, key, keep_old=F.col("o.edited"), fill=("d",)).drop("edited")


@query("DQ_04_price_anomaly", "WITH {LINES}, h AS (SELECT l_partkey, avg(price) m FROM lines WHERE day BETWEEN DATE '2001-05-01' AND DATE '2001-07-31' GROUP BY 1), n AS (SELECT l_partkey, l_orderkey, price FROM lines QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY day DESC, l_orderkey DESC, l_linenumber DESC, ext DESC, l_quantity DESC) = 1) SELECT n.l_partkey, price, CASE WHEN price > 5 * m AND price - m > 50 THEN 'leak' WHEN price > 2 * m OR price < 0.5 * m THEN 'drift' ELSE 'real' END AS class FROM n JOIN h ON h.l_partkey = n.l_partkey")
def _(t):
    h = t.lines.where("day BETWEEN DATE'2001-05-01' AND DATE'2001-07-31'").groupBy("l_partkey").agg(F.avg("price").alias("m"))
    n = relational.latest_per_key(t.lines, ["l_partkey"], [F.desc(c) for c in ("day", "l_orderkey", "l_linenumber", "ext", "l_quantity")])
    return n.join(h, "l_partkey").select("l_partkey", "price", stats.price_class(F.col("price"), F.col("m")).alias("class"))


@query("DQ_05_duplicate_collapse", "WITH {LINES} SELECT l_orderkey, l_linenumber, l_partkey, ext::DOUBLE AS ext FROM lines QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY ext DESC, l_quantity, l_partkey, l_suppkey) = 1")
def _(t):
    best = [F.desc("ext"), F.col("l_quantity"), F.col("l_partkey"), F.col("l_suppkey")]
    return quality.collapse_duplicates(t.lines, ["l_orderkey", "l_linenumber"], best).select("l_orderkey", "l_linenumber", "l_partkey", F.col("ext").cast("double").alias("ext"))


@query("DQ_08_not_in_parse", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem a WHERE l_quantity < 10 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey % 97 = a.l_partkey % 97 AND b.l_quantity >= 10)")
def _(t):
    seen = t.lineitem.where("l_quantity >= 10").select("l_orderkey", (F.col("l_partkey") % 97).alias("c")).distinct()
    return t.lineitem.where("l_quantity < 10").withColumn("c", F.col("l_partkey") % 97).join(seen, ["l_orderkey", "c"], "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("DQ_09_price_outliers", "WITH {LINES}, m AS (SELECT l_partkey, median(price) median, count(*) n FROM lines GROUP BY 1 HAVING count(*) >= 4) SELECT l_partkey, l_orderkey, l_linenumber, price FROM lines JOIN m USING (l_partkey) WHERE price < 0.2 * median OR price > 1.8 * median")
def _(t):
    return quality.median_outliers(t.lines, ["l_partkey"], "price", 4, 0.2, 1.8).select("l_partkey", "l_orderkey", "l_linenumber", "price")


@query("DQ_10_list_price_drift", "WITH {LINES} SELECT CASE WHEN abs(price / p_retailprice - 1) <= 0.02 THEN 'aligned' WHEN price > p_retailprice THEN 'over' ELSE 'under' END AS class, count(*) AS n FROM lines JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(t):
    r = F.col("price") / F.col("p_retailprice")
    return t.lines.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.when(F.abs(r - 1) <= 0.02, "aligned").when(r > 1, "over").otherwise("under").alias("class")).agg(F.count("*").alias("n"))


@query("DQ_13_invoice_status", "WITH {LINES}, s AS (SELECT l_orderkey, sum(ext)::DOUBLE items, sum(CASE WHEN l_returnflag = 'R' THEN ext ELSE 0 END)::DOUBLE credits FROM lines GROUP BY 1) SELECT CASE WHEN items IS NULL THEN 'empty' WHEN abs(o_totalprice - items) <= 0.5 OR abs(o_totalprice - items - credits) <= 0.5 OR abs(o_totalprice - items) <= o_totalprice * 0.01 THEN 'pass' WHEN abs(o_totalprice - items) <= o_totalprice * 0.05 THEN 'review' ELSE 'fail' END AS status, count(*) AS n FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    s = t.lines.groupBy("l_orderkey").agg(money("ext").alias("items"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("ext")).otherwise(0)).cast("double").alias("credits"))
    status = F.when(F.col("items").isNull(), "empty").otherwise(stats.invoice_status(F.col("items"), F.col("o_totalprice"), F.col("credits")))
    return t.orders.join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("DQ_15_health_verdict", "SELECT CASE WHEN a >= 0.9 AND b < 0.3 THEN 'green' WHEN a >= 0.5 THEN 'amber' ELSE 'red' END AS verdict FROM (SELECT avg((l_quantity > 2)::INT) a, avg((l_returnflag = 'R')::INT) b FROM lineitem)")
def _(t):
    x = t.lineitem.agg(F.avg((F.col("l_quantity") > 2).cast("int")).alias("a"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("b"))
    return x.select(F.when((F.col("a") >= 0.9) & (F.col("b") < 0.3), "green").when(F.col("a") >= 0.5, "amber").otherwise("red").alias("verdict"))


@query("ENT_08_unmapped_queue", "SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1, 2 HAVING count(*) >= 2")
def _(t):
    return t.lineitem.join(t.part.where("p_size > 10"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")).where("n >= 2")


@query("QRY_10_popularity_top_bottom", "WITH g AS (SELECT user_id, round(avg(value), 6) AS rate, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1 HAVING count(*) >= 3) (SELECT 'top' AS side, user_id, rate FROM g ORDER BY rate DESC, user_id LIMIT 10) UNION ALL (SELECT 'bottom', user_id, rate FROM g ORDER BY rate, user_id LIMIT 10)")
def _(t):
    g = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("rate"), F.count("*").alias("n")).where("n >= 3")
    side = lambda name, order: g.orderBy(order, "user_id").limit(10).select(F.lit(name).alias("side"), "user_id", "rate")
    return side("top", F.desc("rate")).unionByName(side("bottom", F.asc("rate")))


@query("QRY_14_leftover_ageing", "SELECT CASE WHEN age >= 5 THEN 'red' WHEN age >= 3 THEN 'amber' ELSE 'green' END AS color, count(*) AS n FROM (SELECT DATE '2024-01-20' - CAST(ts AS DATE) AS age FROM events WHERE event_type = 'purchase') WHERE age >= 0 GROUP BY 1")
def _(t):
    age = F.datediff(F.lit("2024-01-20").cast("date"), F.to_date("ts"))
    x = t.events.where("event_type = 'purchase'").select(age.alias("age")).where("age >= 0")
    return x.groupBy(F.when(F.col("age") >= 5, "red").when(F.col("age") >= 3, "amber").otherwise("green").alias("color")).agg(F.count("*").alias("n"))


@query("QRY_23_readiness_checklist", "SELECT 'parts without a line' AS item, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT 'orders without a line', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'negative balances', count(*) FROM customer WHERE c_acctbal < 0")
def _(t):
    item = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
    return item("parts without a line", t.part.join(t.lineitem, F.col("l_partkey") == F.col("p_partkey"), "left_anti")).unionByName(item("orders without a line", t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"))).unionByName(item("negative balances", t.customer.where("c_acctbal < 0")))
