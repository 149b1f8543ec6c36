"""Further scalar functions, quality rules and business queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, stats, text, units
from .base import query

NEXT = "(SELECT a.p_partkey, list_distinct(regexp_extract_all(lower(a.p_name), '[a-z]+')) x, list_distinct(regexp_extract_all(lower(b.p_name), '[a-z]+')) y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 64)"


def _beside(t):
    """Each part's words x beside the words y of the part 64 keys on."""
    b = t.part.select((F.col("p_partkey") - 64).alias("p_partkey"), text.words(F.col("p_name")).alias("y"))
    return t.part.select("p_partkey", text.words(F.col("p_name")).alias("x")).join(b, "p_partkey")


@query("STR_11_overlap_gate", f"SELECT p_partkey, list_has_any(x, y) AS shared FROM {NEXT}")
def _(t):
    return _beside(t).select("p_partkey", F.arrays_overlap("x", "y").alias("shared"))


@query("STR_12_missing_qualifier", f"SELECT p_partkey, len(list_filter(list_intersect(x, ['red', 'small', 'large']), lambda w: NOT list_contains(y, w))) > 0 AS missing FROM {NEXT}")
def _(t):
    return _beside(t).select("p_partkey", text.missing_qualifier(F.col("x"), F.col("y"), ["red", "small", "large"]).alias("missing"))


@query("STR_20_vendor_detection", "SELECT s_suppkey, CASE WHEN contains(s_name, '00001') THEN 'first' WHEN contains(s_name, '2') THEN 'second' ELSE 'unknown' END AS vendor FROM supplier")
def _(t):
    name = F.col("s_name")
    return t.supplier.select("s_suppkey", F.when(F.contains(name, F.lit("00001")), "first").when(F.contains(name, F.lit("2")), "second").otherwise("unknown").alias("vendor"))


@query("STR_26_fraction", "WITH x AS (SELECT p_partkey, p_size, p_size % 12 AS r, CASE WHEN p_size >= 12 THEN (p_size // 12)::VARCHAR || ' ' ELSE '' END AS w FROM part) SELECT p_partkey, CASE r WHEN 0 THEN (p_size // 12)::VARCHAR WHEN 3 THEN w || '1/4' WHEN 4 THEN w || '1/3' WHEN 6 THEN w || '1/2' WHEN 8 THEN w || '2/3' WHEN 9 THEN w || '3/4' ELSE printf('%.2f', p_size / 12.0::DOUBLE) END AS shown FROM x")
def _(t):
    return t.part.select("p_partkey", text.nearest_fraction(F.col("p_size") / 12).alias("shown"))


@query("DAT_05_day_difference", "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS age FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("o_orderdate")).cast("long").alias("age"))


@query("DAT_06_date_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS d FROM orders")
def _(t):
    d = F.to_date("o_orderdate")
    s = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "MM/dd/yyyy")).otherwise("soon")
    return t.orders.select("o_orderkey", dates.parse_date(s, ("yyyy-MM-dd", "MM/dd/yyyy")).cast("string").alias("d"))


@query("DAT_07_plausible_date", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1998-06-01' - 548 AND DATE '1998-06-01' + 7 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS d FROM orders")
def _(t):
    return t.orders.select("o_orderkey", dates.plausible(F.to_date("o_orderdate"), F.lit("1998-06-01").cast("date")).cast("string").alias("d"))


@query("DAT_09_week_label", "SELECT 'Week ' || ceil(day(o_orderdate) / 7)::BIGINT AS label, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy(dates.week_of_month(F.to_date("o_orderdate")).alias("label")).agg(F.count("*").alias("n"))


@query("MTH_02_clamp", "SELECT o_orderkey, least(greatest(o_totalprice, 1000), 250000) AS clamped FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.least(F.greatest("o_totalprice", F.lit(1000)), F.lit(250000)).alias("clamped"))


@query("MTH_03_interpolation", "SELECT p_partkey, round(100 + (p_size - 1) * (300 - 100) / 49.0::DOUBLE, 6) AS y FROM part")
def _(t):
    return t.part.select("p_partkey", F.round(100 + (F.col("p_size") - 1) * (300 - 100) / F.lit(49.0), 6).alias("y"))


@query("ARR_03_reverse_scan", "SELECT p_partkey, string_split(p_name, ' ')[-1] AS last, len(string_split(p_name, ' ')) AS n FROM part")
def _(t):
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", F.element_at(F.reverse(words), 1).alias("last"), F.size(words).cast("long").alias("n"))


@query("DQ_02_field_merge", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_brand WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS field FROM part")
def _(t):
    new = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))
    return t.part.select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).otherwise(F.coalesce(new, "p_brand")).alias("field"))


@query("DQ_03_placeholder_supersede", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem x WHERE NOT (l_quantity = 1 AND EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber AND y.l_quantity > 1))")
def _(t):
    real = t.lineitem.where("l_quantity > 1").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    gone = (F.col("l_quantity") == 1) & (F.col("l_orderkey") == F.col("o")) & (F.col("l_linenumber") == F.col("n"))
    return t.lineitem.join(real, gone, "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("DQ_07_survivor_of_code", "SELECT l_orderkey, l_partkey, max(l_quantity) AS kept, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    return t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("kept"), F.count("*").alias("n"))


@query("DQ_14_rule_audit", "SELECT 'no size' AS rule, 'high' AS severity, count(*) AS n FROM part WHERE p_size <= 0 UNION ALL SELECT 'small', 'low', count(*) FROM part WHERE p_size < 5 UNION ALL SELECT 'dear', 'high', count(*) FROM part WHERE p_retailprice > 950")
def _(t):
    rules = (("no size", "high", F.col("p_size") <= 0), ("small", "low", F.col("p_size") < 5), ("dear", "high", F.col("p_retailprice") > 950))
    one = t.part.agg(*[F.count_if(c).alias(f"r{i}") for i, (_, _, c) in enumerate(rules)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("rule"), F.lit(b).alias("severity"), F.col(f"r{i}").alias("n")) for i, (a, b, _) in enumerate(rules)]))
    return one.select(rows.alias("x")).select("x.*")


@query("JOI_16_as_of_position", "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_quantity > 40 THEN l_partkey END AS head FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, last_value(head IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) AS section FROM x")
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.last(F.when(F.col("l_quantity") > 40, F.col("l_partkey")), ignorenulls=True).over(w).alias("section"))


@query("QRY_07_price_alerts", "WITH {LINES}, m AS (SELECT l_partkey, avg(price) AS mean FROM lines GROUP BY 1), r AS (SELECT CASE WHEN price > 5 * mean AND price - mean > 50 THEN 'leak' WHEN price > 2 * mean OR price < 0.5 * mean THEN 'drift' ELSE 'real' END AS class FROM lines JOIN m USING (l_partkey)) SELECT class, count(*) AS n FROM r GROUP BY 1")
def _(t):
    mean = t.lines.groupBy("l_partkey").agg(F.avg("price").alias("mean"))
    return t.lines.join(mean, "l_partkey").groupBy(stats.price_class(F.col("price"), F.col("mean")).alias("class")).agg(F.count("*").alias("n"))


@query("QRY_08_pipeline_health", "SELECT count(*) AS lines, count(*) FILTER (l_discount > 0) AS mapped, least(100.0, round(100.0 * count(*) FILTER (l_discount > 0) / count(*), 1)) AS rate FROM lineitem")
def _(t):
    n = t.lineitem.agg(F.count("*").alias("lines"), F.count_if(F.col("l_discount") > 0).alias("mapped"))
    return n.select("lines", "mapped", stats.percent_clipped(F.col("mapped"), F.col("lines")).alias("rate"))


@query("QRY_15_missing_quantities", "SELECT l_suppkey, count(*) FILTER (l_quantity <= 1) AS missing, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_quantity <= 1) > 0")
def _(t):
    g = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_quantity") <= 1).alias("missing"), F.count("*").alias("n"))
    return g.where("missing > 0")


@query("QRY_20_stale_prices", "WITH a AS (SELECT l_partkey, date_diff('day', max(CAST(l_shipdate AS DATE)), DATE '2002-01-01') AS age FROM lineitem GROUP BY 1) SELECT CASE WHEN age < 30 THEN 'fresh' WHEN age < 180 THEN 'aging' ELSE 'stale' END AS bucket, count(*) AS n FROM a GROUP BY 1")
def _(t):
    age = t.lineitem.groupBy("l_partkey").agg(F.datediff(F.lit("2002-01-01").cast("date"), F.max(F.to_date("l_shipdate"))).alias("age"))
    return age.groupBy(F.when(F.col("age") < 30, "fresh").when(F.col("age") < 180, "aging").otherwise("stale").alias("bucket")).agg(F.count("*").alias("n"))


@query("QRY_22_review_queue", "SELECT p_partkey, sum(l_quantity) AS spend FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 ORDER BY spend DESC NULLS LAST, p_partkey LIMIT 50")
def _(t):
    spend = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("spend"))
    return t.part.join(spend, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", "spend").orderBy(F.desc_nulls_last("spend"), "p_partkey").limit(50)


@query("LAY_08_tilt", "WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, median(l_quantity - k) AS tilt FROM r WHERE n >= 3 GROUP BY 1")
def _(t):
    own = Window.partitionBy("l_orderkey")
    r = t.lineitem.select("l_orderkey", "l_quantity", F.row_number().over(own.orderBy("l_quantity", "l_linenumber", "l_partkey")).alias("k"), F.count("*").over(own).alias("n"))
    return r.where("n >= 3").groupBy("l_orderkey").agg(F.median(F.col("l_quantity") - F.col("k")).alias("tilt"))


@query("LAY_09_page_key", "SELECT p_partkey, coalesce(nullif(regexp_extract(p_name || ' Page ' || p_size, 'Page ([0-9]+)', 1), '')::BIGINT, 1) AS page FROM part")
def _(t):
    s = F.concat("p_name", F.lit(" Page "), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", F.coalesce(F.nullif(F.regexp_extract(s, "Page ([0-9]+)", 1), F.lit("")).cast("long"), F.lit(1)).alias("page"))
