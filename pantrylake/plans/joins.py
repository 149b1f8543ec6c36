"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy, text
from ..operators import recursive, relational, similarity
from .base import query


@query("JOI_01_left_outer_dimension", "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 10")
def _(t):
    return t.supplier.join(t.nation.where("n_nationkey < 10"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", "s_name", "n_name")


@query("JOI_02_child_rows", "SELECT o_orderkey, count(l_linenumber) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_linenumber").alias("n_lines"))


@query("JOI_03_main_and_bridge", "SELECT DISTINCT k, p FROM (SELECT o_orderkey k, o_orderkey % 50 p FROM orders UNION ALL SELECT l_orderkey, l_partkey FROM lineitem)")
def _(t):
    main = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 50).alias("p"))
    return main.unionByName(t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"))).dropDuplicates(["k", "p"])


@query("JOI_04_left_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("JOI_05_left_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(t):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("JOI_06_composite_semi", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 4)")
def _(t):
    often = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n >= 4")
    return t.lineitem.join(often, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("JOI_07_null_safe_anti", "WITH r AS (SELECT DISTINCT p_brand, CASE WHEN p_size > 40 THEN NULL ELSE p_type END AS ty FROM part WHERE p_partkey % 5 = 0) SELECT p_partkey FROM (SELECT p_partkey, p_brand, CASE WHEN p_size > 40 THEN NULL ELSE p_type END AS ty FROM part) x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.p_brand = x.p_brand AND r.ty IS NOT DISTINCT FROM x.ty)")
def _(t):
    x = t.part.select("p_partkey", "p_brand", F.when(~(F.col("p_size") > 40), F.col("p_type")).alias("ty"))
    r = x.where("p_partkey % 5 = 0").select(F.col("p_brand").alias("rb"), F.col("ty").alias("rt")).distinct()
    return x.join(r, (F.col("p_brand") == F.col("rb")) & F.col("ty").eqNullSafe(F.col("rt")), "left_anti").select("p_partkey")


@query("JOI_08_multi_way_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 30) AND p_partkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)")
def _(t):
    part = t.part.select("p_partkey")
    for other in (t.lineitem.where("l_quantity = 50").select("l_partkey"), t.lineitem.where("l_discount > 0.09 AND l_quantity > 30").select("l_partkey"), t.orders.where("o_totalprice > 400000").select("o_orderkey")):
        part = part.join(other, part.p_partkey == other[0], "left_anti")
    return part


@query("JOI_09_lookup_with_default", "WITH c AS (SELECT CAST(o_orderdate AS DATE) d, count(*) n FROM orders GROUP BY 1), e AS (SELECT DISTINCT CAST(ts AS DATE) d FROM events) SELECT CAST(e.d AS VARCHAR) AS d, coalesce(c.n, (SELECT arg_max(n, d) FROM c), 40) AS headcount FROM e LEFT JOIN c ON c.d = e.d")
def _(t):
    c = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    latest = c.agg(F.max_by("n", "d").alias("latest"))
    days = t.events.select(F.to_date("ts").alias("d")).distinct()
    return days.join(c, "d", "left").crossJoin(F.broadcast(latest)).select(F.col("d").cast("string").alias("d"), F.coalesce("n", "latest", F.lit(40)).alias("headcount"))


@query("JOI_10_as_of_scalar", "SELECT arg_max(n, d) AS headcount FROM (SELECT CAST(o_orderdate AS DATE) d, count(*) n FROM orders WHERE o_orderdate <= TIMESTAMP '1998-03-01' GROUP BY 1)")
def _(t):
    c = t.orders.where("o_orderdate <= TIMESTAMP_NTZ'1998-03-01'").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    return c.agg(F.max_by("n", "d").alias("headcount"))


@query("JOI_10_as_of_join", "SELECT event_id, user_id, (SELECT e2.value FROM events e2 WHERE e2.user_id = e.user_id AND e2.event_type = 'view' AND e2.ts <= e.ts ORDER BY e2.ts DESC, e2.event_id DESC LIMIT 1) AS last_view FROM events e WHERE event_type = 'purchase'")
def _(t):
    buys = t.events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    views = relational.latest_per_key(t.events.where("event_type = 'view'"), ["user_id", "ts"], [F.desc("event_id")]).select("user_id", "ts", F.col("value").alias("last_view"))
    return relational.as_of_join(buys, views, ["user_id"], "ts", ["last_view"]).select("event_id", "user_id", "last_view")


@query("JOI_11_latest_row", "WITH {LINES} SELECT l_partkey, l_orderkey, price FROM lines QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY day DESC, l_orderkey DESC, l_linenumber DESC, ext DESC, l_quantity DESC) = 1")
def _(t):
    order = [F.desc(c) for c in ("day", "l_orderkey", "l_linenumber", "ext", "l_quantity")]
    return relational.latest_per_key(t.lines, ["l_partkey"], order).select("l_partkey", "l_orderkey", "price")


@query("JOI_12_latest_qualifying", "WITH {LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY day DESC, l_orderkey DESC, l_linenumber DESC, ext DESC, l_quantity DESC) rn FROM lines) SELECT l_partkey, l_orderkey, l_quantity FROM n WHERE rn <= 5 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY (l_quantity >= 30) DESC, rn) = 1")
def _(t):
    order = [F.desc(c) for c in ("day", "l_orderkey", "l_linenumber", "ext", "l_quantity")]
    return relational.latest_qualifying(t.lines, ["l_partkey"], order, 5, F.col("l_quantity") >= 30).select("l_partkey", "l_orderkey", "l_quantity")


@query("JOI_13_key_with_fallback", "WITH a AS (SELECT l_orderkey k, count(*) n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey c, count(*) n FROM orders GROUP BY 1) SELECT o_orderkey, coalesce(a.n, b.n) AS n FROM orders LEFT JOIN a ON a.k = o_orderkey LEFT JOIN b ON b.c = o_custkey")
def _(t):
    a = t.lineitem.where("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("na"))
    b = t.orders.groupBy(F.col("o_custkey").alias("c")).agg(F.count("*").alias("nb"))
    return t.orders.join(a, F.col("k") == F.col("o_orderkey"), "left").join(b, F.col("c") == F.col("o_custkey"), "left").select("o_orderkey", F.coalesce("na", "nb").alias("n"))


@query("JOI_15_band_join", "WITH h AS (SELECT user_id, ts a, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) b, event_id h FROM events WHERE event_type = 'signup') SELECT e.event_id, h.h AS header FROM events e JOIN h ON h.user_id = e.user_id AND e.ts >= h.a AND (h.b IS NULL OR e.ts < h.b) WHERE e.event_type = 'click'")
def _(t):
    heads = relational.latest_per_key(t.events.where("event_type = 'signup'"), ["user_id", "ts"], [F.desc("event_id")]).select("user_id", "ts", F.col("event_id").alias("header"))
    points = t.events.where("event_type = 'click'").select("user_id", "ts", "event_id")
    return relational.band_join(points, heads, ["user_id"], "ts", "header").where("header IS NOT NULL").select("event_id", "header")


@query("JOI_18_positional_zip", "WITH a AS (SELECT user_id, event_id x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM events WHERE event_type = 'click') SELECT user_id, k, x, y FROM a JOIN b USING (user_id, k)")
def _(t):
    side = lambda kind, name: t.events.where(F.col("event_type") == kind).select("user_id", "ts", "event_id", F.col("event_id").alias(name))
    order = [F.col("ts"), F.col("event_id")]
    return relational.zip_join(side("view", "x"), side("click", "y").withColumnRenamed("ts", "ts2").withColumnRenamed("event_id", "id2"), ["user_id"], order, [F.col("ts2"), F.col("id2")]).select("user_id", "k", "x", "y")


def _token_subset(t, events):
    names = t.part.select("p_name").distinct().withColumn("t", text.words(F.col("p_name")))
    p = lambda m, col, name: t.part.select(F.col("p_partkey").alias(f"k{m}"), F.col(col).alias(name))
    raw = events.select("event_id")
    for m, col, name in ((200, "p_name", "x"), (7, "p_type", "y"), (11, "p_name", "z")):
        raw = raw.join(p(m, col, name), F.col("event_id") % m == F.col(f"k{m}")).drop(f"k{m}")
    raw = raw.select("event_id", text.words(F.concat_ws(" ", "x", "y", "z")).alias("rt"))
    return similarity.subset_match(raw, names, "event_id", "p_name", "rt", "t")


@query("JOI_27_no_shared_token", "SELECT l.p_partkey AS a FROM part l JOIN part r ON r.p_partkey = l.p_partkey + 1 WHERE NOT list_has_any(regexp_extract_all(lower(l.p_name), '[a-z]+'), regexp_extract_all(lower(r.p_name), '[a-z]+'))")
def _(t):
    left = t.part.select(F.col("p_partkey").alias("a"), text.words(F.col("p_name")).alias("x"))
    right = t.part.select((F.col("p_partkey") - 1).alias("a"), text.words(F.col("p_name")).alias("y"))
    return left.join(right, "a").where(~F.arrays_overlap("x", "y")).select("a")


@query("JOI_28_rule_table", "WITH r(ty, lo, hi) AS (VALUES ('ECONOMY', 1, 20), ('STANDARD', 1, 30), ('PROMO', 10, 50)) SELECT p_partkey, p_type FROM part JOIN r ON contains(p_type, ty) WHERE p_size NOT BETWEEN lo AND hi")
def _(t):
    rules = t.spark.createDataFrame([("ECONOMY", 1, 20), ("STANDARD", 1, 30), ("PROMO", 10, 50)], "ty string, lo int, hi int")
    return t.part.join(F.broadcast(rules), F.contains(F.col("p_type"), F.col("ty"))).where("p_size NOT BETWEEN lo AND hi").select("p_partkey", "p_type")


@query("JOI_30_full_outer_reconciliation", "WITH {LINES}, a AS (SELECT l_orderkey k, sum(ext)::DOUBLE items FROM lines WHERE l_orderkey % 10 < 7 GROUP BY 1), b AS (SELECT o_orderkey k, o_totalprice total FROM orders WHERE o_orderkey % 10 > 2) SELECT k, coalesce(items, 0) AS items, coalesce(total, 0) AS total, CASE WHEN items IS NULL THEN 'right only' WHEN total IS NULL THEN 'left only' ELSE 'both' END AS side, round(coalesce(items, 0) - coalesce(total, 0), 2) AS gap FROM a FULL JOIN b USING (k)")
def _(t):
    from ..operators.quality import reconcile

    a = t.lines.where("l_orderkey % 10 < 7").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("ext").cast("double").alias("items"))
    b = t.orders.where("o_orderkey % 10 > 2").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"))
    return reconcile(a, b, ["k"], "items", "total")


@query("JOI_31_cross_source_duplicates", "SELECT md5(text) AS h, count(DISTINCT source) AS n_sources, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def _(t):
    return t.documents.groupBy(F.md5("text").alias("h")).agg(F.countDistinct("source").alias("n_sources"), F.count("*").alias("n")).where("n_sources > 1")
