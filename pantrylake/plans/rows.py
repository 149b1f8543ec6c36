"""Scans, projections, predicates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relational import not_true
from .base import query


@query("SRC_01_table_scan", "SELECT p_partkey, p_name, p_brand FROM part")
def _(t):
    return t.part.select("p_partkey", "p_name", "p_brand")


@query("PRJ_01_column_projection", "SELECT s_suppkey AS vendor_id, s_name AS vendor, n_name AS nation FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(t):
    return t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor"), F.col("n_name").alias("nation"))


@query("PRJ_02_computed_column", "SELECT p_partkey, lower(p_name) AS lc FROM part")
def _(t):
    return t.part.select("p_partkey", F.lower("p_name").alias("lc"))


@query("PRJ_03_distinct_projection", "SELECT DISTINCT p_brand, p_type, p_size FROM part")
def _(t):
    return t.part.select("p_brand", "p_type", "p_size").distinct()


@query("FLT_01_comparisons", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 200000 AND o_orderstatus = 'F'")
def _(t):
    return t.orders.where("o_totalprice > 1000 AND o_totalprice <= 200000 AND o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("FLT_02_null_predicates", "SELECT count(*) FILTER (c_mktsegment IS NULL) AS missing, count(*) FILTER (c_mktsegment IS NOT NULL) AS present FROM customer")
def _(t):
    return t.customer.agg(F.count_if(F.col("c_mktsegment").isNull()).alias("missing"), F.count_if(F.col("c_mktsegment").isNotNull()).alias("present"))


@query("FLT_03_membership", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def _(t):
    return t.part.where(F.col("p_size").isin(1, 5, 9)).join(t.lineitem.where("l_quantity >= 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("FLT_04_negation_keeps_null", "WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS st FROM orders) SELECT o_orderkey FROM x WHERE st IS DISTINCT FROM 'F'")
def _(t):
    x = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("st"))
    return x.where(not_true(F.col("st") == "F")).select("o_orderkey")


@query("FLT_05_disjunction", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
def _(t):
    return t.customer.where((F.col("c_acctbal") < 0) | (F.col("c_mktsegment") == "BUILDING")).select("c_custkey")


@query("FLT_06_case_insensitive", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 're') OR lower(p_brand) = 'brand#12'")
def _(t):
    return t.part.where(F.contains(F.lower("p_name"), F.lit("re")) | (F.lower("p_brand") == "brand#12")).select("p_partkey")


@query("FLT_07_prefix", "SELECT p_partkey FROM part WHERE starts_with(p_type, 'S') OR starts_with(p_type, 'P')")
def _(t):
    return t.part.where(F.startswith("p_type", F.lit("S")) | F.startswith("p_type", F.lit("P"))).select("p_partkey")


@query("FLT_08_date_part_as_range", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) = 6")
def _(t):
    # a range on the column itself, so that statistics prune row groups
    return t.orders.where("o_orderdate >= TIMESTAMP_NTZ'1997-06-01' AND o_orderdate < TIMESTAMP_NTZ'1997-07-01'").select("o_orderkey")


@query("FLT_09_greater_than_empty", "SELECT p_partkey FROM part WHERE CASE WHEN p_size > 25 THEN p_type ELSE '' END > ''")
def _(t):
    return t.part.where(F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("") > "").select("p_partkey")


@query("FLT_10_existence", "SELECT count(*) > 0 AS any_large FROM lineitem WHERE l_quantity > 49")
def _(t):
    return t.lineitem.where("l_quantity > 49").select(F.lit(1)).limit(1).agg((F.count("*") > 0).alias("any_large"))


@query("FLT_11_permissive_array", "SELECT p_partkey FROM part WHERE p_size % 4 = 0 OR list_contains([p_brand, p_type], 'Brand#11')")
def _(t):
    slots = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type"))
    return t.part.withColumn("slots", slots).where((F.size("slots") == 0) | F.array_contains("slots", "Brand#11")).select("p_partkey")


@query("FLT_12_residual_pattern", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].*e')")
def _(t):
    return t.part.where(F.rlike("p_name", F.lit("^[a-m].*e"))).select("p_partkey")


@query("SRT_01_multi_key_sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 50")
def _(t):
    return t.orders.orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("SRT_02_nulls_last", "WITH s AS (SELECT l_partkey, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS spend FROM lineitem WHERE l_quantity > 48 GROUP BY 1) SELECT p_partkey, spend FROM part LEFT JOIN s ON p_partkey = l_partkey ORDER BY spend DESC NULLS LAST, p_partkey LIMIT 100")
def _(t):
    s = t.lines.where("l_quantity > 48").groupBy("l_partkey").agg(F.sum("ext").cast("double").alias("spend"))
    return t.part.join(s, F.col("p_partkey") == F.col("l_partkey"), "left").orderBy(F.desc_nulls_last("spend"), "p_partkey").limit(100).select("p_partkey", "spend")


@query("SRT_03_absolute_magnitude", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 25")
def _(t):
    return t.customer.orderBy(F.abs("c_acctbal").desc(), "c_custkey").limit(25).select("c_custkey", "c_acctbal")


@query("SRT_04_ordinal_sort", "SELECT event_id, event_type FROM events ORDER BY list_position(['signup','view','click','purchase','error'], event_type), event_id LIMIT 40")
def _(t):
    order = F.array_position(F.array(*map(F.lit, ("signup", "view", "click", "purchase", "error"))), F.col("event_type"))
    return t.events.orderBy(order, "event_id").limit(40).select("event_id", "event_type")


@query("SRT_05_best_and_worst", "(SELECT 'best' AS side, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) UNION ALL (SELECT 'worst', c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10)")
def _(t):
    c = t.customer.select("c_custkey", "c_acctbal")
    best, worst = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(10), c.orderBy("c_acctbal", "c_custkey").limit(10)
    return best.select(F.lit("best").alias("side"), "*").unionByName(worst.select(F.lit("worst").alias("side"), "*"))


@query("SRT_06_two_phase_top_k", "WITH top AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100) SELECT l_partkey, n, upper(p_name) AS name FROM top JOIN part ON p_partkey = l_partkey")
def _(t):
    top = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(100)
    return top.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_partkey", "n", F.upper("p_name").alias("name"))


@query("SRT_07_seeded_sample")
def _(t):
    return t.part.orderBy(F.xxhash64(F.lit(7), "p_partkey"), "p_partkey").limit(20).select("p_partkey", "p_name")


@query("SET_01_union_of_ids", "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 49 UNION SELECT p_partkey FROM part WHERE p_size = 1")
def _(t):
    return t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("id")).union(t.part.where("p_size = 1").select("p_partkey")).distinct()


@query("SET_02_union_without_seen", "SELECT p_partkey, min(src) AS src FROM (SELECT p_partkey, 'a' AS src FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, 'b' FROM part WHERE p_size BETWEEN 5 AND 15) GROUP BY 1")
def _(t):
    a = t.part.where("p_size < 10").select("p_partkey", F.lit("a").alias("src"))
    b = t.part.where("p_size BETWEEN 5 AND 15").select("p_partkey", F.lit("b").alias("src"))
    return a.unionByName(b.join(a, "p_partkey", "left_anti"))


@query("SET_03_difference", "SELECT DISTINCT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def _(t):
    return t.orders.select("o_orderkey").subtract(t.lineitem.select("l_orderkey"))


@query("SET_04_intersection", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def _(t):
    return t.supplier.select(F.col("s_nationkey").alias("k")).intersect(t.customer.where("c_acctbal > 9000").select("c_nationkey"))


@query("SET_05_key_set_reconciliation", "WITH a AS (SELECT DISTINCT o_orderkey k FROM orders), b AS (SELECT DISTINCT l_orderkey k FROM lineitem) SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS n_both, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_orders, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_lines")
def _(t):
    a = t.orders.select(F.col("o_orderkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = t.lineitem.select(F.col("l_orderkey").alias("k")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "k", "full_outer").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count_if(F.col("b").isNull()).alias("only_orders"), F.count_if(F.col("a").isNull()).alias("only_lines"))


@query("SET_06_merge_with_precedence", "WITH u AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS pri, o_orderkey FROM orders) SELECT o_custkey, CAST(d AS VARCHAR) AS d, o_orderkey FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey, d ORDER BY pri, o_orderkey) = 1")
def _(t):
    from ..operators.quality import collapse_duplicates

    u = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("d"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("pri"), "o_orderkey")
    return collapse_duplicates(u, ["o_custkey", "d"], [F.col("pri"), F.col("o_orderkey")]).select("o_custkey", F.col("d").cast("string").alias("d"), "o_orderkey")
