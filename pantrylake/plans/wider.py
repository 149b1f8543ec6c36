"""Wording, packs, resolution, repair and report queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy, stats, text, units
from ..operators import quality, relational, similarity
from .base import query

WORDS = "string_split(p_name, ' ')"


@query("STR_07_ocr_clean", r"SELECT p_partkey, regexp_replace(regexp_replace(p_size || '0Z LB' || replace(upper(p_name), ' ', ''), '([0-9]+)0Z\b', '\1 OZ', 'g'), '\b(OZ|LB|GAL|CT|CS|DZ|EA|KG|ML)([A-Z]{4,})', '\1 \2', 'g') AS cleaned FROM part")
def _(t):
    raw = F.concat(F.col("p_size").cast("string"), F.lit("0Z LB"), F.replace(F.upper("p_name"), F.lit(" "), F.lit("")))
    return t.part.select("p_partkey", text.ocr_clean(raw).alias("cleaned"))


@query(
    "STR_08_edge_strip",
    "WITH a AS (SELECT p_partkey, p_name AS raw, trim(regexp_replace(p_name, '^(?:small|large)', '')) AS s FROM part), b AS (SELECT *, trim(regexp_replace(s, '(?:ring|bolt|widget)$', '')) AS u FROM a), "
    "c AS (SELECT *, CASE WHEN len(u) >= 5 THEN u ELSE s END AS v FROM b), d AS (SELECT *, trim(regexp_replace(v, '(?:ring|bolt|widget)$', '')) AS w FROM c), e AS (SELECT *, CASE WHEN len(w) >= 5 THEN w ELSE v END AS x FROM d) "
    "SELECT p_partkey, CASE WHEN len(x) >= 5 AND len(x) < len(raw) THEN x ELSE raw END AS name FROM e",
)
def _(t):
    return t.part.select("p_partkey", text.strip_edges(F.col("p_name"), "small", "large", "ring|bolt|widget").alias("name"))


def _next_name(t):
    """Each part's name a beside the name b of the part 64 keys on."""
    b = t.part.select((F.col("p_partkey") - 64).alias("p_partkey"), F.col("p_name").alias("b"))
    return t.part.select("p_partkey", F.col("p_name").alias("a")).join(b, "p_partkey")


@query("STR_22_section_name", "SELECT p_partkey, CASE WHEN contains(upper(p_type), 'PROMO') THEN 'PROMO' WHEN contains(upper(p_type), 'ECON') THEN 'ECON' ELSE p_type END AS section FROM part")
def _(t):
    return t.part.select("p_partkey", text.section_name(F.col("p_type"), ["PROMO", "ECON"]).alias("section"))


@query("UNT_15_received_count", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN l_quantity * 6 ELSE l_quantity END AS count, CASE l_linenumber % 3 WHEN 0 THEN '#' ELSE 'Ea' END AS flag FROM lineitem")
def _(t):
    k = F.col("l_linenumber") % 3
    kind, by = F.when(k == 0, "weighed").otherwise("counted_each"), F.when(k == 1, " case").otherwise("GAL")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", units.received(kind, F.col("l_quantity"), F.lit(6), by).alias("r")).select("l_orderkey", "l_linenumber", "l_partkey", "r.*")


@query("DQ_06_catalogue_collapse", "WITH r AS (SELECT l_suppkey, l_partkey, CAST(l_shipdate AS DATE) AS day, l_quantity, CASE WHEN l_discount > 0.05 THEN l_discount END AS d, l_orderkey, l_linenumber FROM lineitem) SELECT l_suppkey, l_partkey, CAST(day AS VARCHAR) AS day, arg_max(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS quantity, arg_max(d, (l_orderkey, l_linenumber, l_quantity, d)) FILTER (d IS NOT NULL) AS discount, count(*) AS n FROM r GROUP BY 1, 2, 3")
def _(t):
    day, d = F.to_date("l_shipdate").cast("string"), F.when(F.col("l_discount") > 0.05, F.col("l_discount"))
    order = F.struct("l_orderkey", "l_linenumber", "l_quantity")
    merged = F.max_by("d", F.when(F.col("d").isNotNull(), F.struct("l_orderkey", "l_linenumber", "l_quantity", "d")))
    rows = t.lineitem.withColumn("day", day).withColumn("d", d)
    return rows.groupBy("l_suppkey", "l_partkey", "day").agg(F.max_by("l_quantity", order).alias("quantity"), merged.alias("discount"), F.count("*").alias("n"))


@query("DQ_12_section_reconciliation", "WITH a AS (SELECT l_returnflag AS s, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS printed FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_returnflag AS s, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS parsed FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT s, coalesce(printed, 0) AS printed, coalesce(parsed, 0) AS parsed, CASE WHEN printed IS NULL THEN 'right only' WHEN parsed IS NULL THEN 'left only' ELSE 'both' END AS side, round(coalesce(printed, 0) - coalesce(parsed, 0), 2) AS gap FROM a FULL JOIN b USING (s)")
def _(t):
    side = lambda status, name: t.lines.where(F.col("l_linestatus") == status).groupBy(F.col("l_returnflag").alias("s")).agg(F.sum("ext").cast("double").alias(name))
    return quality.reconcile(side("F", "printed"), side("O", "parsed"), ["s"], "printed", "parsed")


@query("QRY_13_invoice_hub", "WITH {LINES}, i AS (SELECT l_orderkey, min(day) AS day, sum(ext) AS total, count(*) AS lines, count(*) FILTER (l_discount = 0) AS flags FROM lines GROUP BY 1) SELECT CAST(date_trunc('month', day) AS DATE)::VARCHAR AS month, count(*) AS invoices, sum(lines)::BIGINT AS lines, sum(flags)::BIGINT AS flags, sum(total)::DOUBLE AS spend FROM i GROUP BY 1")
def _(t):
    i = t.lines.groupBy("l_orderkey").agg(F.min("day").alias("day"), F.sum("ext").alias("total"), F.count("*").alias("lines"), F.count_if(F.col("l_discount") == 0).alias("flags"))
    return i.groupBy(F.trunc("day", "month").cast("string").alias("month")).agg(F.count("*").alias("invoices"), F.sum("lines").alias("lines"), F.sum("flags").alias("flags"), F.sum("total").cast("double").alias("spend"))


@query("QRY_21_trust_bar", "WITH g AS (SELECT l_linestatus, count(*) FILTER (l_discount > 0.08)::DOUBLE AS hits, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), z AS (SELECT *, hits / n AS p, 1.959963984540054::DOUBLE AS z FROM g) SELECT l_linestatus, round((p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS high FROM z")
def _(t):
    g = t.lineitem.groupBy("l_linestatus").agg(F.count_if(F.col("l_discount") > 0.08).alias("hits"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return g.select("l_linestatus", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("WIN_01_latest_per_key", "SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    joined = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
