"""Similarity joins, neighbours, trees and entity resolution, with SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy, text
from ..operators import quality, recursive, relational, resolution, similarity
from .base import query, views
from .wording import by_words, ratio

TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z]+'))"


@query(
    "JOI_14_nearest_value",
    "WITH {LINES}, n AS (SELECT p_name, round(p_retailprice, 2) AS list_price, min(p_partkey) AS k FROM part GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, l_partkey, price, list_price FROM lines JOIN part x ON x.p_partkey = l_partkey JOIN n USING (p_name) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, price, ext, l_suppkey, l_discount, day ORDER BY abs(price - list_price), list_price) = 1",
)
def _(t):
    lines = t.lines.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "price", "ext", "l_suppkey", "l_discount", "day", "p_name")
    lists = t.part.select("p_name", F.round("p_retailprice", 2).alias("list_price"))
    near = relational.nearest_list(lines.distinct(), lists.withColumn("at", F.col("list_price")), ["p_name"], "price", "at", "list_price")
    return near.select("l_orderkey", "l_linenumber", "l_partkey", "price", "list_price")


@query(
    "JOI_17_nearest_within",
    "WITH w AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_quantity AS y, l_partkey % 100 AS x, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'CS' ELSE 'LB' END ELSE printf('%.2f', l_quantity + 0.25) END AS text FROM lineitem), "
    "u AS (SELECT DISTINCT doc, page, text AS unit, x AS ux, y AS uy FROM w WHERE text IN ('CS', 'LB')), p AS (SELECT DISTINCT doc, page, text::DOUBLE AS price, x AS px, y AS py FROM w WHERE text NOT IN ('CS', 'LB')), "
    "m AS (SELECT *, abs(uy - py) AS dy FROM u JOIN p USING (doc, page) WHERE abs(uy - py) <= 4 AND px > ux), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc, page, unit, ux, uy ORDER BY dy, px - ux, py) = 1) "
    "SELECT doc, page, unit, CASE unit WHEN 'CS' THEN 'case' ELSE 'pound' END AS basis, price, dy FROM b QUALIFY row_number() OVER (PARTITION BY doc, page, px, py ORDER BY dy, ux DESC, uy) = 1",
)
def _(t):
    from ..operators import layout

    word = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "F", "CS").otherwise("LB")).otherwise(F.format_string("%.2f", F.col("l_quantity") + 0.25))
    w = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("y"), (F.col("l_partkey") % 100).alias("x"), word.alias("text")).distinct()
    return layout.unit_prices(w, 4.0)


@query(
    "JOI_19_jaccard_join",
    f"""WITH w AS (SELECT p_partkey, {TOKENS.format('p_name')} t FROM part), k AS (SELECT t, list_sort(t) AS s, p_partkey FROM w WHERE len(t) >= 2), s AS (SELECT s, min(p_partkey) AS r1, list_sort(list(p_partkey))[2] AS r2 FROM k GROUP BY 1),
    p AS (SELECT a.s AS l, b.s AS r, b.r1, b.r2, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS score FROM s a, s b), c AS (SELECT p_partkey, CASE WHEN r1 <> p_partkey THEN r1 ELSE r2 END AS other, score FROM k JOIN p ON p.l = k.s WHERE score >= 0.65)
    SELECT p_partkey AS raw_id, other AS name_id, score FROM c WHERE other IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, other) = 1""",
)
def _(t):
    p = t.part.withColumn("tok", text.words(F.col("p_name")))
    return similarity.jaccard_best(p.withColumnRenamed("p_partkey", "raw_id"), p.withColumnRenamed("p_partkey", "name_id"), "raw_id", "name_id", "tok", 0.65, apart=True)


@query("JOI_20_greedy_match")
def _(t):
    words = lambda c: F.array_distinct(F.split(F.concat_ws(" ", c, (F.col("l_quantity") % 3).cast("string")), " "))
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).withColumn("w", words("p_name")).withColumn("id", F.col("l_partkey") * 100 + F.col("l_quantity"))
    left = rows.where("l_linenumber <= 4").select(F.col("l_orderkey").alias("doc"), F.col("id").cast("long").alias("a"), "w").dropDuplicates(["doc", "a"])
    rows = rows.select("l_orderkey", "l_linenumber", "id", "w")
    right = rows.where("l_linenumber >= 3").select(F.col("l_orderkey").alias("doc"), F.col("id").cast("long").alias("b"), "w").dropDuplicates(["doc", "b"])
    return similarity.greedy_match(left, right, "doc", "a", "b", "w", 0.5)


@query(
    "JOI_21_fuzzy_join",
    f"WITH n AS (SELECT DISTINCT p_name, {by_words('p_name')} AS s FROM part), p AS (SELECT a.p_name, b.p_name AS other, {ratio('a.s', 'b.s')} AS score FROM n a JOIN n b ON a.p_name <> b.p_name) SELECT p_name, other, round(score, 6) AS score FROM p WHERE score >= 60 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY score DESC, other) = 1",
)
def _(t):
    return similarity.best_of_all(t.part, "p_name", 60.0).select("p_name", "other", F.round("score", 6).alias("score"))


@query(
    "JOI_22_token_subset",
    f"WITH n AS (SELECT DISTINCT p_name, {TOKENS.format('p_name')} t FROM part), r AS (SELECT event_id, {TOKENS.format(chr(39) + chr(39) + ' || x.p_name || ' + chr(39) + ' ' + chr(39) + ' || y.p_type || ' + chr(39) + ' ' + chr(39) + ' || z.p_name')} t FROM events JOIN part x ON x.p_partkey = event_id % 200 JOIN part y ON y.p_partkey = event_id % 7 JOIN part z ON z.p_partkey = event_id % 11), "
    "d AS (SELECT DISTINCT list_sort(t) AS s FROM r), h AS (SELECT s, p_name, len(n.t) k FROM d, n WHERE list_has_all(s, n.t) AND NOT list_has_all(['cold', 'ring'], n.t) AND (NOT list_has_any(s, ['bolt', 'gizmo']) OR list_has_any(list_intersect(s, ['bolt', 'gizmo']), n.t))), "
    "m AS (SELECT *, max(k) OVER (PARTITION BY s) mx FROM h), o AS (SELECT s, any_value(p_name) AS p_name, any_value(k) AS n_tokens FROM m WHERE k = mx GROUP BY s HAVING count(*) = 1) SELECT event_id, p_name, n_tokens FROM r JOIN o ON o.s = list_sort(r.t)",
)
def _(t):
    names = t.part.select("p_name").distinct().withColumn("t", text.words(F.col("p_name")))
    key = lambda c, m: F.col("event_id") % m == F.col(c)
    part = lambda c, a, k: t.part.select(F.col("p_partkey").alias(k), F.col(c).alias(a))
    raw = t.events.join(part("p_name", "x", "kx"), key("kx", 200)).join(part("p_type", "y", "ky"), key("ky", 7)).join(part("p_name", "z", "kz"), key("kz", 11))
    raw = raw.select("event_id", text.words(F.concat_ws(" ", "x", "y", "z")).alias("rt"))
    # equal sets of words are matched once
    sets = raw.select(F.array_sort("rt").alias("s")).distinct().withColumn("k", F.array_join("s", " "))
    found = similarity.subset_match(sets, names, "k", "p_name", "s", "t", ["cold", "ring"], ["bolt", "gizmo"])
    return raw.withColumn("k", F.array_join(F.array_sort("rt"), " ")).join(found, "k").select("event_id", "p_name", "n_tokens")


LONG = "list_filter(" + TOKENS.format("{}") + ", lambda w: len(w) >= 4)"


@query(
    "JOI_23_typo_pairs",
    f"WITH n AS (SELECT DISTINCT p_name, {LONG.format('p_name')} AS w FROM part), p AS (SELECT a.p_name AS a, b.p_name AS b, {ratio('a.p_name', 'b.p_name')} AS ratio FROM n a JOIN n b ON a.p_name < b.p_name WHERE abs(len(a.p_name) - len(b.p_name)) <= 3 AND (len(a.w) = 0 OR len(b.w) = 0 OR list_has_any(a.w, b.w))) SELECT a, b, round(ratio, 6) AS ratio FROM p WHERE ratio >= 80 AND ratio < 100",
)
def _(t):
    return similarity.typo_pairs(t.part, "p_name", fuzzy.scorer(fuzzy.indel), low=80.0).select("a", "b", F.round("ratio", 6).alias("ratio"))


SWAPS = """WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey % 5 AS kind, round(l_extendedprice * CASE l_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END, 2) AS price0, l_partkey, l_quantity, l_extendedprice FROM lineitem),
r AS (SELECT *, CASE WHEN l_partkey % 7 = 0 AND l_linenumber % 2 = 1 THEN lead(price0) OVER w WHEN lag(l_partkey % 7 = 0 AND l_linenumber % 2 = 1) OVER w THEN lag(price0) OVER w ELSE price0 END AS price FROM x WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice)),
m AS (SELECT kind, median(price) AS med FROM r GROUP BY 1 HAVING count(*) >= 3), n AS (SELECT r.*, med, lead(kind) OVER w AS next_kind, lead(price) OVER w AS next_price, lead(med) OVER w AS next_med FROM r JOIN m USING (kind) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice))
SELECT l_orderkey, l_linenumber, kind, next_kind, price, next_price FROM n WHERE price / med NOT BETWEEN 0.3 AND 3 AND next_price / next_med NOT BETWEEN 0.3 AND 3 AND price / next_med BETWEEN 0.3 AND 3 AND next_price / med BETWEEN 0.3 AND 3"""


def _swapped(t):
    from pyspark.sql import Window

    k = F.col("l_suppkey") % 5
    x = t.lineitem.select("l_orderkey", "l_linenumber", k.alias("kind"), F.round(F.col("l_extendedprice") * F.when(k == 0, 1).when(k == 1, 10).otherwise(100), 2).alias("price0"), "l_partkey", "l_quantity", "l_extendedprice")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    odd = (F.col("l_partkey") % 7 == 0) & (F.col("l_linenumber") % 2 == 1)
    return x.withColumn("price", F.when(odd, F.lead("price0").over(w)).when(F.lag(odd).over(w), F.lag("price0").over(w)).otherwise(F.col("price0")))


for _name in ("JOI_24_adjacent_rows", "DQ_11_spatial_drift"):

    @query(_name, SWAPS)
    def _(t):
        rows = quality.swap_suspects(_swapped(t), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"], "kind", "price", (0.3, 3.0))
        return rows.select("l_orderkey", "l_linenumber", "kind", F.col("next_product").alias("next_kind"), "price", "next_price")


@query(
    "JOI_25_recursive_expansion",
    "WITH RECURSIVE x(root, node, quantity, level) AS (SELECT p_partkey, p_partkey, 1.0::DOUBLE, 0 FROM part UNION ALL SELECT root, node // 10, quantity * (1 + node % 3), level + 1 FROM x WHERE level < 4 AND node > 0) SELECT root, node, sum(quantity) AS quantity, max(level) AS level FROM x GROUP BY 1, 2",
)
def _(t):
    edges = t.part.where("p_partkey > 0").select(F.col("p_partkey").alias("parent"), F.expr("p_partkey div 10").alias("child"), (1 + F.col("p_partkey") % 3).alias("factor"))
    roots = t.part.select(F.col("p_partkey").alias("root"), F.col("p_partkey").alias("node"), F.lit(1.0).alias("quantity"))
    return recursive.expand(roots, edges).groupBy("root", "node").agg(F.sum("quantity").alias("quantity"), F.max("level").alias("level"))


@query(
    "JOI_26_tree_closure",
    "WITH RECURSIVE t AS (SELECT p_partkey node, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END parent FROM part), u(node, parent) AS (SELECT node, parent FROM t WHERE node = 123 UNION ALL SELECT t.node, t.parent FROM u JOIN t ON t.node = u.parent), d(node, level) AS (SELECT node, 0::BIGINT FROM u WHERE parent IS NULL UNION ALL SELECT t.node, level + 1 FROM d JOIN t ON t.parent = d.node) SELECT node, level FROM d",
)
def _(t):
    tree = t.part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") >= 10, F.expr("p_partkey div 10")).alias("parent"))
    return recursive.closure(tree, F.col("node") == 123)


@query(
    "WIN_07_row_clusters",
    "WITH RECURSIVE e AS (SELECT user_id, event_id, floor(value * 10) / 10 AS y, row_number() OVER (PARTITION BY user_id ORDER BY floor(value * 10) / 10, event_id) AS k FROM events), c(user_id, k, grp, total, n) AS (SELECT user_id, k, 0::BIGINT, y, 1 FROM e WHERE k = 1 UNION ALL "
    "SELECT e.user_id, e.k, CASE WHEN abs(y - total / n) > 2 THEN grp + 1 ELSE grp END, CASE WHEN abs(y - total / n) > 2 THEN y ELSE total + y END, CASE WHEN abs(y - total / n) > 2 THEN 1 ELSE n + 1 END FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1) SELECT user_id, grp AS row, count(*) AS n FROM c GROUP BY 1, 2",
)
def _(t):
    from ..operators import layout

    words = t.events.select(F.col("user_id").alias("doc"), F.lit(1).alias("page"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("text"), F.lit(0.0).alias("x"), (F.floor(F.col("value") * 10) / 10).alias("y"))
    return layout.rows_by_running_mean(words, 2.0).groupBy(F.col("doc").alias("user_id"), "row").agg(F.count("*").alias("n"))


@query("WIN_08_peer_count", "WITH {LINES}, x AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, ext, l_quantity) id, l_partkey, price FROM lines) SELECT a.l_partkey, a.price, count(b.id) AS peers FROM x a LEFT JOIN x b ON b.l_partkey = a.l_partkey AND b.id <> a.id AND b.price <> a.price AND b.price BETWEEN 0.7 * a.price AND 1.5 * a.price GROUP BY a.id, a.l_partkey, a.price")
def _(t):
    return relational.peer_count(t.lines, "l_partkey", "price", 0.7, 1.5)


@query("WIN_12_best_version", "WITH {LINES}, c AS (SELECT *, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'C' || l_suppkey % 3 END AS code FROM lines) SELECT l_orderkey, code, ext::DOUBLE AS ext, l_quantity FROM c QUALIFY code = '' OR row_number() OVER (PARTITION BY l_orderkey, code ORDER BY ext DESC, l_quantity, l_partkey) = 1")
def _(t):
    k = F.col("l_suppkey") % 3
    c = t.lines.withColumn("code", F.when(k == 0, "").otherwise(F.concat(F.lit("C"), k.cast("string"))))
    return relational.best_version(c, ["l_orderkey"], "code", [F.desc("ext"), F.col("l_quantity"), F.col("l_partkey")]).select("l_orderkey", "code", F.col("ext").cast("double").alias("ext"), "l_quantity")


@query(
    "QRY_02_reorder_predictions",
    "WITH {LINES}, b AS (SELECT DISTINCT l_partkey, day FROM lines WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 45)), g AS (SELECT l_partkey, day, day - lag(day) OVER (PARTITION BY l_partkey ORDER BY day) AS gap FROM b), f AS (SELECT l_partkey, count(*) AS n_days, avg(gap) AS mean_gap, DATE '2002-01-01' - max(day) AS since FROM g GROUP BY 1 HAVING count(*) >= 3) SELECT l_partkey, n_days, round(since / mean_gap, 6) AS urgency FROM f WHERE since / mean_gap >= 0.9",
)
def _(t):
    used = t.part.where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    bought = t.lines.join(used, "l_partkey", "left_anti")
    return quality.cadence(bought, "l_partkey", "day", "2002-01-01").select("l_partkey", "n_days", F.round("urgency", 6).alias("urgency"))


# -- resolution -------------------------------------------------------------------------------------------------------

NORMAL = "regexp_replace(upper(trim(replace(coalesce({}, ''), '/', ' '))), '\\s+', ' ', 'g')"
STEMS = "list_transform(regexp_extract_all({}, '[A-Za-z]{{3,}}'), lambda w: CASE WHEN len(w) >= 4 AND lower(w) LIKE '%s' AND lower(w) NOT LIKE '%ss' THEN lower(left(w, len(w) - 1)) ELSE lower(w) END)"
RESOLVED = f"""WITH {views('raw_items', 'mapped')}, i AS (SELECT *, {NORMAL.format('raw_description')} AS raw, upper(coalesce(vendor, '')) AS v FROM raw_items), m AS (SELECT upper(coalesce(vendor, '')) AS v, code, {NORMAL.format('description')} AS key, name FROM mapped),
codes AS (SELECT code, min(name) AS name FROM m WHERE code IS NOT NULL GROUP BY 1), own AS (SELECT v, key, min(name) AS name FROM m WHERE v <> '' GROUP BY 1, 2), every AS (SELECT key, min(name) AS name FROM m GROUP BY 1),
rs AS (SELECT DISTINCT v, raw, {by_words('raw')} AS s FROM i WHERE raw <> '' AND raw NOT LIKE '%SURCHARGE%'), ks AS (SELECT key, name, {by_words('key')} AS s FROM every),
vf AS (SELECT rs.v, raw, own.name, {ratio('rs.s', 'o.s')} AS score, own.key FROM rs JOIN own USING (v) JOIN ks o USING (key) QUALIFY row_number() OVER (PARTITION BY rs.v, raw ORDER BY score DESC, own.key) = 1),
gf AS (SELECT raw, ks.name, {ratio('r.s', 'ks.s')} AS score, ks.key FROM (SELECT DISTINCT raw, s FROM rs) r, ks QUALIFY row_number() OVER (PARTITION BY raw ORDER BY score DESC, ks.key) = 1),
t AS (SELECT i.*, i.raw = '' AND coalesce(i.code, '') = '' AS blank, i.raw LIKE '%FUEL SURCHARGE%' AS fee, codes.name AS by_code, own.name AS by_own, CASE WHEN vf.score >= CASE WHEN i.v = 'BETA' THEN 80 ELSE 90 END THEN vf.name END AS by_vf, vf.score AS vs, every.name AS by_all,
 CASE WHEN gf.score >= 90 AND list_has_any({STEMS.format('i.raw')}, {STEMS.format('gf.name')}) THEN gf.name END AS by_gf, gf.score AS gs FROM i LEFT JOIN codes ON codes.code = i.code LEFT JOIN own ON own.v = i.v AND own.key = i.raw LEFT JOIN vf ON vf.v = i.v AND vf.raw = i.raw LEFT JOIN every ON every.key = i.raw LEFT JOIN gf ON gf.raw = i.raw),
r AS (SELECT item_id, section, CASE WHEN blank THEN 'unmatched' WHEN fee THEN 'non_product' WHEN by_code IS NOT NULL THEN 'code' WHEN by_own IS NOT NULL THEN 'vendor_exact' WHEN by_vf IS NOT NULL THEN 'vendor_fuzzy' WHEN by_all IS NOT NULL THEN 'exact' WHEN by_gf IS NOT NULL THEN 'fuzzy' ELSE 'unmatched' END AS confidence,
 CASE WHEN blank OR fee THEN NULL ELSE coalesce(by_code, by_own, by_vf, by_all, by_gf) END AS canonical, vs, gs, raw, v FROM t)"""


def _resolved(t, last="fuzzy"):
    names = t.part.select(F.col("p_name").alias("name"), F.col("p_type").alias("category")).distinct()
    return resolution.resolve_items(t.view("raw_items"), t.view("mapped"), names, {"Beta": 80.0}, last=last)


@query("ENT_01_tiers_to_fuzzy", f"{RESOLVED} SELECT item_id, canonical, confidence, round(CASE confidence WHEN 'unmatched' THEN 0 WHEN 'vendor_fuzzy' THEN vs WHEN 'fuzzy' THEN gs ELSE 100 END, 6) AS score FROM r")
def _(t):
    return _resolved(t).select("item_id", "canonical", "confidence", F.round("score", 6).alias("score"))


@query("ENT_01_all_tiers")
def _(t):
    return _resolved(t, None).select("item_id", "canonical", "confidence", F.round("score", 6).alias("score"))


@query(
    "ENT_02_section_pool",
    "WITH s AS (SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN '** DELI **' WHEN 1 THEN 'Canned & Dry' WHEN 2 THEN 'FROZEN' WHEN 3 THEN 'produce' ELSE 'MEATS / poultry' END AS section FROM part), n AS (SELECT DISTINCT p_name AS name, CASE p_size % 4 WHEN 0 THEN 'Proteins' WHEN 1 THEN 'Dairy' WHEN 2 THEN 'Spices' ELSE 'Drystock' END AS category FROM part WHERE p_size % 4 <> 1 OR p_partkey % 100 = 1), "
    "c AS (SELECT section, CASE WHEN section LIKE '%DELI%' THEN ['Proteins', 'Dairy'] WHEN section LIKE 'Canned%' THEN ['Drystock', 'Spices'] WHEN section = 'produce' THEN ['Produce'] WHEN section LIKE 'MEATS%' THEN ['Proteins'] ELSE [] END AS cats FROM s) "
    "SELECT section, count(name) AS pool FROM c LEFT JOIN n ON list_contains(cats, category) GROUP BY 1 HAVING count(name) >= 3",
)
def _(t):
    k, c = F.col("p_size") % 5, F.col("p_size") % 4
    sections = t.part.select(F.when(k == 0, "** DELI **").when(k == 1, "Canned & Dry").when(k == 2, "FROZEN").when(k == 3, "produce").otherwise("MEATS / poultry").alias("section")).distinct()
    names = t.part.where("p_size % 4 <> 1 OR p_partkey % 100 = 1").select(F.col("p_name").alias("name"), F.when(c == 0, "Proteins").when(c == 1, "Dairy").when(c == 2, "Spices").otherwise("Drystock").alias("category")).distinct()
    cats = sections.select("section", F.explode(resolution.section_categories(F.col("section"))).alias("category"))
    return cats.join(names, "category").groupBy("section").agg(F.count("*").alias("pool")).where("pool >= 3")


@query("ENT_03_batch_map", f"{RESOLVED} SELECT confidence, count(*) AS n FROM r WHERE raw <> '' AND raw NOT LIKE '%FUEL SURCHARGE%' GROUP BY 1")
def _(t):
    names = t.part.select(F.col("p_name").alias("name"), F.col("p_type").alias("category")).distinct()
    items = t.view("raw_items").withColumns({"unit_price": F.lit(1.0), "extended_amount": F.lit(1.0), "synthetic": F.lit(False), "marks_substitutes": F.lit(False)})
    return resolution.map_batch(items, t.view("mapped"), names, thresholds={"Beta": 80.0}, last="fuzzy").groupBy("confidence").agg(F.count("*").alias("n"))


@query(
    "ENT_04_quarantine",
    f"{RESOLVED}, q AS (SELECT v, raw, canonical, CASE confidence WHEN 'vendor_fuzzy' THEN vs ELSE gs END AS score FROM r WHERE confidence IN ('vendor_fuzzy', 'fuzzy')), p AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY v, raw ORDER BY score DESC, canonical) = 1) "
    "SELECT 'proposal' AS kind, canonical AS label, count(*) AS n FROM p WHERE NOT (v = 'ALPHA' AND raw LIKE 'BLUE%') GROUP BY 2 UNION ALL SELECT 'fact', CASE WHEN confidence IN ('vendor_fuzzy', 'fuzzy') THEN confidence || '_pending' ELSE confidence END, count(*) FROM r GROUP BY 2",
)
def _(t):
    known = t.view("raw_items").where("upper(vendor) = 'ALPHA' AND lower(raw_description) LIKE 'blue%'").select("vendor", F.col("raw_description").alias("raw"))
    vendor = F.coalesce("vendor", F.lit(""))
    facts, proposals = resolution.quarantine(_resolved(t).withColumn("vendor", vendor), known)
    a = proposals.groupBy(F.lit("proposal").alias("kind"), F.col("suggested").alias("label")).agg(F.count("*").alias("n"))
    return a.unionByName(facts.groupBy(F.lit("fact").alias("kind"), "label").agg(F.count("*").alias("n")))


@query(
    "ENT_05_guards",
    f"{RESOLVED}, c AS (SELECT p_name AS name, CASE min(p_size) % 2 WHEN 0 THEN 'weighed' ELSE NULL END AS class FROM part WHERE p_size % 4 <> 3 GROUP BY 1), g AS (SELECT r.*, c.name AS known, class, raw_items.raw_description AS said, item_id % 3 = 0 AS gallon FROM r JOIN raw_items USING (item_id) LEFT JOIN c ON c.name = canonical) "
    "SELECT CASE WHEN canonical IS NULL THEN confidence WHEN gallon AND class = 'weighed' THEN 'unmatched_class_mismatch' WHEN known IS NULL THEN 'unmatched_drift' ELSE confidence END AS label, count(*) AS n FROM g GROUP BY 1",
)
def _(t):
    kind = F.when(F.min("p_size") % 2 == 0, "weighed")
    catalogue = t.part.where("p_size % 4 <> 3").groupBy(F.col("p_name").alias("name")).agg(kind.alias("inventory_class"))
    rows = _resolved(t).withColumn("case_size", F.when(F.col("item_id") % 3 == 0, "4/1 GAL"))
    return resolution.guarded(rows, catalogue).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "ENT_06_proposal_convergence",
    "WITH p AS (SELECT l_partkey % 50 AS raw, l_suppkey % 3 AS vendor, l_linenumber % 4 AS suggested, l_returnflag AS source, l_orderkey AS id FROM lineitem), g AS (SELECT vendor, raw, suggested, count(*) AS n, list_sort(list_distinct(list(source))) AS sources, arg_min(source, (id, source)) AS first FROM p GROUP BY 1, 2, 3) SELECT vendor, raw, suggested, n, first, array_to_string(list_filter(sources, lambda s: s <> first), ',') AS also FROM g",
)
def _(t):
    p = t.lineitem.select((F.col("l_partkey") % 50).alias("raw"), (F.col("l_suppkey") % 3).alias("vendor"), (F.col("l_linenumber") % 4).alias("suggested"), F.col("l_returnflag").alias("source"), F.col("l_orderkey").alias("id"))
    return resolution.converged(p, ["vendor", "raw", "suggested"], "source", "id").select("vendor", "raw", "suggested", "n", "first", F.array_join("also", ",").alias("also"))


@query(
    "ENT_07_approval",
    "WITH m AS (SELECT l_suppkey % 5 AS vendor, l_partkey % 40 AS raw, CASE WHEN l_linenumber = 1 THEN l_partkey END AS product, l_orderkey FROM lineitem), a AS (SELECT DISTINCT s_suppkey % 5 AS vendor, s_suppkey % 40 AS raw, 1000 + s_suppkey % 5 AS name FROM supplier WHERE s_suppkey % 5 = s_suppkey % 40 % 5) "
    "SELECT 'lines' AS kind, coalesce(product, name) AS product, count(*) AS n FROM m LEFT JOIN (SELECT vendor, raw, min(name) AS name FROM a GROUP BY 1, 2) USING (vendor, raw) GROUP BY 2 UNION ALL SELECT 'mappings', min(name), 1 FROM a GROUP BY vendor, raw",
)
def _(t):
    k = F.col("s_suppkey")
    lines = t.lineitem.select((F.col("l_suppkey") % 5).alias("vendor"), (F.col("l_partkey") % 40).alias("raw"), F.when(F.col("l_linenumber") == 1, F.col("l_partkey")).alias("product"))
    approved = t.supplier.select((k % 5).alias("vendor"), (k % 40).alias("raw"), (1000 + k % 5).alias("product")).where("vendor = raw % 5")
    mappings, filled = resolution.approve(lines, lines.limit(0).select("vendor", "raw", "product"), approved)
    a = filled.groupBy(F.lit("lines").alias("kind"), "product").agg(F.count("*").alias("n"))
    return a.unionByName(mappings.select(F.lit("mappings").alias("kind"), "product", F.lit(1).cast("long").alias("n")))


@query(
    "ENT_09_review_worklist",
    "WITH l AS (SELECT l_suppkey % 5 AS vendor, 'raw ' || l_partkey % 60 AS raw, CASE WHEN l_linenumber > 5 THEN 1 END AS product, l_returnflag AS section, CAST(l_shipdate AS DATE) AS day FROM lineitem), p AS (SELECT s_suppkey % 5 AS vendor, 'raw ' || s_suppkey % 60 AS raw, min(s_suppkey) AS suggested FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1, 2), "
    "x AS (SELECT s_suppkey % 5 AS vendor, 'raw ' || s_suppkey % 60 AS raw, min(s_suppkey) AS suggested FROM supplier WHERE s_suppkey % 2 = 1 GROUP BY 1, 2), f AS (SELECT vendor, raw, count(*) AS n_lines, arg_max(section, (day, section)) AS section FROM l WHERE product IS NULL GROUP BY 1, 2), "
    "t AS (SELECT *, 'pending' AS state FROM p UNION ALL SELECT x.*, 'rejected' FROM x JOIN f USING (vendor, raw) WHERE (vendor, raw) NOT IN (SELECT (vendor, raw) FROM p)) SELECT vendor, raw, suggested, state, coalesce(n_lines, 0) AS n_lines, section FROM t LEFT JOIN f USING (vendor, raw) ORDER BY n_lines DESC, vendor, raw, suggested LIMIT 100",
)
def _(t):
    k = F.col("s_suppkey")
    proposed = lambda odd: t.supplier.where(k % 2 == odd).groupBy((k % 5).alias("vendor"), F.concat(F.lit("raw "), (k % 60).cast("string")).alias("raw")).agg(F.min("s_suppkey").alias("suggested"))
    lines = t.lineitem.select((F.col("l_suppkey") % 5).alias("vendor"), F.concat(F.lit("raw "), (F.col("l_partkey") % 60).cast("string")).alias("raw"), F.when(F.col("l_linenumber") > 5, 1).alias("product"), F.col("l_returnflag").alias("section"), F.to_date("l_shipdate").alias("day"))
    return resolution.worklist(proposed(0), proposed(1), lines)


@query(
    "ENT_11_mapper_replay",
    f"{RESOLVED}, o AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN canonical WHEN 1 THEN NULL ELSE 'old name' END AS was, CASE item_id % 3 WHEN 0 THEN confidence WHEN 1 THEN 'unmatched' ELSE 'exact' END AS tier FROM r), b AS (SELECT CASE WHEN was IS NOT DISTINCT FROM canonical THEN 'agree' WHEN canonical IS NULL THEN 'now unmatched' WHEN was IS NULL THEN 'now matched' ELSE 'different' END AS verdict, tier, confidence FROM r JOIN o USING (item_id)) "
    "SELECT verdict AS a, '' AS b, count(*) AS n FROM b GROUP BY 1 UNION ALL SELECT tier, confidence, count(*) FROM b GROUP BY 1, 2",
)
def _(t):
    from ..operators.staging import cut

    new = cut(_resolved(t).select("item_id", "canonical", "confidence"))
    k = F.col("item_id") % 3
    old = new.select("item_id", F.when(k == 0, F.col("canonical")).when(k == 2, "old name").alias("canonical"), F.when(k == 0, F.col("confidence")).when(k == 1, "unmatched").otherwise("exact").alias("confidence"))
    verdicts, matrix = resolution.replay(old, new, "item_id")
    return verdicts.select(F.col("verdict").alias("a"), F.lit("").alias("b"), "n").unionByName(matrix.select(F.col("old_tier").alias("a"), F.col("new_tier").alias("b"), "n"))


@query("ENT_10_mapping_drift")
def _(t):
    mapped = t.view("mapped").select("vendor", F.concat_ws(" ", F.col("description"), F.lit("fresh")).alias("raw"), F.split_part("name", F.lit(" "), F.lit(2)).alias("name")).distinct()
    none = t.spark.createDataFrame([], "vendor string, raw string, suggested string")
    return resolution.drift_proposals(mapped, t.part.select(F.col("p_name").alias("name"), F.col("p_type").alias("category")).distinct(), none)


@query("ENT_12_ingredient_matcher")
def _(t):
    asked = t.part.select(F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("s"))).otherwise(F.replace("p_name", F.lit("l"), F.lit("ll"))).alias("ingredient")).distinct()
    return resolution.match_ingredients(asked, t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name")))


@query(
    "ENT_13_menu_linker",
    "WITH r AS (SELECT p_name AS n, min(p_partkey) AS id FROM part GROUP BY 1), m AS (SELECT p_partkey AS menu_id, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN 'grilled ' || p_name || ' plate' ELSE 'soup with ' || p_name END AS d FROM part WHERE p_size % 3 < 3), h AS (SELECT *, CASE WHEN d LIKE '% with %' THEN split_part(d, ' with ', 1) ELSE d END AS h FROM m), "
    "e AS (SELECT menu_id, id, 'exact' AS how FROM h JOIN r ON r.n = d), c AS (SELECT menu_id, id, 'contained' AS how FROM h JOIN r ON contains(' ' || h || ' ', ' ' || n || ' ') WHERE len(n) >= 5 AND menu_id NOT IN (SELECT menu_id FROM e) QUALIFY row_number() OVER (PARTITION BY menu_id ORDER BY len(n) DESC, id) = 1) SELECT menu_id, id AS recipe_id, how FROM e UNION ALL SELECT menu_id, id, how FROM c",
)
def _(t):
    k = F.col("p_size") % 3
    dish = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("grilled "), "p_name", F.lit(" plate"))).otherwise(F.concat(F.lit("soup with "), "p_name"))
    return resolution.link_menus(t.part.select(F.col("p_partkey").alias("menu_id"), dish.alias("dish")), t.part.select(F.col("p_partkey").alias("recipe_id"), F.col("p_name").alias("name")), 0.99)


@query("ENT_14_food_match")
def _(t):
    products = t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), (F.col("p_size") % 5 == 0).alias("was_auto"))
    foods = t.part.select(F.concat_ws(", ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1)), F.when(F.col("p_size") % 2 == 0, "dried")).alias("name")).distinct().withColumn("food_id", F.xxhash64("name"))
    return resolution.match_foods(products, foods, ["dried", "canned"])


@query(
    "ENT_15_yield_candidates",
    "WITH i AS (SELECT DISTINCT left(p_name, 8) AS ingredient FROM part), w AS (SELECT ingredient, unnest(regexp_extract_all(lower(ingredient), '[a-z]{3,}')) AS w FROM i), r AS (SELECT p_partkey AS ref_id, p_name AS name FROM part) SELECT ingredient, ref_id, rank FROM (SELECT DISTINCT ingredient, ref_id, name FROM w JOIN r ON contains(lower(name), w)) QUALIFY row_number() OVER (PARTITION BY ingredient ORDER BY lower(name), ref_id) <= 12".replace("SELECT ingredient, ref_id, rank FROM (", "SELECT ingredient, ref_id, row_number() OVER (PARTITION BY ingredient ORDER BY lower(name), ref_id) AS rank FROM ("),
)
def _(t):
    return resolution.yield_candidates(t.part.select(F.substring("p_name", 1, 8).alias("ingredient")), t.part.select(F.col("p_partkey").alias("ref_id"), F.col("p_name").alias("name"))).select("ingredient", "ref_id", F.col("rank").cast("long").alias("rank"))


@query("ENT_16_code_recovery")
def _(t):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("C"), F.col("p_partkey").cast("string"))).alias("code"), F.when(F.col("l_linenumber") % 3 > 0, F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))).alias("words"))
    missing = t.part.select(F.col("p_partkey").alias("missing_id"), F.concat_ws(" ", F.replace("p_name", F.lit("l"), F.lit("ll")), "p_type", F.col("p_size").cast("string")).alias("words"))
    return resolution.recover_codes(rows, missing)


@query(
    "ENT_17_merge_dimension",
    "WITH m AS (SELECT p_partkey AS old, p_partkey - 3 AS new FROM part WHERE p_partkey % 10 = 3) SELECT 'lines' AS kind, CASE WHEN l_partkey % 10 = 3 THEN l_partkey - 3 ELSE l_partkey END AS product, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'mappings', CASE WHEN p_partkey % 10 = 3 THEN p_partkey - 3 ELSE p_partkey END, count(*) FROM part WHERE p_size > 30 GROUP BY 2 UNION ALL SELECT 'products', p_partkey, 1 FROM part WHERE p_partkey % 10 <> 3 "
    "UNION ALL SELECT 'refused', p_partkey, 1 FROM part WHERE p_partkey % 10 = 5",
)
def _(t):
    k = F.col("p_partkey")
    moves = t.part.where("p_partkey % 10 IN (3, 5)").select(k.alias("old"), F.when(k % 10 == 3, k - 3).otherwise(k).alias("new"))
    facts = {"lines": t.lineitem.select(F.col("l_partkey").alias("product")), "mappings": t.part.where("p_size > 30").select(k.alias("product"))}
    products, moved, refused = resolution.merge_products(t.part.select(k.alias("product")), facts, moves)
    n = lambda kind, df: df.groupBy(F.lit(kind).alias("kind"), "product").agg(F.count("*").alias("n"))
    return n("lines", moved["lines"]).unionByName(n("mappings", moved["mappings"])).unionByName(n("products", products)).unionByName(n("refused", refused.select(F.col("old").alias("product"))))
