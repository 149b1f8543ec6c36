"""Recipes, menus and reports over the derived kitchen, with SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats, units
from ..operators import quality, recipes, relational
from .base import between, money, query, views
from .wording import DENSITIES, KINDS, PIECES, UNIT_TABLE, pack_sql




def _five(t) -> dict:
    return {"lines": t.view("bought"), "products": t.view("products"), "references": t.view("refs")}


def _costed(t):
    return recipes.estimated(t.view("ingredients"), **_five(t), densities=DENSITIES, pieces=PIECES)


def _candidates_sql() -> str:
    """SQL: the packs to try for each product's chosen line, in order."""
    from .wording import BARE_SQL, _parses

    weight = "CASE product_id % 7 WHEN 0 THEN size || 'LB' WHEN 1 THEN '36/' || size || 'LB' WHEN 6 THEN size || 'LB' END"
    pounds = "CASE WHEN name LIKE '% bean' THEN 30 END"
    bushel = f"CASE WHEN {pounds} IS NOT NULL THEN printf('%.1f', round_even({pounds} * CASE product_id % 7 WHEN 2 THEN 1 + 1 / 9.0::DOUBLE WHEN 4 THEN 1 / size::DOUBLE END, 1)) || 'LB' END"
    return f"list_filter([trim(case_size), {weight}, {bushel}, trim(default_case_size), {BARE_SQL}], lambda x: {_parses('x')})"


_N, _S, _U = pack_sql("pack")
DENSITY = "CASE WHEN lower(name) = 'small bolt' THEN 6.0 WHEN lower(name) LIKE '% ring' THEN 4.5 WHEN lower(name) LIKE '% bolt' THEN 5.0 END"


def _cost_sql(rows: str, quantity: str, unit: str, yield_pct: str) -> str:
    """SQL: (ingredient_id, k, cost) of each row with a pack; rows has name, unit_price, per_pound, oz_per_cup, pack."""
    return f"""SELECT ingredient_id, k, note, round_even(CASE note WHEN 'per pound' THEN per_pound * need / 16 WHEN 'weight' THEN unit_price * (need / nullif(whole, 0)) WHEN 'volume' THEN unit_price * (need / nullif(whole, 0)) WHEN 'volume by density' THEN unit_price * (need / 8 * density / nullif(whole, 0))
  WHEN 'weight by density' THEN unit_price * (need / density * 8 / nullif(whole, 0)) WHEN 'container' THEN unit_price * (q / n) WHEN 'count' THEN unit_price * (q / nullif(whole, 0)) END, 2) AS cost FROM (
 SELECT *, CASE WHEN kind = 'weight' AND per_pound IS NOT NULL THEN 'per pound' WHEN n IS NULL THEN 'no pack' WHEN kind = 'weight' AND pk = 'weight' THEN 'weight' WHEN kind = 'volume' AND pk = 'volume' THEN 'volume'
   WHEN kind = 'volume' AND pk = 'weight' THEN CASE WHEN density IS NULL THEN 'no density' ELSE 'volume by density' END WHEN kind = 'weight' AND pk = 'volume' THEN CASE WHEN density IS NULL THEN 'no density' ELSE 'weight by density' END
   WHEN unit2 = 'can' AND pk IN ('weight', 'volume') THEN 'container' WHEN kind = 'count' AND pk = 'count' THEN 'count' ELSE 'incompatible units' END AS note FROM (
  SELECT c.*, coalesce(x.kind, 'unknown') AS kind, y.kind AS pk, q * x.f AS need, s * y.f * n AS whole FROM (
   SELECT *, CASE WHEN each IS NOT NULL THEN bought * each ELSE bought END AS q, CASE WHEN each IS NOT NULL THEN 'oz' ELSE unit1 END AS unit2 FROM (
    SELECT *, {unit} AS unit1, CASE WHEN coalesce({yield_pct}, 0) <> 0 THEN {quantity} / ({yield_pct} / 100) ELSE {quantity} END AS bought, {_N} AS n, {_S} AS s, {_U} AS pu, coalesce(oz_per_cup, {DENSITY})::DOUBLE AS density,
      CASE WHEN name = 'small ring' AND {unit} = 'each' THEN 2.5::DOUBLE END AS each FROM {rows})) c
  LEFT JOIN u x ON x.u = unit2 LEFT JOIN u y ON y.u = pu))"""


ESTIMATE_SQL = f"""WITH {views('ingredients', 'refs', 'products', 'bought')}, u AS (SELECT u, f, {KINDS} AS kind FROM {UNIT_TABLE}),
ranked AS (SELECT b.*, p.name, p.size, p.default_case_size, row_number() OVER (PARTITION BY product_id ORDER BY day DESC, seq DESC) AS rn FROM bought b JOIN products p USING (product_id) WHERE NOT coalesce(flagged, FALSE)),
fit AS (SELECT *, coalesce(nullif(case_size, ''), default_case_size) AS pack FROM ranked WHERE rn <= 5),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY (({_N}) IS NOT NULL OR per_pound IS NOT NULL) DESC, rn) AS pick FROM fit) WHERE pick = 1),
packs AS (SELECT product_id AS pid, unit_price, per_pound, {_candidates_sql()} AS found, case_size FROM chosen),
tries AS (SELECT pid, unit_price, per_pound, unnest(CASE WHEN len(found) > 0 THEN found ELSE [coalesce(case_size, '')] END) AS pack, unnest(range(1, greatest(len(found), 1) + 1)) AS k FROM packs),
rows0 AS (SELECT i.ingredient_id, i.name, i.quantity, i.unit, coalesce(ref_yield_pct, yield_pct) AS y, oz_per_cup, ap_weight_oz, lower(trim(ap_unit)) AS ap_unit, t.* FROM ingredients i LEFT JOIN refs USING (ref_id) JOIN tries t ON t.pid = i.product_id WHERE i.quantity IS NOT NULL),
one AS ({_cost_sql('rows0', 'quantity', 'unit', 'y')}),
best1 AS (SELECT ingredient_id, arg_min(cost, k) FILTER (cost IS NOT NULL) AS cost, arg_min(note, k) FILTER (cost IS NOT NULL) AS note, arg_max(note, k) AS last_note FROM one GROUP BY 1),
rows2 AS (SELECT r.* FROM rows0 r JOIN best1 USING (ingredient_id) WHERE best1.cost IS NULL AND r.unit = 'each' AND r.ap_weight_oz > 0 AND r.ap_unit IN ('each', 'head', 'bunch')),
two AS ({_cost_sql('rows2', 'quantity * ap_weight_oz', "'oz'", 'NULL::DOUBLE')}),
best2 AS (SELECT ingredient_id, arg_min(cost, k) FILTER (cost IS NOT NULL) AS cost, arg_min(note, k) FILTER (cost IS NOT NULL) AS note FROM two GROUP BY 1),
costed AS (SELECT i.*, CASE WHEN i.product_id IS NULL OR i.quantity IS NULL THEN NULL ELSE coalesce(best2.cost, best1.cost) END AS cost,
  CASE WHEN i.product_id IS NULL OR i.quantity IS NULL THEN 'missing product or quantity' WHEN chosen.product_id IS NULL THEN 'no invoice history' ELSE coalesce(best2.note, best1.note, best1.last_note) END AS note
  FROM ingredients i LEFT JOIN best1 USING (ingredient_id) LEFT JOIN best2 USING (ingredient_id) LEFT JOIN chosen ON chosen.product_id = i.product_id)"""


@query("UNT_10_ingredient_estimate", f"{ESTIMATE_SQL} SELECT DISTINCT ingredient_id, cost, note FROM costed")
def _(t):
    return _costed(t).select("ingredient_id", "cost", "note").distinct()


ROLL_SQL = f"""{ESTIMATE_SQL}, own AS (SELECT recipe_id, coalesce(sum(CASE WHEN sub_recipe_id IS NULL THEN cost END), 0) AS own, count(CASE WHEN sub_recipe_id IS NULL THEN cost END) AS priced, count(CASE WHEN sub_recipe_id IS NULL THEN 1 END) AS n FROM costed GROUP BY 1),
base AS (SELECT r.recipe_id, nullif(serves, 0) AS serves, coalesce(own, 0) AS own, coalesce(priced, 0) AS priced, coalesce(n, 0) AS n FROM recipes r LEFT JOIN own USING (recipe_id)),
subs AS (SELECT c.recipe_id, sub_recipe_id, quantity, b.serves AS s FROM costed c LEFT JOIN base b ON b.recipe_id = c.sub_recipe_id WHERE sub_recipe_id IS NOT NULL),
t0 AS (SELECT recipe_id, own AS total FROM base)"""
for _k in range(recipes.DEPTH):
    ROLL_SQL += f""", v{_k} AS (SELECT s.recipe_id, CASE WHEN quantity <> 0 AND total <> 0 THEN total * quantity / s.s END AS v FROM subs s LEFT JOIN t{_k} ON t{_k}.recipe_id = s.sub_recipe_id), s{_k} AS (SELECT recipe_id, sum(v) AS v, count(v) AS p, count(*) AS m FROM v{_k} GROUP BY 1), t{_k + 1} AS (SELECT base.recipe_id, own + coalesce(v, 0) AS total FROM base LEFT JOIN s{_k} USING (recipe_id))"""
_LAST = recipes.DEPTH - 1
ROLL_SQL = ROLL_SQL.replace("WITH ", f"WITH {views('recipes')}, ", 1) + f", costs AS (SELECT b.recipe_id, own + coalesce(v, 0) AS total, (own + coalesce(v, 0)) / serves AS per_serving, priced + coalesce(p, 0) AS priced, n + coalesce(m, 0) AS n FROM base b LEFT JOIN s{_LAST} USING (recipe_id))"


def _costs(t):
    return recipes.recipe_costs(t.view("recipes"), _costed(t))


@query("UNT_11_recipe_cost", f"{ROLL_SQL} SELECT recipe_id, round(total, 4) AS total, round(per_serving, 4) AS per_serving, priced, n, round(CASE WHEN n = 0 THEN 0 ELSE priced / n END, 6) AS coverage FROM costs")
def _(t):
    c = _costs(t)
    return c.select("recipe_id", *[stats.scaled_round(F.col(x), 4).alias(x) for x in ("total", "per_serving")], "priced", "n", stats.scaled_round(F.col("coverage"), 6).alias("coverage"))


@query(
    "UNT_12_menu_cost",
    f"{ROLL_SQL.replace('WITH ', 'WITH ' + views('menus', 'sides', 'census') + ', ', 1)}, mr AS (SELECT menu_id, day, recipe_id FROM menus WHERE recipe_id IS NOT NULL UNION ALL SELECT s.menu_id, day, s.recipe_id FROM sides s JOIN menus USING (menu_id)), "
    "p AS (SELECT menu_id, sum(CASE WHEN coalesce(per_serving, 0) <> 0 THEN round_even(per_serving * coalesce(headcount, 30), 2) END) AS cost FROM mr LEFT JOIN census USING (day) LEFT JOIN costs USING (recipe_id) GROUP BY 1), "
    "m AS (SELECT menus.day, slot, cost FROM menus LEFT JOIN p USING (menu_id)) SELECT CAST(date_trunc('week', day) AS DATE)::VARCHAR AS week, slot, count(*) AS menus, round(sum(cost), 1) AS cost FROM m GROUP BY 1, 2",
)
def _(t):
    m = recipes.menu_costs(t.view("menus"), t.view("sides"), _costs(t), t.view("census"))
    return m.groupBy(F.trunc("day", "week").cast("string").alias("week"), "slot").agg(F.count("*").alias("menus"), stats.scaled_round(F.sum("cost"), 1).alias("cost"))


@query("QRY_04_recipe_cost_coverage", f"{ESTIMATE_SQL} SELECT CASE WHEN cost IS NOT NULL THEN 'priced' WHEN note = 'missing product or quantity' THEN 'no product' WHEN note = 'no invoice history' THEN 'no invoice' WHEN note = 'no pack' THEN 'unparseable pack' ELSE note END AS class, count(*) AS n FROM costed WHERE sub_recipe_id IS NULL GROUP BY 1")
def _(t):
    return recipes.cost_coverage(_costed(t))[0]


BLOCKED = "SELECT CASE WHEN cost IS NOT NULL THEN 'priced' WHEN note = 'missing product or quantity' THEN 'no product' WHEN note = 'no invoice history' THEN 'no invoice' WHEN note = 'no pack' THEN 'unparseable pack' ELSE note END AS class, product_id, name, ingredient_id FROM costed WHERE sub_recipe_id IS NULL"


def _expand_sql(roots: str, factor: str) -> str:
    """SQL: plain ingredients under the roots (r, recipe_id, scale), DEPTH sub-recipes deep."""
    return f"""x AS (WITH RECURSIVE w AS (SELECT r, recipe_id, scale, 0 AS level FROM {roots} UNION ALL SELECT w.r, i.sub_recipe_id, {factor}, level + 1 FROM w JOIN ing i ON i.recipe_id = w.recipe_id WHERE i.sub_recipe_id IS NOT NULL AND level < {recipes.DEPTH})
SELECT w.r, w.scale, i.* FROM w JOIN ing i ON i.recipe_id = w.recipe_id WHERE i.sub_recipe_id IS NULL)"""


MENU_RECIPES = "mr AS (SELECT menu_id, day, recipe_id FROM menus WHERE recipe_id IS NOT NULL UNION ALL SELECT s.menu_id, day, s.recipe_id FROM sides s JOIN menus USING (menu_id))"
ONCE = "mr AS (SELECT menu_id, day, recipe_id FROM menus WHERE recipe_id IS NOT NULL UNION SELECT s.menu_id, day, s.recipe_id FROM sides s JOIN menus USING (menu_id))"

CONSUMED = f"""WITH {views('menus', 'sides', 'census', 'recipes', 'ingredients', 'refs')}, {MENU_RECIPES}, u AS (SELECT u, f, {KINDS} AS kind FROM {UNIT_TABLE}), ing AS (SELECT * FROM ingredients WHERE sub_recipe_id IS NULL OR quantity IS NOT NULL),
roots AS (SELECT menu_id AS r, mr.recipe_id, coalesce(headcount, 30) / coalesce(nullif(serves, 0), 40)::DOUBLE AS scale FROM mr JOIN recipes USING (recipe_id) LEFT JOIN census USING (day)), {_expand_sql('roots', 'i.quantity::DOUBLE')},
y AS (SELECT x.*, quantity * scale AS scaled, coalesce(nullif(yield_pct, 0), ref_yield_pct) AS yy, CASE WHEN name = 'small ring' AND unit = 'each' THEN 2.5 WHEN ap_weight_oz > 0 AND lower(trim(ap_unit)) IN ('each', 'head', 'bunch') AND unit = 'each' THEN ap_weight_oz END AS oz FROM x LEFT JOIN refs USING (ref_id)),
z AS (SELECT *, CASE WHEN oz IS NOT NULL THEN scaled * oz WHEN yy > 0 THEN scaled / (yy / 100) ELSE scaled END AS amount, CASE WHEN oz IS NOT NULL THEN 'oz' ELSE unit END AS unit2 FROM y),
used AS (SELECT z.*, f, kind FROM z LEFT JOIN u ON u.u = unit2)"""


@query(
    "QRY_03_consumption_caveats",
    f"{CONSUMED} SELECT CASE WHEN product_id IS NULL THEN 'no product' WHEN quantity IS NULL THEN 'no quantity' ELSE 'unit without base' END AS caveat, count(*) AS n FROM used WHERE product_id IS NULL OR quantity IS NULL OR f IS NULL GROUP BY 1 UNION ALL SELECT 'sub-recipe without quantity', count(*) FROM ingredients WHERE sub_recipe_id IS NOT NULL AND quantity IS NULL HAVING count(*) > 0",
)
def _(t):
    return recipes.consumption(*[t.view(v) for v in ("menus", "sides", "recipes", "ingredients", "refs", "census")], pieces=PIECES)[1]


UNTIL = "1998-08-02"


@query(
    "QRY_01_order_guide",
    f"""WITH {views('menus', 'sides', 'census', 'recipes', 'ingredients', 'bought')}, {ONCE}, ing AS (SELECT * FROM ingredients), last AS (SELECT arg_max(headcount, day) AS h FROM census WHERE day <= DATE '{UNTIL}'),
roots AS (SELECT recipes.name AS r, mr.recipe_id, coalesce(headcount, (SELECT h FROM last), 30) / coalesce(nullif(serves, 0), 40)::DOUBLE AS scale FROM mr JOIN recipes USING (recipe_id) LEFT JOIN census USING (day)), {_expand_sql('roots', 'w.scale * coalesce(nullif(i.quantity, 0), 1)')},
d AS (SELECT product_id, unit, sum(quantity * scale) AS quantity FROM x WHERE product_id IS NOT NULL AND coalesce(quantity, 0) <> 0 GROUP BY 1, 2), c AS (SELECT product_id, array_to_string(list_sort(list_distinct(list(r)))[1:3], ',') AS contributors FROM x WHERE product_id IS NOT NULL AND coalesce(quantity, 0) <> 0 GROUP BY 1),
l AS (SELECT product_id, vendor, unit_price, day FROM bought QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY day DESC, seq DESC) = 1)
SELECT vendor, d.product_id, unit, round(quantity, 3) AS quantity, round(unit_price * quantity, 1) AS line_total, contributors, CAST(day AS VARCHAR) AS last_day FROM d JOIN c USING (product_id) LEFT JOIN l USING (product_id)""",
)
def _(t):
    g = recipes.order_guide(*[t.view(v) for v in ("menus", "sides", "recipes", "ingredients", "census", "bought")], until=UNTIL)
    return g.select("vendor", F.col("product_id").cast("long").alias("product_id"), "unit", stats.scaled_round(F.col("quantity"), 3).alias("quantity"), stats.scaled_round(F.col("line_total"), 1).alias("line_total"), F.array_join("contributors", ",").alias("contributors"), F.col("last_day").cast("string").alias("last_day"))


STATES = f"""WITH {views('menus', 'sides', 'ingredients', 'freetext')}, {ONCE}, ing AS (SELECT * FROM ingredients), roots AS (SELECT menu_id AS r, recipe_id, 1 AS scale FROM mr), {_expand_sql('roots', 'w.scale')},
s AS (SELECT m.menu_id, m.day, CASE WHEN l.r IS NOT NULL THEN CASE WHEN whole THEN 'covered' ELSE 'incomplete' END WHEN f.menu_id IS NOT NULL THEN 'freetext only' ELSE 'unlinked' END AS state FROM menus m LEFT JOIN (SELECT DISTINCT r FROM roots) l ON l.r = m.menu_id
LEFT JOIN (SELECT r, bool_and(product_id IS NOT NULL AND quantity IS NOT NULL) AS whole FROM x GROUP BY 1) w ON w.r = m.menu_id LEFT JOIN freetext f ON f.menu_id = m.menu_id)"""


@query("QRY_19_recipe_coverage", f"{STATES} SELECT CAST(date_trunc('month', day) AS DATE)::VARCHAR AS month, round_even(100.0::DOUBLE * count(*) FILTER (state = 'covered') / count(*), 1) AS stock, round_even(100.0::DOUBLE * count(*) FILTER (state IN ('covered', 'incomplete')) / count(*), 1) AS flow FROM s GROUP BY 1")
def _(t):
    s = recipes.coverage_states(t.view("menus"), t.view("sides"), t.view("ingredients"), t.view("freetext")).join(t.view("menus").select("menu_id", "day"), "menu_id")
    part = lambda c: stats.percent_clipped(F.count_if(c), F.count("*"))
    return s.groupBy(F.trunc("day", "month").cast("string").alias("month")).agg(part(F.col("state") == "covered").alias("stock"), part(F.col("state").isin("covered", "incomplete")).alias("flow"))


SCORED = """c AS (SELECT p_partkey AS recipe_id, CASE WHEN p_size = 1 THEN NULL ELSE p_size END AS days, p_brand AS protein, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'x' END AS dinner, p_partkey % 4 = 0 AS same_day, p_partkey % 5 = 0 AS same_fat, (p_partkey % 100) / 100.0::DOUBLE AS rate, p_partkey % 6 AS samples, CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS pop FROM part),
d AS (SELECT recipe_id, CASE WHEN days IS NULL OR days >= 30 THEN 4 WHEN days >= 14 THEN 3 WHEN days >= 7 THEN 1 ELSE -3 END + CASE WHEN dinner = protein THEN -4 ELSE 0 END + CASE WHEN same_day THEN -2 ELSE 0 END + CASE WHEN same_fat THEN -1 ELSE 0 END
 + CASE WHEN samples >= 3 THEN CASE WHEN rate >= 0.92 THEN 4 WHEN rate >= 0.8 THEN 2 WHEN rate >= 0.65 THEN -1 ELSE -3 END ELSE CASE pop WHEN 'high' THEN 3 WHEN 'medium' THEN 1 WHEN 'low' THEN -2 ELSE 0 END END AS score,
 1 + (dinner = protein)::INT + same_day::INT + same_fat::INT + CASE WHEN samples >= 3 OR pop IN ('high', 'low') THEN 1 ELSE 0 END AS reasons FROM c)"""


def _scored(t):
    k, part = F.col("p_partkey"), t.part
    return recipes.dish_scores(
        part.select(
            F.col("p_partkey").alias("recipe_id"), F.when(F.col("p_size") != 1, F.col("p_size")).alias("days_since"), F.col("p_brand").alias("protein"), F.when(k % 3 == 0, F.col("p_brand")).otherwise("x").alias("dinner_before"),
            F.when(k % 4 == 0, F.array("p_brand")).alias("day_proteins"), F.lit("light").alias("fat_health"), F.when(k % 5 == 0, F.array(F.lit("light"))).alias("day_fat_health"),
            ((k % 100) / 100.0).alias("rate"), (k % 6).alias("samples"), F.when(k % 4 == 0, "high").when(k % 4 == 1, "medium").when(k % 4 == 2, "low").alias("popularity"),
        )
    )


@query("UNT_26_dish_score", f"WITH {SCORED} SELECT recipe_id, score, reasons FROM d")
def _(t):
    return _scored(t).select("recipe_id", "score", F.size("reasons").alias("reasons"))


@query("QRY_12_dish_suggestions", f"WITH {SCORED}, r AS (SELECT p_partkey AS recipe_id, p_name AS name, p_size, p_brand FROM part), ok AS (SELECT recipe_id, name FROM r WHERE p_brand <> 'Brand#11' AND (p_size % 4 IN (0, 1) OR recipe_id % 9 = 0)) SELECT recipe_id, name, score FROM d JOIN ok USING (recipe_id) ORDER BY score DESC, name, recipe_id LIMIT 20")
def _(t):
    k = F.col("p_size") % 4
    slots = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("lunch"), F.lit("dinner"))).otherwise(F.array(F.lit("breakfast")))
    r = t.part.select(F.col("p_partkey").alias("recipe_id"), F.col("p_name").alias("name"), slots.alias("slots"), F.array("p_brand").alias("conflicts"), F.lit(True).alias("current"))
    linked = t.part.where("p_partkey % 9 = 0").select(F.col("p_partkey").alias("recipe_id"))
    ok = recipes.candidate_recipes(r, "dinner", linked, ["Brand#11"])
    return ok.select("recipe_id", "name").join(_scored(t), "recipe_id").select("recipe_id", "name", "score").orderBy(F.desc("score"), "name", "recipe_id").limit(20)


@query(
    "QRY_11_historical_waste",
    "WITH d AS (SELECT l_partkey AS dish, count(DISTINCT l_orderkey) AS services, sum(l_quantity) AS prepped, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS wasted FROM lineitem GROUP BY 1), r AS (SELECT *, CASE WHEN services >= 30 THEN 'regular' ELSE 'single' END AS kind, round(wasted / prepped, 6) AS share FROM d) "
    "SELECT kind, dish, services, share FROM r QUALIFY row_number() OVER (PARTITION BY kind ORDER BY share DESC, dish) <= 10",
)
def _(t):
    d = t.lineitem.groupBy(F.col("l_partkey").alias("dish")).agg(F.countDistinct("l_orderkey").alias("services"), F.sum("l_quantity").alias("prepped"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).alias("wasted"))
    r = d.select(F.when(F.col("services") >= 30, "regular").otherwise("single").alias("kind"), "dish", "services", F.round(F.col("wasted") / F.col("prepped"), 6).alias("share"))
    return relational.top_k(r, ["kind"], [F.desc("share"), F.col("dish")], 10).drop("rank")


WEEK = "1998-07-06"


@query(
    "QRY_16_menu_calendar",
    f"WITH {views('menus')}, n AS (SELECT o_orderkey AS menu_id, 'protein ' || (o_custkey % 4) AS protein FROM orders), s AS (SELECT day, slot, min(menu_id) AS menu_id, count(*) AS menus FROM menus WHERE day BETWEEN DATE '{WEEK}' AND DATE '{WEEK}' + 6 GROUP BY 1, 2), a AS (SELECT s.*, protein FROM s JOIN n USING (menu_id)), "
    f"grid AS (SELECT d::DATE AS day, slot FROM generate_series(DATE '{WEEK}', DATE '{WEEK}' + 6, INTERVAL 1 DAY) g(d), (VALUES ('breakfast'), ('lunch'), ('dinner')) v(slot)) "
    "SELECT g.day::VARCHAR AS day, g.slot, coalesce(a.menus, 0) AS menus, coalesce(a.protein = y.protein, FALSE) AS as_yesterday, coalesce(a.protein = l.protein AND g.slot = 'dinner', FALSE) AS as_lunch FROM grid g LEFT JOIN a USING (day, slot) LEFT JOIN a y ON y.day = g.day - 1 AND y.slot = 'dinner' LEFT JOIN a l ON l.day = g.day AND l.slot = 'lunch'",
)
def _(t):
    proteins = t.orders.select(F.col("o_orderkey").alias("menu_id"), F.concat(F.lit("protein "), (F.col("o_custkey") % 4).cast("string")).alias("protein"))
    days = t.view("menus").where(f"day BETWEEN DATE'{WEEK}' AND DATE'{WEEK}' + 6").groupBy("day", "slot").agg(F.min("menu_id").alias("menu_id"), F.count("*").alias("menus")).join(proteins, "menu_id")
    grid = t.spark.range(7).select(F.expr(f"date_add(DATE'{WEEK}', CAST(id AS INT))").alias("day"), F.explode(F.array(*map(F.lit, ("breakfast", "lunch", "dinner")))).alias("slot"))
    return relational.neighbour_rule(grid.join(days.drop("menu_id"), ["day", "slot"], "left"), "day", "slot", "protein").select(
        F.col("day").cast("string").alias("day"), "slot", F.coalesce("menus", F.lit(0)).alias("menus"), "as_yesterday", "as_lunch"
    )


@query(
    "QRY_17_kitchen_display",
    f"WITH {views('menus')}, t AS (SELECT o_orderkey AS menu_id, count(*) AS tasks, count(*) FILTER (l_linestatus = 'F') AS done FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT CASE WHEN day = DATE '{WEEK}' THEN 'today' ELSE 'next' END AS part, day::VARCHAR AS day, slot, CASE slot WHEN 'breakfast' THEN 1 WHEN 'lunch' THEN 2 ELSE 3 END AS place, "
    f"count(*) AS menus, coalesce(sum(tasks), 0)::BIGINT AS tasks, coalesce(sum(done), 0)::BIGINT AS done FROM menus LEFT JOIN t USING (menu_id) WHERE day BETWEEN DATE '{WEEK}' AND DATE '{WEEK}' + 6 GROUP BY ALL",
)
def _(t):
    tasks = t.lineitem.groupBy(F.col("l_orderkey").alias("menu_id")).agg(F.count("*").alias("tasks"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    m = t.view("menus").where(f"day BETWEEN DATE'{WEEK}' AND DATE'{WEEK}' + 6").join(tasks, "menu_id", "left")
    place = F.array_position(F.array(*map(F.lit, ("breakfast", "lunch", "dinner"))), F.col("slot"))
    rows = m.groupBy(F.when(F.col("day") == F.lit(WEEK).cast("date"), "today").otherwise("next").alias("part"), F.col("day").cast("string").alias("day"), "slot", place.alias("place"))
    return rows.agg(F.count("*").alias("menus"), F.coalesce(F.sum("tasks"), F.lit(0)).alias("tasks"), F.coalesce(F.sum("done"), F.lit(0)).alias("done")).orderBy("day", "place")


@query(
    "QRY_18_provided_nutrition",
    "WITH {LINES}, a AS (SELECT date_trunc('month', day)::DATE::VARCHAR AS month, l_quantity * 453.59237 * p_size / 100 AS protein, p_partkey % 4 = 0 AND p_partkey % 10 <> 0 AS ok FROM lines JOIN part ON p_partkey = l_partkey WHERE day BETWEEN DATE '1998-01-01' AND DATE '1998-06-30') SELECT month, round(sum(CASE WHEN ok THEN protein END), 2) AS protein, count(*) AS n FROM a GROUP BY 1",
)
def _(t):
    rows = t.lines_between("1998-01-01", "1998-06-30").join(t.part, F.col("p_partkey") == F.col("l_partkey")).withColumn("month", F.trunc("day", "month").cast("string"))
    rows = rows.withColumn("class", F.when(F.col("p_partkey") % 4 == 0, "weighed")).withColumn("protein", F.when(F.col("p_partkey") % 10 != 0, F.col("p_size").cast("double")))
    return quality.macros(rows, ["month"], "class", "l_quantity", "ext", ["protein"]).select("month", F.round("grams", 2).alias("protein"), "n")


# -- spend ------------------------------------------------------------------------------------------------------------


@query(
    "QRY_05_category_spend",
    "WITH {LINES}, g AS (SELECT p_type, count(*) AS n_lines, sum(ext)::DOUBLE AS spend, count(DISTINCT l_partkey) AS n_products FROM lines JOIN part ON p_partkey = l_partkey WHERE day BETWEEN DATE '1997-06-01' AND DATE '1997-06-30' GROUP BY 1) SELECT p_type, n_lines, spend, n_products, round(100.0 * n_lines / sum(n_lines) OVER (), 2) AS line_share, round(100.0 * spend / sum(spend) OVER (), 2) AS spend_share FROM g",
)
def _(t):
    month = t.lines_between("1997-06-01", "1997-06-30")
    # one row for each part first: what is shuffled is parts of the month, not lines
    by_part = month.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("ext").alias("ext"))
    g = by_part.join(t.part.select("p_partkey", "p_type"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_type")
    g = g.agg(F.sum("n").alias("n_lines"), F.sum("ext").cast("double").alias("spend"), F.count("*").alias("n_products"))
    # a row for each category: the window over all of them is small
    every = Window.partitionBy(F.lit(0))
    share = lambda c: F.round(F.coalesce(F.try_divide(100.0 * F.col(c), F.sum(c).over(every)), F.lit(0.0)), 2)
    return g.select("p_type", "n_lines", "spend", "n_products", share("n_lines").alias("line_share"), share("spend").alias("spend_share"))


@query(
    "QRY_05_spend_slices",
    "WITH {LINES}, g AS (SELECT p_brand, sum(ext)::DOUBLE AS spend FROM lines JOIN part ON p_partkey = l_partkey WHERE day BETWEEN DATE '1997-06-01' AND DATE '1997-06-30' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY spend DESC, p_brand) AS k FROM g) SELECT CASE WHEN k <= 7 THEN p_brand ELSE 'Other' END AS slice, round(sum(spend), 2) AS spend FROM r GROUP BY 1",
)
def _(t):
    by_part = t.lines_between("1997-06-01", "1997-06-30").groupBy("l_partkey").agg(F.sum("ext").alias("ext"))
    g = by_part.join(t.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand").agg(F.sum("ext").cast("double").alias("spend"))
    top = g.orderBy(F.desc("spend"), "p_brand").limit(7).select(F.col("p_brand").alias("_top"))
    slices = g.join(F.broadcast(top), F.col("p_brand") == F.col("_top"), "left").groupBy(F.coalesce("_top", F.lit("Other")).alias("slice"))
    return slices.agg(F.round(F.sum("spend"), 2).alias("spend"))




@query(
    "AGG_31_month_series_with_gaps",
    "WITH {LINES}, m AS (SELECT unnest(generate_series(DATE '1998-04-01', DATE '1998-07-01', INTERVAL 1 MONTH))::DATE AS month), ty AS (SELECT DISTINCT p_brand FROM part), s AS (SELECT p_brand, date_trunc('month', day)::DATE AS month, sum(ext)::DOUBLE AS spend FROM lines JOIN part ON p_partkey = l_partkey WHERE p_size > 45 GROUP BY 1, 2) SELECT p_brand, month::VARCHAR AS month, coalesce(spend, 0) AS spend FROM (SELECT * FROM ty, m) LEFT JOIN s USING (p_brand, month)",
)
def _(t):
    lines = t.lines_between("1998-04-01", "1998-07-31").join(t.part.where("p_size > 45"), F.col("p_partkey") == F.col("l_partkey"))
    s = lines.groupBy("p_brand", F.trunc("day", "month").alias("month")).agg(money("ext").alias("spend"))
    spine = t.part.select("p_brand").distinct().select("p_brand", F.explode(F.expr("sequence(DATE'1998-04-01', DATE'1998-07-01', interval 1 month)")).alias("month"))
    return spine.join(s, ["p_brand", "month"], "left").select("p_brand", F.col("month").cast("string").alias("month"), F.coalesce("spend", F.lit(0.0)).alias("spend"))


@query(
    "QRY_06_spend_versus_budget",
    "WITH {LINES}, s AS (SELECT date_trunc('month', day)::DATE m, sum(ext)::DOUBLE spend, sum(CASE WHEN l_returnflag <> 'R' THEN ext ELSE 0 END)::DOUBLE AS cached FROM lines GROUP BY 1), h AS (SELECT date_trunc('month', o_orderdate)::DATE m, arg_max(o_custkey % 50, (o_orderdate, o_orderkey)) AS heads FROM orders GROUP BY 1), m AS (SELECT unnest(generate_series(DATE '1998-04-01', DATE '1998-07-01', INTERVAL 1 MONTH))::DATE AS m) "
    "SELECT m::VARCHAR AS month, coalesce(CASE WHEN cached < 0.8 * spend THEN spend ELSE cached END, 0) AS spend, round(coalesce(heads, 0) * 346.67, 2) AS budget, round(coalesce(heads, 0) * 346.67 * CASE WHEN m = DATE '1998-07-01' THEN 18 / 31.0::DOUBLE ELSE 1 END, 2) AS pace FROM m LEFT JOIN s USING (m) LEFT JOIN h USING (m)",
)
def _(t):
    s = t.lines_between("1998-04-01", "1998-07-31").groupBy(F.trunc("day", "month").alias("month")).agg(money("ext").alias("spend"), F.sum(F.when(F.col("l_returnflag") != "R", F.col("ext")).otherwise(0)).cast("double").alias("cached"))
    h = t.orders.where(between("o_orderdate", "1998-04-01", "1998-07-31")).groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.max_by(F.col("o_custkey") % 50, F.struct("o_orderdate", "o_orderkey")).alias("heads"))
    return quality.budget_trend(s, h, "1998-07-18", 4, 346.67).select(F.col("month").cast("string").alias("month"), "spend", F.round("budget", 2).alias("budget"), F.round("pace", 2).alias("pace"))


@query(
    "AGG_17_weighted_macros",
    "WITH {LINES}, a AS (SELECT p_type, ext, l_quantity, p_size, CASE p_partkey % 4 WHEN 0 THEN 'weighed' WHEN 1 THEN 'counted_with_volume' WHEN 2 THEN 'counted_each' END AS class, p_partkey % 10 <> 0 AS known FROM lines JOIN part ON p_partkey = l_partkey), "
    "g AS (SELECT *, CASE class WHEN 'weighed' THEN l_quantity * 453.59237 WHEN 'counted_with_volume' THEN l_quantity * 29.5735 WHEN 'counted_each' THEN l_quantity * 50 END AS grams FROM a), "
    "s AS (SELECT p_type, sum(CASE WHEN known THEN grams * p_size / 100 END) AS protein, sum(CASE WHEN known THEN grams * (50 - p_size) / 100 END) AS fat, sum(CASE WHEN known AND grams IS NOT NULL THEN ext ELSE 0 END)::DOUBLE / sum(ext)::DOUBLE AS coverage FROM g GROUP BY 1) "
    "SELECT p_type, 'protein' AS macro, round(protein, 2) AS grams, round(coverage, 6) AS coverage FROM s UNION ALL SELECT p_type, 'fat', round(fat, 2), round(coverage, 6) FROM s",
)
def _(t):
    k = F.col("p_partkey") % 4
    rows = t.lines.join(t.part, F.col("p_partkey") == F.col("l_partkey")).withColumn("class", F.when(k == 0, "weighed").when(k == 1, "counted_with_volume").when(k == 2, "counted_each"))
    known = F.when(F.col("p_partkey") % 10 != 0, F.col("p_size").cast("double"))
    m = quality.macros(rows.withColumn("protein", known).withColumn("fat", 50 - known), ["p_type"], "class", "l_quantity", "ext", ["protein", "fat"])
    return m.select("p_type", "macro", F.round("grams", 2).alias("grams"), F.round("coverage", 6).alias("coverage"))


@query(
    "WIN_05_neighbour_day",
    "WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 2 WHEN 0 THEN 'lunch' ELSE 'dinner' END AS slot, min('p' || (o_custkey % 4)) AS protein FROM orders GROUP BY 1, 2) "
    "SELECT a.day::VARCHAR AS day, a.slot, coalesce(a.protein = y.protein, FALSE) AS as_yesterday, coalesce(a.protein = l.protein AND a.slot = 'dinner', FALSE) AS as_lunch FROM a LEFT JOIN a y ON y.day = a.day - 1 AND y.slot = 'dinner' LEFT JOIN a l ON l.day = a.day AND l.slot = 'lunch'",
)
def _(t):
    slot = F.when(F.col("o_orderkey") % 2 == 0, "lunch").otherwise("dinner")
    a = t.orders.groupBy(F.to_date("o_orderdate").alias("day"), slot.alias("slot")).agg(F.min(F.concat(F.lit("p"), (F.col("o_custkey") % 4).cast("string"))).alias("protein"))
    return relational.neighbour_rule(a, "day", "slot", "protein").select(F.col("day").cast("string").alias("day"), "slot", "as_yesterday", "as_lunch")


@query("AGG_30_stock_coverage", f"{STATES} SELECT state, count(*) AS n FROM s GROUP BY 1")
def _(t):
    return recipes.coverage_states(t.view("menus"), t.view("sides"), t.view("ingredients"), t.view("freetext")).groupBy("state").agg(F.count("*").alias("n"))


@query(
    "QRY_03_consumption",
    f"{CONSUMED} SELECT product_id, CASE kind WHEN 'weight' THEN 'oz' WHEN 'volume' THEN 'fl_oz' WHEN 'count' THEN 'ct' ELSE unit2 END AS base_unit, round(sum(coalesce(amount * f, amount)), 3) AS quantity FROM used WHERE product_id IS NOT NULL AND quantity IS NOT NULL GROUP BY 1, 2",
)
def _(t):
    used, _ = recipes.consumption(*[t.view(v) for v in ("menus", "sides", "recipes", "ingredients", "refs", "census")], pieces=PIECES)
    return used.select(F.col("product_id").cast("long").alias("product_id"), "base_unit", stats.scaled_round(F.col("quantity"), 3).alias("quantity"))


@query(
    "AGG_19_classified_count",
    f"{ESTIMATE_SQL}, k AS ({BLOCKED}), b AS (SELECT class, product_id, count(*) AS n FROM k WHERE class <> 'priced' AND product_id IS NOT NULL GROUP BY 1, 2) "
    "SELECT 'blocker' AS kind, class, product_id AS id, n FROM b QUALIFY row_number() OVER (PARTITION BY class ORDER BY n DESC, product_id) <= 10 UNION ALL "
    "SELECT 'sample', class, NULL, rank FROM (SELECT class, row_number() OVER (PARTITION BY class ORDER BY ingredient_id) AS rank FROM k) WHERE rank <= 8 UNION ALL SELECT 'count', class, NULL, count(*) FROM k GROUP BY 2",
)
def _(t):
    counts, first, worst = recipes.cost_coverage(_costed(t))
    none = F.lit(None).cast("long")
    return (
        worst.select(F.lit("blocker").alias("kind"), "class", F.col("product_id").cast("long").alias("id"), "n")
        .unionByName(first.select(F.lit("sample").alias("kind"), "class", none.alias("id"), F.col("rank").alias("n")))
        .unionByName(counts.select(F.lit("count").alias("kind"), "class", none.alias("id"), "n"))
    )
