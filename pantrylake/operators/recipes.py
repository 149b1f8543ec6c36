"""Recipes: what they cost, what they use, and what must be ordered for a range of menus.

Tables: recipes (recipe_id, name, serves); ingredients (ingredient_id, recipe_id, name, product_id, sub_recipe_id,
quantity, unit, yield_pct, ref_id); references (ref_id, ref_yield_pct, oz_per_cup, ap_weight_oz, ap_unit); lines
(product_id, vendor, day, seq, unit_price, case_size, raw_description, per_pound, count_low, count_high, flagged);
products (product_id, name, default_case_size); menus (menu_id, day, slot, recipe_id); sides (menu_id, recipe_id);
census (day, headcount).

Sub-recipes are expanded level by level, DEPTH deep, by one join for each level; deeper ones are reported, not followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats, tables, units
from .relational import latest_per_key, latest_qualifying
from .staging import cut

DEPTH, SERVES, HEADCOUNT = 4, 40, 30


def usable_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Each product's line to price by: of its newest five that are not flagged, the first with a pack that parses (its
    own or, where it states none, the product's) or a price by the pound; else the newest."""
    clean = lines.where(~F.coalesce("flagged", F.lit(False))).join(products.select("product_id", F.col("name").alias("product"), "default_case_size"), "product_id")
    stated = F.coalesce(F.nullif(F.col("case_size"), F.lit("")), F.col("default_case_size"))
    fits = units.parse_pack(stated).isNotNull() | F.col("per_pound").isNotNull()
    return latest_qualifying(clean, ["product_id"], [F.desc("day"), F.desc("seq")], 5, F.coalesce(fits, F.lit(False)))


def estimated(ingredients: DataFrame, lines: DataFrame, products: DataFrame, references: DataFrame, densities: dict | None = None, pieces: dict | None = None) -> DataFrame:
    """ingredients with cost and note: the first of the line's pack candidates that prices it, else, for pieces of a good
    whose reference gives a piece's weight, the same by that weight (bought weight, so without yield)."""
    densities, pieces = (tables.OUNCES_PER_CUP if densities is None else densities), (tables.PIECE_OUNCES if pieces is None else pieces)
    # product_id of `lines` is kept apart, and so are its names
    use = usable_lines(lines, products).select(F.col("product_id").alias("_p"), "unit_price", "case_size", "raw_description", "per_pound", "count_low", "count_high", "product", "default_case_size")
    refs = references.select(F.col("ref_id").alias("_r"), "ref_yield_pct", "oz_per_cup", "ap_weight_oz", "ap_unit")
    both = ingredients.join(use, F.col("product_id") == F.col("_p"), "left").join(refs, F.col("ref_id") == F.col("_r"), "left")
    found = units.pack_candidates(F.col("case_size"), F.col("raw_description"), F.col("default_case_size"), F.col("product"))
    both = both.withColumn("_packs", F.when(F.size(found) > 0, found).otherwise(F.array(F.coalesce("case_size", F.lit("")))))
    both = both.withColumn("_yield", F.coalesce("ref_yield_pct", "yield_pct"))

    def tried(quantity: Column, unit: Column, yield_pct: Column | None) -> Column:
        return F.transform("_packs", lambda p: units.ingredient_cost(quantity, unit, F.col("name"), F.col("unit_price"), p, yield_pct, F.col("oz_per_cup"), F.col("per_pound"), F.col("count_low"), F.col("count_high"), densities, pieces))

    def first_priced(each: str) -> Column:
        return F.coalesce(F.get(F.filter(each, lambda c: c["cost"].isNotNull()), 0), F.element_at(each, -1))

    made = lambda note: F.struct(F.lit(None).cast("double").alias("cost"), F.lit(note).alias("note"))
    both = cut(both)  # the candidates are read once for each attempt
    both = both.withColumn("_each", tried(F.col("quantity"), F.col("unit"), F.col("_yield"))).withColumn("_one", first_priced("_each"))
    by_piece = F.lower(F.trim(F.coalesce("unit", F.lit("")))).isin("medium", "large", "small", "ea", "each") & (F.col("ap_weight_oz") > 0) & F.lower(F.trim("ap_unit")).isin("each", "head", "bunch")
    again = F.col("_one.cost").isNull() & F.coalesce(by_piece, F.lit(False))
    both = both.withColumn("_each", F.when(again, tried(F.col("quantity") * F.col("ap_weight_oz"), F.lit("oz"), None))).withColumn("_two", first_priced("_each"))
    chosen = (
        F.when(F.col("product_id").isNull() | F.col("quantity").isNull(), made("missing product or quantity"))
        .when(F.col("_p").isNull(), made("no invoice history"))
        .when(F.col("_two.cost").isNotNull(), F.col("_two"))
        .otherwise(F.col("_one"))
    )
    # roll-ups and reports read the costs several times
    return cut(both.withColumn("_c", chosen).select(*ingredients.columns, F.col("_c.cost").alias("cost"), F.col("_c.note").alias("note")))


def recipe_costs(recipes: DataFrame, costed: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(recipe_id, total, per_serving, priced, n, coverage): a sub-recipe counts by its total times quantity over servings.

    costed: ingredients with cost. Totals come bottom up: a level's totals are known once its sub-recipes' are, so after
    as many rounds as the recipes are deep (at most depth + 1) nothing changes.
    """
    serves = recipes.select(F.col("recipe_id").alias("_id"), F.nullif(F.col("serves"), F.lit(0)).alias("_serves"))
    own = costed.where("sub_recipe_id IS NULL").groupBy("recipe_id").agg(F.sum("cost").alias("_own"), F.count("cost").alias("_priced"), F.count("*").alias("_n"))
    subs = costed.where("sub_recipe_id IS NOT NULL").select("recipe_id", "sub_recipe_id", "quantity")
    subs = subs.join(serves, F.col("sub_recipe_id") == F.col("_id"), "left").drop("_id")
    base = recipes.select("recipe_id").join(own, "recipe_id", "left").select("recipe_id", F.coalesce("_own", F.lit(0.0)).alias("_own"), F.coalesce("_priced", F.lit(0)).alias("_priced"), F.coalesce("_n", F.lit(0)).alias("_n"))
    totals = base.select("recipe_id", F.col("_own").alias("total"))
    parts = None
    for _ in range(depth):
        known = totals.select(F.col("recipe_id").alias("_sub"), F.col("total").alias("_total"))
        part = subs.join(known, F.col("sub_recipe_id") == F.col("_sub"), "left")
        value = F.when((F.col("quantity") != 0) & (F.col("_total") != 0), F.col("_total") * F.col("quantity") / F.col("_serves"))
        parts = part.groupBy("recipe_id").agg(F.sum(value).alias("_subs"), F.count(value).alias("_sub_priced"), F.count("*").alias("_sub_n"))
        totals = base.join(parts, "recipe_id", "left").select("recipe_id", (F.col("_own") + F.coalesce("_subs", F.lit(0.0))).alias("total"))
    out = base.join(parts, "recipe_id", "left").join(serves, F.col("recipe_id") == F.col("_id"), "left")
    total = F.col("_own") + F.coalesce("_subs", F.lit(0.0))
    priced, n = F.col("_priced") + F.coalesce("_sub_priced", F.lit(0)), F.col("_n") + F.coalesce("_sub_n", F.lit(0))
    return out.select("recipe_id", total.alias("total"), (total / F.col("_serves")).alias("per_serving"), priced.alias("priced"), n.alias("n"), F.coalesce(F.try_divide(priced, n), F.lit(0.0)).alias("coverage"))


def menu_recipes(menus: DataFrame, sides: DataFrame, once: bool) -> DataFrame:
    """(menu_id, day, slot, recipe_id): the main recipe and the sides of each menu; once: a recipe that is both counts once."""
    main = menus.where(F.col("recipe_id").isNotNull()).select("menu_id", "day", "slot", "recipe_id")
    more = sides.join(menus.select("menu_id", "day", "slot"), "menu_id").select("menu_id", "day", "slot", "recipe_id")
    both = main.unionByName(more)
    return both.dropDuplicates(["menu_id", "recipe_id"]) if once else both


def with_headcount(rows: DataFrame, census: DataFrame, default: int | None = HEADCOUNT, until: str | None = None) -> DataFrame:
    """rows with the day's headcount; a day without one has the latest known until a date (or `default`)."""
    fallback = F.lit(default)
    counts = census.select(F.col("day").alias("_day"), "headcount")
    out = rows.join(counts, F.col("day") == F.col("_day"), "left").drop("_day")
    if until is not None:
        last = census.where(F.col("day") <= F.lit(until).cast("date")).agg(F.max_by("headcount", "day").alias("_last"))  # one row
        out = out.crossJoin(F.broadcast(last))
        return out.withColumn("headcount", F.coalesce("headcount", "_last", fallback)).drop("_last")
    return out.withColumn("headcount", F.coalesce("headcount", fallback))


def menu_costs(menus: DataFrame, sides: DataFrame, costs: DataFrame, census: DataFrame) -> DataFrame:
    """(menu_id, day, slot, cost): the recipes' costs a serving times the headcount; null if none is priced."""
    rows = with_headcount(menu_recipes(menus, sides, once=False), census).join(costs.select("recipe_id", "per_serving"), "recipe_id", "left")
    cost = F.when(F.coalesce("per_serving", F.lit(0.0)) != 0, stats.cents_even(F.col("per_serving") * F.col("headcount")))
    sums = rows.groupBy("menu_id").agg(F.sum(cost).alias("cost"))
    return menus.select("menu_id", "day", "slot").join(sums, "menu_id", "left")


def _expanded(roots: DataFrame, ingredients: DataFrame, factor: Column, depth: int) -> DataFrame:
    """(*root columns, scale, ingredient columns) of all plain ingredients under each root, and of what lies too deep.

    roots: (root columns..., recipe_id, scale); factor: a sub-recipe's scale, from scale, quantity and serves.
    """
    keep = [c for c in roots.columns if c not in ("recipe_id", "scale")]
    level, found = roots.withColumn("level", F.lit(0)), None
    own = [c for c in ingredients.columns if c != "recipe_id"]
    for k in range(depth + 1):
        met = level.select(*keep, "scale", "level", F.col("recipe_id").alias("_recipe")).join(ingredients.withColumnRenamed("recipe_id", "_of"), F.col("_recipe") == F.col("_of")).drop("_of")
        leaves = met.where("sub_recipe_id IS NULL").select(*keep, "scale", "level", *own)
        found = leaves if found is None else found.unionByName(leaves)
        level = met.where("sub_recipe_id IS NOT NULL").select(*keep, F.col("sub_recipe_id").alias("recipe_id"), factor.alias("scale"), F.lit(k + 1).alias("level"))
    return found


def consumption(menus: DataFrame, sides: DataFrame, recipes: DataFrame, ingredients: DataFrame, references: DataFrame, census: DataFrame, pieces: dict | None = None, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """((product_id, base_unit, quantity), (caveat, n)): what the menus used, in ounces, fluid ounces, counts or, where a
    unit is none of these, in that unit.

    A recipe is scaled from its servings to the headcount. "Two batches" of a sub-recipe are two times its servings, so
    its ingredients come twice whatever the headcount is. The literal yield goes before the reference's; pieces by
    weight are bought weights, so without yield.
    """
    pieces = tables.PIECE_OUNCES if pieces is None else pieces
    serves = F.coalesce(F.nullif(F.col("serves"), F.lit(0)), F.lit(SERVES))
    rows = with_headcount(menu_recipes(menus, sides, once=False), census).join(recipes.select("recipe_id", serves.alias("_serves")), "recipe_id")
    roots = rows.select("menu_id", "recipe_id", (F.col("headcount") / F.col("_serves")).alias("scale"))
    # a batch is the sub-recipe's own servings over its own servings: its scale is the quantity alone
    found = _expanded(roots, ingredients.where("sub_recipe_id IS NULL OR quantity IS NOT NULL"), F.col("quantity").cast("double"), depth)
    refs = references.select(F.col("ref_id").alias("_r"), "ref_yield_pct", "ap_weight_oz", "ap_unit")
    found = found.join(refs, F.col("ref_id") == F.col("_r"), "left")
    scaled = F.col("quantity").cast("double") * F.col("scale")
    bought = units.as_purchased(scaled, F.coalesce(F.nullif(F.col("yield_pct"), F.lit(0)), F.col("ref_yield_pct")))
    each = units.piece_ounces(F.col("name"), F.col("unit"), pieces)
    by_reference = (F.col("ap_weight_oz") > 0) & F.lower(F.trim("ap_unit")).isin("each", "head", "bunch") & units.normal_unit(F.col("unit")).isin("medium", "large", "small", "ea", "each")
    ounces = F.coalesce(each, F.when(F.coalesce(by_reference, F.lit(False)), F.col("ap_weight_oz").cast("double")))
    amount, unit = F.when(ounces.isNotNull(), scaled * ounces).otherwise(bought), F.when(ounces.isNotNull(), "oz").otherwise(F.col("unit"))
    base = units.to_base(amount, unit)
    what = F.when(F.col("product_id").isNull(), "no product").when(F.col("quantity").isNull(), "no quantity").when(base.isNull(), "unit without base")
    found = found.select("product_id", F.coalesce(base, amount).alias("quantity"), F.coalesce(units.base_unit(unit), F.nullif(unit, F.lit("")), F.lit("?")).alias("base_unit"), what.alias("caveat"))
    skipped = ingredients.where("sub_recipe_id IS NOT NULL AND quantity IS NULL").select(F.lit("sub-recipe without quantity").alias("caveat"))
    caveats = found.where("caveat IS NOT NULL").select("caveat").unionByName(skipped).groupBy("caveat").agg(F.count("*").alias("n"))
    used = found.where(F.col("product_id").isNotNull() & F.col("quantity").isNotNull() & ~F.coalesce(F.col("caveat").isin("no product", "no quantity"), F.lit(False)))
    return used.groupBy("product_id", "base_unit").agg(F.sum("quantity").alias("quantity")), caveats


def order_guide(menus: DataFrame, sides: DataFrame, recipes: DataFrame, ingredients: DataFrame, census: DataFrame, lines: DataFrame, until: str, depth: int = DEPTH) -> DataFrame:
    """(vendor, product_id, unit, quantity, unit_price, line_total, contributors, last_day): what to order for the menus,
    by the vendor of each product's newest line; vendor is null for products never bought.

    A recipe counts once on a menu. Sub-recipes are scaled by their quantity (none: 1). As in the page it stands for, the
    line total is the case price times the recipe's quantity in its own unit.
    """
    serves = F.coalesce(F.nullif(F.col("serves"), F.lit(0)), F.lit(SERVES))
    rows = with_headcount(menu_recipes(menus, sides, once=True), census, until=until).join(recipes.select("recipe_id", F.col("name").alias("recipe"), serves.alias("_serves")), "recipe_id")
    roots = rows.select("recipe", "recipe_id", (F.col("headcount") / F.col("_serves")).alias("scale"))
    batches = F.col("scale") * F.coalesce(F.nullif(F.col("quantity").cast("double"), F.lit(0.0)), F.lit(1.0))
    found = _expanded(roots, ingredients, batches, depth).where("product_id IS NOT NULL AND quantity IS NOT NULL AND quantity != 0")
    demand = found.groupBy("product_id", F.coalesce("unit", F.lit("")).alias("unit")).agg(F.sum(F.col("quantity").cast("double") * F.col("scale")).alias("quantity"))
    names = found.groupBy("product_id").agg(F.slice(F.sort_array(F.collect_set("recipe")), 1, 3).alias("contributors"))
    newest = latest_per_key(lines, ["product_id"], [F.desc("day"), F.desc("seq")]).select(F.col("product_id").alias("_p"), "vendor", "unit_price", F.col("day").alias("last_day"))
    out = demand.join(names, "product_id").join(newest, F.col("product_id") == F.col("_p"), "left")
    return out.select("vendor", "product_id", "unit", "quantity", "unit_price", F.when(F.coalesce("unit_price", F.lit(0.0)) != 0, F.col("unit_price") * F.col("quantity")).alias("line_total"), "contributors", "last_day")


BLOCKERS = {
    "missing product or quantity": "no product", "no invoice history": "no invoice", "no price": "no invoice", "no pack": "unparseable pack",
    "no density": "no density", "incompatible units": "incompatible units",
}


def cost_coverage(costed: DataFrame, samples: int = 8, top: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((class, n), (class, name, rank), (class, product_id, n)): plain ingredients by what prices or blocks them, the
    first samples of each class, and the products that block most."""
    kind = F.when(F.col("cost").isNotNull(), "priced").otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BLOCKERS.items() for x in kv]), F.col("note")), F.lit("other")))
    rows = costed.where("sub_recipe_id IS NULL").withColumn("class", kind)
    counts = rows.groupBy("class").agg(F.count("*").alias("n"))
    from .relational import top_k

    first = top_k(rows.select("class", "name", "ingredient_id"), ["class"], [F.col("ingredient_id")], samples).select("class", "name", "rank")
    blocked = rows.where("class != 'priced' AND product_id IS NOT NULL").groupBy("class", "product_id").agg(F.count("*").alias("n"))
    worst = top_k(blocked, ["class"], [F.desc("n"), F.col("product_id")], top).select("class", "product_id", "n")
    return counts, first, worst


def coverage_states(menus: DataFrame, sides: DataFrame, ingredients: DataFrame, freetext: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(menu_id, state): covered (every ingredient under its recipes has a product and a quantity), incomplete, freetext
    only (no recipe, but components in words), or unlinked.

    freetext: (menu_id).
    """
    roots = menu_recipes(menus, sides, once=True).select("menu_id", "recipe_id").withColumn("scale", F.lit(1.0))
    found = _expanded(roots, ingredients, F.col("scale"), depth)
    whole = found.groupBy("menu_id").agg(F.every(F.col("product_id").isNotNull() & F.col("quantity").isNotNull()).alias("_whole"))
    linked = roots.select(F.col("menu_id").alias("_m")).distinct()
    words = freetext.select(F.col("menu_id").alias("_f")).distinct()
    out = menus.select("menu_id").join(linked, F.col("menu_id") == F.col("_m"), "left").join(words, F.col("menu_id") == F.col("_f"), "left").join(whole, "menu_id", "left")
    state = F.when(F.col("_m").isNotNull(), F.when(F.coalesce("_whole", F.lit(False)), "covered").otherwise("incomplete")).when(F.col("_f").isNotNull(), "freetext only").otherwise("unlinked")
    return out.select("menu_id", state.alias("state"))


def dish_scores(candidates: DataFrame) -> DataFrame:
    """(recipe_id, score, reasons): candidates for a slot, by how long ago they were served, proteins beside them, the
    fat of the day's other dishes, and how popular they are.

    candidates: (recipe_id, days_since, protein, dinner_before, day_proteins array, fat_health, day_fat_health array,
    rate, samples, popularity). A learned rate over 3 samples or more goes before the popularity that was noted.
    """
    days, rate = F.col("days_since"), F.col("rate")
    none = F.array().cast("array<string>")
    learned = rate.isNotNull() & (F.col("samples") >= 3)
    said = F.nullif(F.col("protein"), F.lit(""))
    groups = [
        [(days.isNull(), 4, "never served"), (days >= 30, 4, "not in 30 days"), (days >= 14, 3, "not in 14 days"), (days >= 7, 1, "not in 7 days"), (F.lit(True), -3, "served this week")],
        [(said == F.col("dinner_before"), -4, "same protein as dinner before")],
        [(F.array_contains(F.coalesce("day_proteins", none), said), -2, "same protein that day")],
        [(F.array_contains(F.coalesce("day_fat_health", none), F.nullif(F.col("fat_health"), F.lit(""))), -1, "same fat and health that day")],
        [
            (learned & (rate >= 0.92), 4, "learned very popular"), (learned & (rate >= 0.80), 2, "learned popular"), (learned & (rate >= 0.65), -1, "learned fair"), (learned, -3, "learned unpopular"),
            (F.col("popularity") == "high", 3, "popular"), (F.col("popularity") == "medium", 1, None), (F.col("popularity") == "low", -2, "unpopular"),
        ],
    ]
    score, reasons = F.lit(0), []
    for rules in groups:
        points, why = None, None
        for hit, value, reason in rules:
            hit = F.coalesce(hit, F.lit(False))
            points = F.when(hit, value) if points is None else points.when(hit, value)
            why = F.when(hit, F.lit(reason)) if why is None else why.when(hit, F.lit(reason))
        score, reasons = score + F.coalesce(points, F.lit(0)), [*reasons, why]
    return candidates.select("recipe_id", score.cast("long").alias("score"), F.array_compact(F.array(*reasons)).alias("reasons"))


def candidate_recipes(recipes: DataFrame, slot: str, linked: DataFrame, conflicts: list[str]) -> DataFrame:
    """Recipes that a slot may have: those served in it before, and current ones whose slots allow it (no list: any),
    without those that hold a conflict. recipes: (recipe_id, slots array, conflicts array, current); linked: (recipe_id).
    """
    none = F.array().cast("array<string>")
    slots = F.coalesce("slots", none)
    allowed = recipes.where(F.coalesce("current", F.lit(False)) & ((F.size(slots) == 0) | F.array_contains(slots, slot))).select("recipe_id")
    ids = allowed.unionByName(linked.select("recipe_id")).distinct()
    bad = F.arrays_overlap(F.coalesce("conflicts", none), F.array(*map(F.lit, conflicts))) if conflicts else F.lit(False)
    return recipes.where(~bad).join(ids, "recipe_id", "left_semi")
