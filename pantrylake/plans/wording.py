"""Wordings, packs, units and costs over derived descriptions, with SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy, stats, tables, text, units
from ..operators import similarity
from .base import money, query, views

WORDING = f"WITH {views('wording')}"


def _values(table: dict, *names: str) -> str:
    rows = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(float(x)) for x in (*(k if isinstance(k, tuple) else (k,)), v)) + ")" for k, v in table.items())
    return f"(VALUES {rows}) v({', '.join(names)})"


# -- words ------------------------------------------------------------------------------------------------------------

ENDINGS = "('rries'), ('ovies'), ('atoes'), ('goes'), ('ches'), ('shes'), ('xes'), ('ies'), ('oes'), ('s'), ('ss'), ('')"
STEM_SQL = (
    "CASE WHEN length({w}) >= 6 AND {w} LIKE '%rries' OR length({w}) >= 7 AND {w} LIKE '%ovies' THEN left({w}, length({w}) - 3) || 'y' "
    "WHEN length({w}) >= 6 AND {w} LIKE '%atoes' OR length({w}) >= 5 AND ({w} LIKE '%goes' OR {w} LIKE '%ches' OR {w} LIKE '%shes') OR length({w}) >= 4 AND {w} LIKE '%xes' THEN left({w}, length({w}) - 2) "
    "WHEN length({w}) >= 4 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END"
)


@query("STR_03_stem", f"WITH w AS (SELECT DISTINCT lower(left(split_part(p_name, ' ', 1), 1 + p_size % 4)) || x AS w FROM part, (VALUES {ENDINGS}) v(x)) SELECT w, {STEM_SQL.format(w='w')} AS stem FROM w")
def _(t):
    ends = F.explode(F.array(*[F.lit(x) for x in ("rries", "ovies", "atoes", "goes", "ches", "shes", "xes", "ies", "oes", "s", "ss", "")]))
    start = F.lower(F.substr(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(1), 1 + F.col("p_size") % 4))
    w = t.part.select(start.alias("a")).distinct().select("a", ends.alias("e")).select(F.concat("a", "e").alias("w")).distinct()
    return w.select("w", text.stem(F.col("w")).alias("stem"))


@query(
    "STR_04_naive_stems",
    "WITH w AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) || x AS w FROM part, (VALUES ('s'), ('es'), ('ies'), ('ss'), ('')) v(x)) SELECT w, CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END AS plain, "
    "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 4 AND w LIKE '%es' THEN left(w, length(w) - 2) WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS endings, "
    "rtrim(w, 's') AS stripped FROM w",
)
def _(t):
    ends = F.explode(F.array(*map(F.lit, ("s", "es", "ies", "ss", ""))))
    w = t.part.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("a")).distinct().select("a", ends.alias("e")).select(F.concat("a", "e").alias("w")).distinct()
    c = F.col("w")
    return w.select("w", text.naive_stem(c).alias("plain"), text.ending_stem(c).alias("endings"), text.stripped_stem(c).alias("stripped"))


SHORT = {"small": "SM", "large": "LRG", "red": "GRL MRK", "blue": "WHL M", "ring": "B/L"}
SHORTENED = "upper(p_name)"
for _k, _v in SHORT.items():
    SHORTENED = f"replace({SHORTENED}, '{_k.upper()}', '{_v}')"
BACK = "x"
for _v in ("GRL MRK", "WHL M", "LRG", "B/L", "SM"):
    BACK = f"regexp_replace({BACK}, '(^|[^A-Za-z])({_v})($|[^A-Za-z])', '\\1{tables.ABBREVIATIONS[_v]}\\3', 'g')"


@query("STR_06_abbreviation_expansion", f"WITH a AS (SELECT p_partkey, '5' || {SHORTENED} || ' LRGE 2SM' AS x FROM part) SELECT p_partkey, {BACK} AS name FROM a")
def _(t):
    short = F.upper("p_name")
    for k, v in SHORT.items():
        short = F.replace(short, F.lit(k.upper()), F.lit(v))
    return t.part.select("p_partkey", text.expanded(F.concat(F.lit("5"), short, F.lit(" LRGE 2SM"))).alias("name"))


@query("STR_09_annotation_strip", f"{WORDING} SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(description || CASE WHEN size > 25 THEN ' (NO SPLITS) , fresh' ELSE ' SPLIT ONLY' END, '\\(?\\s*(NO SPLITS|SPLIT ONLY|MIN ORDER)\\s*\\)?', '', 'g'), '\\s+([,;/])', '\\1', 'g'), '\\s+', ' ', 'g')) AS name FROM wording")
def _(t):
    w = t.view("wording")
    return w.select("id", text.annotations_stripped(F.concat("description", F.when(F.col("size") > 25, " (NO SPLITS) , fresh").otherwise(" SPLIT ONLY"))).alias("name"))


@query("STR_10_accent_fold", "SELECT p_partkey, strip_accents(p_name || CASE p_size % 4 WHEN 0 THEN ' crème brûlée' WHEN 1 THEN ' jalapeño' WHEN 2 THEN ' Ångström' ELSE ' plain' END) AS name FROM part")
def _(t):
    k = F.col("p_size") % 4
    named = t.part.select("p_partkey", F.concat("p_name", F.when(k == 0, " crème brûlée").when(k == 1, " jalapeño").when(k == 2, " Ångström").otherwise(" plain")).alias("x"))
    return named.select("p_partkey", text.accents_folded(F.col("x")).alias("name"))


RAW = "CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN '[Item #' || p_partkey || ']' WHEN 2 THEN '**** DAIRY **** ' || p_name WHEN 3 THEN 'GROUP TOTAL' WHEN 4 THEN p_size || ' / 4,5' WHEN 5 THEN p_name || ' *** SUB' WHEN 6 THEN '*** DAIRY ***' ELSE p_name END"


@query(
    "STR_23_junk_classifier",
    f"WITH a AS (SELECT p_partkey, {RAW} AS raw, CASE WHEN p_size % 2 = 0 THEN '1234567' END AS code, p_size::DOUBLE AS price, p_size * 2.0 AS ext, p_size = 7 AS made, p_size % 3 = 0 AS marks FROM part), "
    "b AS (SELECT *, len(trim(regexp_replace(raw, '\\*+|\\bDAIRY\\b', '', 'g'))) AS rest, raw = '' OR regexp_full_match(raw, '[0-9 .,/]+') OR raw LIKE '[Item #%' OR contains(raw, '***') OR raw = 'GROUP TOTAL' AS hit FROM a) "
    "SELECT p_partkey, hit AND NOT (made OR (raw LIKE '[Item #%' AND code IS NOT NULL AND price > 5) OR (contains(raw, '**') AND code IS NOT NULL AND price > 1 AND rest >= 5) OR (marks AND contains(raw, '**') AND ext > 5 AND rest >= 10)) AS junk FROM b",
)
def _(t):
    k, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    raw = F.when(k == 0, "").when(k == 1, F.concat(F.lit("[Item #"), F.col("p_partkey").cast("string"), F.lit("]"))).when(k == 2, F.concat(F.lit("**** DAIRY **** "), "p_name")).when(k == 3, "GROUP TOTAL")
    raw = raw.when(k == 4, F.concat(size, F.lit(" / 4,5"))).when(k == 5, F.concat("p_name", F.lit(" *** SUB"))).when(k == 6, "*** DAIRY ***").otherwise(F.col("p_name"))
    code = F.when(F.col("p_size") % 2 == 0, "1234567")
    return t.part.select("p_partkey", text.junk(raw, code, F.col("p_size").cast("double"), F.col("p_size") * 2.0, F.col("p_size") == 7, F.col("p_size") % 3 == 0).alias("junk"))


@query(
    "STR_24_proposed_name",
    "WITH a AS (SELECT p_partkey, p_size, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part) SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN upper(b[1]) || b[2:] || ', ' || upper(a[1]) || a[2:] ELSE upper(a[1]) || a[2:] || ' ' || upper(b[1]) || b[2:] END AS name FROM a",
)
def _(t):
    a, b, k, size = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_size") % 5, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(size, F.lit(" LB, 4 CT"))).when(k == 1, F.concat(F.upper(b), F.lit("S, "), a, F.lit(", #1, 3 LB"))).when(k == 2, F.concat(F.lit("ACMECLS "), F.upper(F.concat_ws(" ", a, b)), F.lit(" 1234567")))
    raw = raw.when(k == 3, F.concat(size, F.lit("/5 OZ "), a, F.lit(" each "), b, F.lit("s"))).otherwise(F.concat_ws(" ", a, b))
    return t.part.select("p_partkey", text.proposed_name(raw, "[A-Z]{3,8}CLS").alias("name"))


@query(
    "STR_21_invoice_number",
    "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_partkey || '77' WHEN 1 THEN p_partkey::VARCHAR WHEN 2 THEN 'A-' || p_partkey WHEN 3 THEN NULL ELSE '9' || (100000 + p_partkey) END AS number FROM part",
)
def _(t):
    k, n = F.col("p_size") % 5, F.col("p_partkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("Statement\nINVOICE NUMBER: "), n, F.lit("77\nTotal 9"))).when(k == 1, F.concat(F.lit("INV# "), n, F.lit(" p. 7"))).when(k == 2, F.concat(F.lit("Order A-"), n, F.lit(" of May")))
    raw = raw.when(k == 3, "Invoice without one").otherwise(F.concat(F.lit("INVOICE\n\nDate\n9"), (100000 + F.col("p_partkey")).cast("string"), F.lit("\n")))
    vendor = F.when(k == 2, "orders").otherwise("other")
    return t.part.select("p_partkey", text.invoice_number(raw, vendor, {"orders": [r"(?i)\border\s+([A-Z]-\d+)"]}).alias("number"))


# -- scorers ----------------------------------------------------------------------------------------------------------


def lcs(a: str, b: str) -> str:
    """SQL: the longest common subsequence of two short strings, a row of the table as the bits of one number."""
    mask = f"coalesce(list_sum(list_transform(range(1, len({a}) + 1), lambda place: CASE WHEN substring({a}, place, 1) = y THEN (1::BIGINT << (place - 1)::INT) ELSE 0 END)), 0)::BIGINT"
    full = f"((1::BIGINT << len({a})::INT) - 1)"
    row = f"list_reduce(list_transform(string_split({b}, ''), lambda y: {mask}), lambda s, m: (s + (s & m)) | (s - (s & m)), {full})"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE len({a}) - bit_count({row} & {full}) END)"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {lcs(a, b)} / (len({a}) + len({b})) END)"


def by_words(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


PAIRS = "p AS (SELECT DISTINCT a.p_name AS a, b.p_name || CASE WHEN b.p_size % 3 = 0 THEN ' ' || a.p_name WHEN b.p_size % 3 = 1 THEN ' x' ELSE '' END AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 64)"


def _pairs(t):
    b = t.part.select((F.col("p_partkey") - 64).alias("p_partkey"), F.col("p_name").alias("n"), F.col("p_size").alias("s"))
    k = F.col("s") % 3
    both = t.part.select("p_partkey", F.col("p_name").alias("a")).join(b, "p_partkey")
    return both.select("a", F.concat("n", F.when(k == 0, F.concat(F.lit(" "), "a")).when(k == 1, " x").otherwise("")).alias("b")).distinct()


def _scored(rule):
    return lambda t: _pairs(t).select("a", "b", F.round(fuzzy.scorer(rule)("a", "b"), 6).alias("score"))


query("STR_14_indel_ratio", f"WITH {PAIRS} SELECT a, b, round({ratio('a', 'b')}, 6) AS score FROM p")(_scored(fuzzy.indel))
query("STR_15_token_sort", f"WITH {PAIRS}, q AS (SELECT a, b, {by_words('a')} AS x, {by_words('b')} AS y FROM p) SELECT a, b, round({ratio('x', 'y')}, 6) AS score FROM q")(_scored(fuzzy.token_sort))
query(
    "STR_16_token_set",
    f"WITH {PAIRS}, q AS (SELECT a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM p), "
    "r AS (SELECT a, b, array_to_string(list_sort(list_intersect(x, y)), ' ') AS i, array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ') AS u, array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ') AS v FROM q), "
    "s AS (SELECT a, b, i, u, v, trim(i || ' ' || u) AS k, trim(i || ' ' || v) AS l FROM r) "
    f"SELECT a, b, round(CASE WHEN i <> '' AND (u = '' OR v = '') THEN 100.0 ELSE greatest(CASE WHEN i <> '' THEN {ratio('i', 'k')} ELSE 0 END, CASE WHEN i <> '' THEN {ratio('i', 'l')} ELSE 0 END, {ratio('k', 'l')}) END, 6) AS score FROM s",
)(_scored(fuzzy.token_set))
query("STR_17_weighted_ratio")(_scored(fuzzy.weighted))
query("STR_18_sequence")(_scored(fuzzy.sequence))


@query("STR_19_food_score")
def _(t):
    x, y = (F.transform(F.split(c, " "), text.naive_stem) for c in ("a", "b"))
    return _pairs(t).select("a", "b", F.round(similarity.food_score(F.col("a"), F.col("b"), x, y, ["ring", "widget"]), 6).alias("score"))


# -- packs and units --------------------------------------------------------------------------------------------------

_UNITS = "|".join(units.PACK_UNITS)


def pack_sql(c: str) -> tuple[str, str, str]:
    """SQL for the count, size and unit of a pack text."""
    s = f"upper(trim({c}))"
    can, many, one = f"regexp_full_match({s}, '\\d+\\s*/\\s*#?10\\s*CAN')", f"regexp_full_match({s}, '\\d+\\s*/\\s*\\d+(\\.\\d+)?\\s*({_UNITS})')", f"regexp_full_match({s}, '\\d+(\\.\\d+)?\\s*({_UNITS}|EACH|EA)')"
    unit = f"regexp_extract({s}, '([A-Z_]+)$', 1)"
    named = f"CASE {unit} WHEN 'FLOZ' THEN 'fl_oz' WHEN 'EACH' THEN 'ct' WHEN 'EA' THEN 'ct' ELSE lower({unit}) END"
    first, second = f"regexp_extract({s}, '^(\\d+)', 1)::INT", f"regexp_extract({s}, '/\\s*(\\d+(?:\\.\\d+)?)', 1)::DOUBLE"
    return (
        f"CASE WHEN {can} OR {many} THEN {first} WHEN {one} THEN 1 END",
        f"CASE WHEN {can} THEN 1.0::DOUBLE WHEN {many} THEN {second} WHEN {one} THEN regexp_extract({s}, '^(\\d+(?:\\.\\d+)?)', 1)::DOUBLE END",
        f"CASE WHEN {can} THEN 'can' WHEN {many} OR {one} THEN {named} END",
    )


def _pack_columns(c: str) -> str:
    n, size, unit = pack_sql(c)
    return f"{n} AS n, {size} AS size, {unit} AS unit"


@query("UNT_01_pack_parse", f"{WORDING} SELECT id, {_pack_columns('case_size')} FROM wording")
def _(t):
    p = t.view("wording").select("id", units.parse_pack(F.col("case_size")).alias("p"))
    return p.select("id", F.col("p.pack_count").alias("n"), F.col("p.pack_size").alias("size"), F.col("p.pack_unit").alias("unit"))


#: SQL for the weight that a description of `wording` states: its shapes are the ones of that view.
WEIGHT_SQL = "CASE id % 7 WHEN 0 THEN size || 'LB' WHEN 1 THEN '36/' || size || 'LB' WHEN 6 THEN size || 'LB' END"


@query("UNT_02_weight_from_text", f"{WORDING} SELECT id, {WEIGHT_SQL} AS pack FROM wording")
def _(t):
    return t.view("wording").select("id", units.weight_in_text(F.col("description")).alias("pack"))


POUNDS = {"ring": 48, "bolt": 25, "small_widget": 31}
BUSHEL_SQL = "round_even(CASE id % 7 WHEN 2 THEN 1 + 1 / 9.0::DOUBLE WHEN 4 THEN 1 / size::DOUBLE END * CASE WHEN name = 'small widget' THEN 31 WHEN name LIKE '% ring' THEN 48 WHEN name LIKE '% bolt' THEN 25 END, 1)"


@query("UNT_03_bushel_weight", f"{WORDING}, b AS (SELECT id, {BUSHEL_SQL} AS w FROM wording) SELECT id, CASE WHEN w IS NOT NULL THEN printf('%.1f', w) || 'LB' END AS pack FROM b")
def _(t):
    return t.view("wording").select("id", units.bushel_pack(F.col("description"), F.col("name"), POUNDS).alias("pack"))


def _parses(c: str) -> str:
    return f"({pack_sql(c)[0]}) IS NOT NULL"


BARE_SQL = "CASE WHEN regexp_full_match(trim(case_size), '\\d+/\\d+(\\.\\d+)?') AND split_part(trim(case_size), '/', 1)::DOUBLE * split_part(trim(case_size), '/', 2)::DOUBLE BETWEEN 0.5 AND 200 THEN trim(case_size) || 'LB' END"
CANDIDATES = f"{WORDING}, c AS (SELECT id, case_size, list_distinct(list_filter([trim(case_size), {WEIGHT_SQL}, trim(default_pack), {BARE_SQL}], lambda x: {_parses('x')})) AS unordered, list_filter([trim(case_size), {WEIGHT_SQL}, trim(default_pack), {BARE_SQL}], lambda x: {_parses('x')}) AS packs FROM wording)"


@query("UNT_04_effective_pack", f"{CANDIDATES} SELECT id, coalesce(packs[1], trim(coalesce(case_size, ''))) AS pack FROM c")
def _(t):
    return t.view("wording").select("id", units.effective_pack(*[F.col(c) for c in ("case_size", "description", "default_pack")]).alias("pack"))


@query("UNT_05_pack_candidates", f"{CANDIDATES} SELECT id, array_to_string(list_filter(packs, lambda x, i: list_position(packs, x) = i), ',') AS packs FROM c")
def _(t):
    return t.view("wording").select("id", F.array_join(units.pack_candidates(*[F.col(c) for c in ("case_size", "description", "default_pack")]), ",").alias("packs"))


UNIT_TABLE = _values(units.WEIGHT | units.VOLUME | units.COUNT, "u", "f")
KINDS = "CASE WHEN u IN ({}) THEN 'weight' WHEN u IN ({}) THEN 'volume' ELSE 'count' END".format(*[", ".join(f"'{x}'" for x in tab) for tab in (units.WEIGHT, units.VOLUME)])
WRITTEN = "CASE p_partkey % 4 WHEN 0 THEN upper(k) || '.' WHEN 1 THEN ' ' || k || ' ' WHEN 2 THEN replace(k, '_', ' ') ELSE k END"


@query(
    "UNT_06_base_convert",
    f"WITH k AS (SELECT u AS k, row_number() OVER (ORDER BY u) - 1 AS i FROM {UNIT_TABLE}), n AS (SELECT count(*) AS n FROM k), a AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 11 = 0 THEN 'pinch' ELSE {WRITTEN} END AS unit FROM part JOIN k ON p_partkey % (SELECT n FROM n) = i), "
    f"b AS (SELECT *, lower(replace(trim(rtrim(ltrim(trim(unit), '.'), '.')), ' ', '_')) AS x FROM a) SELECT p_partkey, unit, p_size * f AS base, coalesce(CASE WHEN u IS NOT NULL THEN {KINDS} END, 'unknown') AS kind FROM b LEFT JOIN {UNIT_TABLE} ON u = x",
)
def _(t):
    names = sorted(units.WEIGHT | units.VOLUME | units.COUNT)
    k = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    j = F.col("p_partkey") % 4
    unit = F.when(F.col("p_partkey") % 11 == 0, "pinch").when(j == 0, F.concat(F.upper(k), F.lit("."))).when(j == 1, F.concat(F.lit(" "), k, F.lit(" "))).when(j == 2, F.replace(k, F.lit("_"), F.lit(" "))).otherwise(k)
    return t.part.select("p_partkey", unit.alias("unit"), units.to_base(F.col("p_size").cast("double"), unit).alias("base"), units.unit_kind(unit).alias("kind"))


DENSITIES = {"ring": 4.5, "small_bolt": 6.0, "bolt": 5.0}
PIECES = {("small_ring", "each"): 2.5, ("red_ring", "strips"): 1.25}
DENSITY_SQL = "CASE WHEN name = 'small bolt' THEN 6.0 WHEN name LIKE '% ring' THEN 4.5 WHEN name LIKE '% bolt' THEN 5.0 END"


@query("UNT_07_density_from_right", f"{WORDING} SELECT id, {DENSITY_SQL}::DOUBLE AS density FROM wording")
def _(t):
    return t.view("wording").select("id", units.by_name(DENSITIES, F.initcap("name")).alias("density"))


@query("UNT_08_piece_weight", f"WITH {views('wording', 'asked')} SELECT recipe_id, position, product_id, CASE WHEN name = 'small ring' AND unit = 'each' THEN 2.5 WHEN name = 'red ring' AND unit = 'strips' THEN 1.25 END::DOUBLE AS ounces FROM asked JOIN wording ON id = product_id")
def _(t):
    both = t.view("asked").join(t.view("wording"), F.col("id") == F.col("product_id"))
    return both.select("recipe_id", "position", "product_id", units.piece_ounces(F.col("name"), F.col("unit"), PIECES).alias("ounces"))


_N, _S, _U = pack_sql("case_size")
COST_SQL = f"""WITH {views('wording', 'asked')}, u AS (SELECT u, f, {KINDS} AS kind FROM {UNIT_TABLE}),
a AS (SELECT q.recipe_id, q.position, q.product_id, w.name, q.case_price, q.per_pound, lower(replace(trim(q.unit, '.'), ' ', '_')) AS unit0,
  CASE WHEN q.yield_pct > 0 THEN q.quantity / (q.yield_pct / 100) ELSE q.quantity END AS bought, {_N} AS n, {_S} AS s, {_U} AS pu, {DENSITY_SQL}::DOUBLE AS density FROM asked q JOIN wording w ON w.id = q.product_id),
b AS (SELECT *, CASE WHEN name = 'small ring' AND unit0 = 'each' THEN 2.5::DOUBLE WHEN name = 'red ring' AND unit0 = 'strips' THEN 1.25::DOUBLE WHEN unit0 = 'strips' THEN 16 / 10.0::DOUBLE END AS each FROM a),
c AS (SELECT *, CASE WHEN each IS NOT NULL THEN bought * each ELSE bought END AS q, CASE WHEN each IS NOT NULL THEN 'oz' ELSE unit0 END AS unit FROM b),
d AS (SELECT c.*, coalesce(x.kind, 'unknown') AS kind, y.kind AS pk, q * x.f AS need, s * y.f * n AS whole FROM c LEFT JOIN u x ON x.u = c.unit LEFT JOIN u y ON y.u = c.pu),
e AS (SELECT recipe_id, position, product_id, CASE WHEN kind = 'weight' AND per_pound IS NOT NULL THEN 'per pound' WHEN n IS NULL THEN 'no pack' WHEN kind = 'weight' AND pk = 'weight' THEN 'weight' WHEN kind = 'volume' AND pk = 'volume' THEN 'volume'
  WHEN kind = 'volume' AND pk = 'weight' THEN CASE WHEN density IS NULL THEN 'no density' ELSE 'volume by density' END WHEN kind = 'weight' AND pk = 'volume' THEN CASE WHEN density IS NULL THEN 'no density' ELSE 'weight by density' END
  WHEN unit = 'can' AND pk IN ('weight', 'volume') THEN 'container' WHEN kind = 'count' AND pk = 'count' THEN 'count' WHEN unit = '' AND q = floor(q) AND q BETWEEN 1 AND 200 AND pk = 'count' THEN 'count without a unit' ELSE 'incompatible units' END AS note, per_pound, need, whole, density, case_price, q, n FROM d)
SELECT recipe_id, position, product_id, note, round_even(CASE note WHEN 'per pound' THEN per_pound * need / 16 WHEN 'weight' THEN case_price * (need / nullif(whole, 0)) WHEN 'volume' THEN case_price * (need / nullif(whole, 0)) WHEN 'volume by density' THEN case_price * (need / 8 * density / nullif(whole, 0))
  WHEN 'weight by density' THEN case_price * (need / density * 8 / nullif(whole, 0)) WHEN 'container' THEN case_price * (q / n) WHEN 'count' THEN case_price * (q / nullif(whole, 0)) WHEN 'count without a unit' THEN case_price * (q / nullif(whole, 0)) END, 2) AS cost FROM e"""


@query("UNT_09_ingredient_cost", COST_SQL)
def _(t):
    both = t.view("asked").join(t.view("wording"), F.col("id") == F.col("product_id"))
    cost = units.ingredient_cost(
        F.col("quantity"), F.col("unit"), F.col("name"), F.col("case_price"), F.col("case_size"), F.col("yield_pct"), None, F.col("per_pound"), F.lit(8), F.lit(12), DENSITIES, PIECES
    )
    return both.select("recipe_id", "position", "product_id", cost.alias("c")).select("recipe_id", "position", "product_id", "c.note", "c.cost")


@query(
    "UNT_13_unit_price",
    f"{WORDING}, a AS (SELECT id, size, {_N} AS n, {_S} AS s, {_U} AS u FROM wording) SELECT id, round(CASE WHEN id % 4 = 0 THEN size + 0.5 WHEN u IN ('doz') THEN (size + 0.5) / (s * 12 * n) WHEN u IN ('ct', 'can') THEN (size + 0.5) / nullif(s * n, 0) ELSE (size + 0.5) / nullif(n, 0) END, 4) AS each FROM a",
)
def _(t):
    price, by = F.col("size") + 0.5, F.when(F.col("id") % 4 == 0, " each").otherwise("case")
    return t.view("wording").select("id", units.unit_price(price, by, units.parse_pack(F.col("case_size"))).alias("each"))


@query(
    "UNT_14_price_per_pound",
    f"{WORDING}, a AS (SELECT *, {_N} AS n, {_S} AS s, {_U} AS u FROM wording) SELECT id, round(CASE WHEN id % 9 = 0 THEN 1.25 WHEN id % 5 = 0 THEN size * 3.0 / (id % 25 + 1) WHEN u = 'lb' THEN size * 3.0 / nullif(n * s, 0) "
    "WHEN try_cast(trim(case_size) AS DOUBLE) >= 2 THEN size * 3.0 / trim(case_size)::DOUBLE END, 4)::DOUBLE AS per_pound FROM a",
)
def _(t):
    stored, pounds = F.when(F.col("id") % 9 == 0, 1.25), F.when(F.col("id") % 5 == 0, (F.col("id") % 25 + 1).cast("double"))
    return t.view("wording").select("id", units.price_per_pound(stored, F.col("size") * 3.0, pounds, F.col("case_size")).alias("per_pound"))


@query("UNT_16_pack_decomposition", f"{WORDING}, a AS (SELECT id, {_pack_columns('case_size')} FROM wording) SELECT id, n, size, unit, CASE unit WHEN 'lb' THEN n * size WHEN 'oz' THEN n * size / 16 END AS pounds FROM a")
def _(t):
    p = t.view("wording").select("id", units.parse_pack(F.col("case_size")).alias("p"))
    return p.select("id", F.col("p.pack_count").alias("n"), F.col("p.pack_size").alias("size"), F.col("p.pack_unit").alias("unit"), units.pack_pounds(F.col("p")).alias("pounds"))


@query(
    "UNT_17_fused_pack",
    "WITH p(n, s) AS (VALUES (6, '5'), (12, '32'), (1, '50'), (4, '1')), c AS (SELECT DISTINCT n || s || 'OZ' AS fused, n, s FROM p), d AS (SELECT DISTINCT p_size || 'OZ' AS fused FROM part UNION SELECT fused FROM c UNION SELECT '99999OZ') "
    "SELECT d.fused, CASE WHEN count(c.n) = 1 THEN min(c.n || '/' || c.s || 'OZ') END AS pack FROM d LEFT JOIN c USING (fused) GROUP BY 1",
)
def _(t):
    known = {"OZ": [(6, "5"), (12, "32"), (1, "50"), (4, "1")]}
    fused = t.part.select(F.concat(F.col("p_size").cast("string"), F.lit("OZ")).alias("fused"))
    more = t.spark.range(1).select(F.explode(F.array(*[F.lit(f"{n}{s}OZ") for n, s in known["OZ"]], F.lit("99999OZ"))).alias("fused"))
    return fused.unionByName(more).distinct().select("fused", units.fused_pack(F.col("fused"), known).alias("pack"))


@query(
    "UNT_18_pack_column",
    f"{WORDING} SELECT id, CASE id % 4 WHEN 0 THEN size || '/5LB' WHEN 1 THEN size || 'CT' WHEN 2 THEN NULL ELSE '1/' || size || 'LB' END AS pack, CASE id % 4 WHEN 2 THEN size + 0.25 END::DOUBLE AS catch_pounds, CASE WHEN id % 4 = 1 THEN size END AS count_low, CASE WHEN id % 4 = 1 THEN size + 4 END AS count_high FROM wording",
)
def _(t):
    k, size = F.col("id") % 4, F.col("size").cast("string")
    raw = F.when(k == 0, F.concat(size, F.lit(" / 5 LB"))).when(k == 1, F.concat(size, F.lit(" CT."))).when(k == 2, "CATCH WT").otherwise(F.concat(F.lit("1 X "), size, F.lit("#")))
    said = F.when(k == 1, F.concat(F.lit("SHRIMP "), size, F.lit("/"), (F.col("size") + 4).cast("string"), F.lit(" CT"))).when(k == 2, F.concat(F.lit("T/WT= "), size, F.lit(".25"))).otherwise("plain")
    w = t.view("wording").select("id", units.pack_column(raw).alias("pack"), units.catch_weight(said).alias("catch_pounds"), units.count_per_pound(said).alias("c"))
    return w.select("id", "pack", "catch_pounds", F.col("c.low").alias("count_low"), F.col("c.high").alias("count_high"))


@query("UNT_20_headcount_scaling", "SELECT recipe_id, position, product_id, quantity * (30 + recipe_id % 50) / CASE WHEN position % 3 = 0 THEN 40 ELSE position * 10 END AS needed FROM asked".join([f"WITH {views('asked')} ", ""]))
def _(t):
    serves = F.when(F.col("position") % 3 == 0, F.when(F.col("position") == 3, F.lit(0))).otherwise(F.col("position") * 10)
    return t.view("asked").select("recipe_id", "position", "product_id", units.scaled_to(F.col("quantity"), 30 + F.col("recipe_id") % 50, serves).alias("needed"))


GOODS = "CASE id % 6 WHEN 0 THEN ' salmon stock' WHEN 1 THEN ' SHRIMP raw' WHEN 2 THEN ' anchovies' WHEN 3 THEN ' bacon, ' || size || 'LB' WHEN 4 THEN ' pork  loin' ELSE ' chopsticks' END"
PACKED = "CASE size % 5 WHEN 0 THEN '4/1GAL' WHEN 1 THEN size || ' LB' WHEN 2 THEN '28 OZ' WHEN 3 THEN '6/32 fl oz' ELSE NULL END"


@query(
    "UNT_21_inventory_class",
    f"{WORDING}, a AS (SELECT id, name || {GOODS} AS said, {PACKED} AS pack, size FROM wording), b AS (SELECT id, CASE WHEN size % 5 IN (0, 3) THEN 'counted_with_volume' WHEN id % 6 IN (0, 1, 4) AND size % 5 = 1 OR id % 6 = 3 THEN 'weighed' END AS class FROM a) SELECT id, class, coalesce(class <> 'weighed', FALSE) AS mismatch FROM b",
)
def _(t):
    k, j, size = F.col("id") % 6, F.col("size") % 5, F.col("size").cast("string")
    said = F.concat("name", F.when(k == 0, " salmon stock").when(k == 1, " SHRIMP raw").when(k == 2, " anchovies").when(k == 3, F.concat(F.lit(" bacon, "), size, F.lit("LB"))).when(k == 4, " pork  loin").otherwise(" chopsticks"))
    pack = F.when(j == 0, "4/1GAL").when(j == 1, F.concat(size, F.lit(" LB"))).when(j == 2, "28 OZ").when(j == 3, "6/32 fl oz")
    return t.view("wording").select("id", units.inventory_class(said, pack).alias("class"), units.class_mismatch(F.lit("weighed"), said, pack).alias("mismatch"))


@query(
    "UNT_23_math_classes",
    "WITH {LINES}, r AS (SELECT l_quantity * CASE l_linenumber % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.99 WHEN 2 THEN 2 WHEN 3 THEN 1.3 ELSE 0 END AS m, l_quantity AS q, l_linenumber % 5 AS k FROM lines) "
    "SELECT CASE k WHEN 0 THEN 'holds' WHEN 1 THEN 'discount holds' WHEN 2 THEN CASE WHEN 2 * q <= 50 THEN 'quantity anomaly' ELSE 'suspect' END WHEN 3 THEN CASE WHEN 1.3 * q <= 50 AND abs(round(1.3 * q) - 1.3 * q) * 8 <= 0.1 THEN 'quantity anomaly' ELSE 'suspect' END ELSE 'unknown' END AS class, count(*) AS n FROM r GROUP BY 1",
)
def _(t):
    k = F.col("l_linenumber") % 5
    times = F.when(k == 0, 1.0).when(k == 1, 0.99).when(k == 2, 2.0).when(k == 3, 1.3).otherwise(0.0)
    kind = units.math_class(F.col("l_quantity"), F.lit(8.0), F.col("l_quantity") * times * 8)
    return t.lines.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query(
    "UNT_24_price_alert",
    "WITH {LINES}, m AS (SELECT l_partkey, avg(price) AS mean, count(DISTINCT l_quantity > 10) AS sizes FROM lines GROUP BY 1), r AS (SELECT price / mean AS ratio, price, mean, sizes, l_partkey FROM lines JOIN m USING (l_partkey)) "
    "SELECT CASE WHEN l_partkey % 10 = 0 THEN 'mapping_error' WHEN ratio > 5 AND price > 50 THEN 'extended_leak' WHEN (ratio > 2 OR ratio < 0.5) AND (sizes > 1 OR price < 5 OR mean < 5) THEN 'unit_drift' ELSE 'real_change' END AS class, count(*) AS n FROM r GROUP BY 1",
)
def _(t):
    mean = t.lines.groupBy("l_partkey").agg(F.avg("price").alias("mean"), F.countDistinct(F.col("l_quantity") > 10).alias("sizes"))
    named, said = F.array(F.lit("apple"), F.lit("red")), F.when(F.col("l_partkey") % 10 == 0, F.array(F.lit("pear"), F.lit("green"))).otherwise(F.array(F.lit("apple"), F.lit("green")))
    return t.lines.join(mean, "l_partkey").groupBy(units.price_alert(F.col("price"), F.col("mean"), named, said, F.col("sizes")).alias("class")).agg(F.count("*").alias("n"))


STATUS_SQL = "CASE WHEN total IS NULL THEN 'partial' WHEN abs(total - items) <= 0.5 OR abs(total - items - credits) <= 0.5 OR abs(total - items) <= abs(total) * 1.0 / 100 THEN 'pass' WHEN n_items > 0 AND abs(total - items - fees) <= 0.5 THEN 'pass' WHEN abs(total - items) <= abs(total) * 5 / 100 THEN 'review' ELSE 'fail' END"


@query(
    "UNT_25_invoice_status",
    "WITH {LINES}, s AS (SELECT l_orderkey, count(*) AS n_items, sum(ext)::DOUBLE AS items, coalesce(sum(ext) FILTER (l_returnflag = 'R'), 0)::DOUBLE AS credits, 12.5::DOUBLE AS fees FROM lines GROUP BY 1), "
    "x AS (SELECT s.*, CASE l_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN items + credits WHEN 2 THEN items + 12.5 WHEN 3 THEN items * 1.03 WHEN 4 THEN items * 1.005 ELSE o_totalprice END AS total FROM s JOIN orders ON o_orderkey = l_orderkey) "
    f"SELECT {STATUS_SQL} AS status, count(*) AS n FROM x GROUP BY 1",
)
def _(t):
    credit = F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("ext"))).cast("double"), F.lit(0.0))
    s = t.lines.groupBy("l_orderkey").agg(F.count("*").alias("n_items"), money("ext").alias("items"), credit.alias("credits"))
    k = F.col("l_orderkey") % 6
    total = F.when(k == 1, F.col("items") + F.col("credits")).when(k == 2, F.col("items") + 12.5).when(k == 3, F.col("items") * 1.03).when(k == 4, F.col("items") * 1.005).when(k == 5, F.col("o_totalprice"))
    x = s.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return x.groupBy(stats.invoice_status(F.col("items"), total, F.col("credits"), fees=F.lit(12.5), n_items=F.col("n_items")).alias("status")).agg(F.count("*").alias("n"))


MAPPED_DATES = ["yyyy-MM-dd", "MM/dd/yyyy", "MM/dd/yy", "MMM d, yyyy", "d-MMM-yyyy"]
