"""Hand-checked values of the scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from pantrylake.functions import dates, fuzzy, stats, text, units


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("12/32OZ", (12, 32.0, "oz")), ("24CT", (1, 24.0, "ct")), ("6/10CAN", (6, 1.0, "can")), ("4", None), ("24EA", (1, 24.0, "ct"))])
def test_pack(spark, raw, want):
    got = one(spark, units.parse_pack(F.lit(raw)))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("raw", "want"), [("1-1/9 BUSHEL", 10 / 9), ("1/2 BUSHEL", 0.5), ("BUSHEL", 1.0), ("60 BU", None)])
def test_bushel(spark, raw, want):
    got = one(spark, units.bushels(F.lit(raw)))
    assert got == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize(
    ("quantity", "unit", "pack", "price", "density", "want"),
    [(8, "oz", "1/50LB", 20.0, None, 0.20), (1, "cup", "1/50LB", 20.0, 4.25, 0.11), (6, "", "15DOZ", 45.0, None, 1.50), (1, "cup", "1/50LB", 20.0, None, None)],
)
def test_cost(spark, quantity, unit, pack, price, density, want):
    cost = units.ingredient_cost(F.lit(float(quantity)), F.lit(unit), F.lit("good"), F.lit(price), F.lit(pack), oz_per_cup=F.lit(density).cast("double"))
    assert one(spark, cost)["cost"] == want


@pytest.mark.parametrize(
    ("text_", "want"),
    [("CS Prints 36/1# Unsalted", "36/1LB"), ("YAMS, #1, 40 LB", "40LB"), ("CROWNS, 20 LB", "20LB"), ("RICOTTA, 6/3 LB", "6/3LB"), ("code 1#234", None), ("plain", None)],
)
def test_weight_in_text(spark, text_, want):
    assert one(spark, units.weight_in_text(F.lit(text_))) == want


@pytest.mark.parametrize(
    ("quantity", "unit", "name", "pack", "kwargs", "want"),
    [
        (4, "cloves", "Garlic", "1/10LB", {}, (0.09, "weight")),  # 4 x 0.18 oz of 160 oz at 20.00
        (2, "strips", "Bacon", "1/15LB", {"count_low": 10, "count_high": 14}, (0.22, "weight")),  # 16 / 12 oz each
        (0.5, "bag", "Mozzarella", "12/4OZ", {}, (0.83, "container")),
        (1, "cup", "White Sugar", "1/50LB", {}, (0.18, "volume by density")),  # 7 oz by the last word
        (10, "oz", "Carrot", "1/50LB", {"yield_pct": 80.0}, (0.31, "weight")),
        (1, "#10 Can", "Tomato", "6/10CAN", {}, (None, "incompatible units")),
        (1, "pinch", "Salt", "1/50LB", {}, (None, "incompatible units")),
        (6.5, "", "Eggs", "15DOZ", {}, (None, "incompatible units")),
        (1, "oz", "Salt", "soon", {}, (None, "no pack")),
    ],
)
def test_cost_paths(spark, quantity, unit, name, pack, kwargs, want):
    from pantrylake.functions import tables

    more = {k: F.lit(v) for k, v in kwargs.items()}
    cost = units.ingredient_cost(F.lit(float(quantity)), F.lit(unit), F.lit(name), F.lit(20.0), F.lit(pack), densities=tables.OUNCES_PER_CUP, pieces=tables.PIECE_OUNCES, **more)
    assert tuple(one(spark, cost)) == want


def test_class_of_wording(spark):
    kinds = [("MAYO 1 GAL", "", "counted_with_volume"), ("SHRIMP 16/20", "10LB", "weighed"), ("ANCHOVIES", "28 OZ", None), ("PORK  LOIN bnls", "2 LBS", "weighed"), ("CHOPSTICKS", "10 LB", None), ("SALMON stock", "4/1GAL", "counted_with_volume")]
    for said, pack, want in kinds:
        assert one(spark, units.inventory_class(F.lit(said), F.lit(pack))) == want, said


def test_direct_price_rounds_half_even(spark):
    cost = units.ingredient_cost(F.lit(0.5), F.lit("lb"), F.lit("good"), F.lit(20.0), F.lit("1/50LB"), per_pound=F.lit(1.25))
    assert one(spark, cost)["cost"] == 0.62


@pytest.mark.parametrize(("word", "want"), [("tomatoes", "tomato"), ("berries", "berry"), ("anchovies", "anchovy"), ("peaches", "peach"), ("boxes", "box"), ("glass", "glass"), ("cookies", "cookie"), ("movies", "movie"), ("brownies", "brownie"), ("shoes", "shoe"), ("mangoes", "mango"), ("bus", "bus")])
def test_stem(spark, word, want):
    assert one(spark, text.stem(F.lit(word))) == want


def test_jaccard(spark):
    three = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, text.jaccard(three("A", "B", "C"), three("B", "C", "D"))) == 0.5
    assert one(spark, text.jaccard(F.array().cast("array<string>"), three("A"))) == 0.0


def test_line_math(spark):
    fixed = one(spark, units.line_math(F.lit(2.0), F.lit(10.0), F.lit(30.0)))
    assert (fixed["flagged"], fixed["quantity"]) == (False, 3.0)
    near = one(spark, units.line_math(F.lit(1.0), F.lit(100.0), F.lit(104.0)))
    assert near["flagged"] is False


def test_wilson(spark):
    low, high = stats.wilson(F.lit(5), F.lit(100))
    assert one(spark, low) == pytest.approx(0.02154, abs=1e-5)
    assert one(spark, high) == pytest.approx(0.11175, abs=1e-5)
    assert one(spark, stats.wilson(F.lit(0), F.lit(0))[0]) is None


@pytest.mark.parametrize(("items", "total", "credits", "want"), [(76.46, 106.30, 29.84, "pass"), (76.46, 106.30, 0.0, "fail")])
def test_status(spark, items, total, credits, want):
    assert one(spark, stats.invoice_status(F.lit(items), F.lit(total), F.lit(credits))) == want


def test_dates(spark):
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, dates.biweekly_bucket(day("2026-01-04"))) == datetime.date(2025, 12, 22)
    assert one(spark, dates.prep_date(day("2026-01-05"))) == datetime.date(2026, 1, 2)
    assert one(spark, dates.parse_date(F.lit("13/40/2020"))) is None


def test_scorers():
    assert fuzzy.indel("abcd", "abcd") == 100.0
    assert fuzzy.indel("abcd", "abxd") == 75.0
    assert fuzzy.token_sort("b a", "a b") == 100.0
    assert fuzzy.token_set("red apple", "apple") == 100.0
    assert fuzzy.indel("", "") == 100.0
    assert fuzzy.token_set("", "a") == 0.0
    assert fuzzy.partial("apple", "red apples") == 100.0
    assert fuzzy.weighted("apple", "apple") == 100.0 and fuzzy.weighted("apple", "red apples and pears") == 90.0
    import random

    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert fuzzy.common(a, b) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out
