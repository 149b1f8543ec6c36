"""Cases of review findings: repeated names, hot keys, guards and rounding at ties."""

from pyspark.sql import functions as F

from pantrylake.functions import stats, text
from pantrylake.operators import recipes, relational, resolution


def _counting(monkeypatch):
    """How many pairs word_pairs made in each call."""
    made, plain = [], resolution.word_pairs

    def counted(*args):
        pairs = plain(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(resolution, "word_pairs", counted)
    return made


def _named(spark, n, names):
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int"))
    return spark.range(n).select((F.col("id") + 5).alias("id"), name.alias("name"))


def test_ingredients_meet_each_name_once(spark, monkeypatch):
    made = _counting(monkeypatch)
    ingredients = spark.createDataFrame([("red bolts",), ("hot gear",), ("smal ring",)], "ingredient string")
    products = _named(spark, 4000, ("Hot-Gear", "small ring", "big red bolt", "hot gear")).unionByName(spark.createDataFrame([(1, None), (2, "")], "id long, name string")).withColumnRenamed("id", "product_id")
    met = resolution.match_ingredients(ingredients, products)
    assert sorted(map(tuple, met.collect())) == [("hot gear", 5, "exact"), ("red bolts", 7, "subset"), ("smal ring", 6, "weighted")]
    assert max(made) <= 9


def test_dishes_and_recipes_meet_each_name_once(spark, monkeypatch):
    made = _counting(monkeypatch)
    dishes = ("Hot-Gear", "grilled red bolt plate", "soup with red bolt", "a-with bolts", "a with bolts")
    menus = _named(spark, 2000, dishes).withColumnsRenamed({"id": "menu_id", "name": "dish"})
    recipes = _named(spark, 2000, ("hot gear", "red bolt", "BOLTS")).withColumnsRenamed({"id": "recipe_id"})
    met = resolution.link_menus(menus, recipes, 0.7).groupBy((F.col("menu_id") % 5).alias("dish"), "recipe_id", "how").count()
    # "a with bolts" is named "a" and "a-with bolts" is not, though their letters are equal
    assert sorted(map(tuple, met.collect())) == [(0, 5, "exact", 400), (1, 6, "contained", 400), (3, 7, "contained", 400)]
    assert max(made) <= 15


def test_nearest_of_a_hot_key_in_sorted_passes(spark):
    """A frame that reaches to the end of its key would read the rest of the key for every row."""
    left = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.5), ("a", 3, 9.0), ("a", 4, None), ("b", 5, 1.0), ("c", 6, 1.0), ("a", 7, 2.5), ("d", 8, -1.0)], "k string, id int, at double")
    right = spark.createDataFrame([("a", 2.0), ("a", 3.0), ("a", None), ("b", None), ("d", 0.0)], "k string, v double").withColumn("place", F.col("v"))
    near = relational.nearest_list(left, right, ["k"], "at", "place", "v")
    got = {r["id"]: r["v"] for r in near.collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 3.0, 4: 2.0, 5: None, 7: 2.0, 8: 0.0}
    frames = near._jdf.queryExecution().analyzed().toString()
    assert "unboundedfollowing" not in frames.lower()


def test_two_letters_and_five_digits_are_a_state_only_if_the_post_says_so(spark):
    said = ["PA 19382", "ny  10001-1234", "xx 12345", "QZ 19382", "PA 1938", "bolt"]
    rows = spark.createDataFrame([(x,) for x in said], "t string").select("t", text.boilerplate(F.col("t")).alias("b")).collect()
    assert [r["t"] for r in rows if r["b"]] == said[:2]


def test_menu_costs_go_to_cents_by_scaling(spark):
    """Half to even after scaling, as round_even has it; by the shortest decimal form 1.015 would be a tie."""
    x = spark.createDataFrame([(1.005,), (1.015,), (2.675,), (0.125,), (-0.135,)], "x double").select(stats.cents_even(F.col("x"))).collect()
    assert [r[0] for r in x] == [1.0, 1.01, 2.68, 0.12, -0.14]
    menus = spark.createDataFrame([(1, None, "lunch", 7)], "menu_id int, day date, slot string, recipe_id int")
    costs = spark.createDataFrame([(7, 1.015)], "recipe_id int, per_serving double")
    sides = spark.createDataFrame([], "menu_id int, recipe_id int")
    census = spark.createDataFrame([], "day date, headcount int")
    assert recipes.menu_costs(menus, sides, costs, census).first()["cost"] == 30.45
