"""Operators on small tables made by hand."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pantrylake.operators import quality, recursive, relational, similarity
from pantrylake.sources import readers
from pantrylake.streaming import ingest


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_cadence(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-11"), (1, "2024-01-21"), (2, "2024-01-01")], "k int, d string").withColumn("d", F.to_date("d"))
    got = quality.cadence(df, "k", "d", "2024-01-30").first()
    assert (got["k"], got["mean_gap"], got["days_since"], round(got["urgency"], 2)) == (1, 10.0, 9, 0.9)


def test_upsert_keeps_edited_rows_and_fills(spark):
    old = spark.createDataFrame([(1, "a", 5, True), (2, "b", 6, False), (3, "c", 7, False)], "k int, v string, n int, edited boolean")
    new = spark.createDataFrame([(1, "x", 1, False), (2, "y", None, False), (4, "z", 9, False)], "k int, v string, n int, edited boolean")
    got = quality.merge_upsert(old, new, ["k"], keep_old=F.col("o.edited"), fill=("n",))
    assert rows(got, "k", "v", "n") == [(1, "a", 5), (2, "y", 6), (3, "c", 7), (4, "z", 9)]


def test_expand_multiplies_and_stops(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 3.0), ("c", "a", 1.0)], "parent string, child string, factor double")
    roots = spark.createDataFrame([("r", "a", 1.0)], "root string, node string, quantity double")
    got = recursive.expand(roots, edges, depth=4)
    assert rows(got, "level", "node", "quantity") == [(0, "a", 1.0), (1, "b", 2.0), (2, "c", 6.0), (3, "a", 6.0), (4, "b", 12.0)]


def test_subset_match_needs_a_single_most_specific_name(spark):
    raw = spark.createDataFrame([(1, ["red", "apple", "box"]), (2, ["pear"])], "id int, rt array<string>")
    names = spark.createDataFrame([("red apple", ["red", "apple"]), ("apple", ["apple"]), ("pear", ["pear"]), ("pear2", ["pear"])], "name string, nt array<string>")
    assert rows(similarity.subset_match(raw, names, "id", "name", "rt", "nt"), "id", "name") == [(1, "red apple")]


def test_as_of_takes_the_newest_row_not_after(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 1, 2), ("z", 9, 3)], "k string, at int, id int")
    right = spark.createDataFrame([("k", 2, 10), ("k", 5, None), ("k", 7, 30)], "k string, at int, v int")
    got = relational.as_of_join(left, right, ["k"], "at", ["v"])
    assert {(r["id"], r["v"]) for r in got.collect()} == {(1, None), (2, None), (3, None)}


def test_negation_keeps_nulls(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "x string")
    assert df.where(relational.not_true(F.col("x") == "a")).count() == 2


def test_bad_json_is_kept_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"vendor": "v", "n": 1}))
    (tmp_path / "b.json").write_text("{broken")
    good, bad = readers.json_documents(spark, str(tmp_path), StructType.fromDDL("vendor string, n int"))
    assert rows(good, "vendor", "n") == [("v", 1)]
    assert bad.count() == 1


def test_headcount_events(spark):
    df = spark.createDataFrame([("2024-01-01", "10"), ("2024-01-02", "(3)")], "day string, delta string")
    assert [r["delta"] for r in readers.headcount_events(df).orderBy("day").collect()] == [10, -3]


def test_month_overwrite_leaves_other_months(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-02-05")], "id int, d string").withColumn("d", F.to_date("d"))
    readers.write_month(df, path, "d")
    readers.write_month(df.where("id = 2").withColumn("id", F.lit(3)), path, "d")
    assert rows(spark.read.parquet(path), "id") == [(1,), (3,)]


def test_stream_runs_once(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    for _ in range(2):
        ingest.ingest_available(ingest.file_stream(spark, sf_dir, "events*.parquet", schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


@pytest.mark.parametrize("low", [50.0])
def test_typo_pairs_share_a_word(spark, low):
    from pantrylake.functions import fuzzy

    df = spark.createDataFrame([("green pepper",), ("green peppers",), ("yellow squash",)], "n string")
    assert rows(similarity.typo_pairs(df, "n", fuzzy.scorer(fuzzy.indel), low), "a", "b") == [("green pepper", "green peppers")]


def test_typo_pairs_skip_only_names_whose_long_words_differ(spark):
    import re

    from pantrylake.functions import fuzzy

    names = ["cold rod", "old rod", "red ox", "red fox", "bed fox", "warm rod", "warn rod", "ox", "green pepper", "green peppers", "grean peper"]
    long = lambda n: {w for w in re.findall("[a-z]+", n) if len(w) >= 4}
    pairs = [(a, b) for a in names for b in names if a < b and abs(len(a) - len(b)) <= 3 and not (long(a) and long(b) and not long(a) & long(b))]
    want = sorted((a, b) for a, b in pairs if 80 <= fuzzy.indel(a, b) < 100)
    assert ("cold rod", "old rod") in want
    assert rows(similarity.typo_pairs(spark.createDataFrame([(n,) for n in names], "n string"), "n", fuzzy.scorer(fuzzy.indel), 80.0), "a", "b") == want


def test_fuzzy_join_scores_names_that_share_no_word(spark):
    from pantrylake.functions import fuzzy

    names = ["green pepper", "gren peper", "peppers  greens", "red ox", "yellow squash", "x"]
    want = []
    for a in names:
        found = sorted((-fuzzy.token_sort(a, b), b) for b in names if a != b and fuzzy.token_sort(a, b) >= 60)
        want += [(a, found[0][1])] if found else []
    assert ("gren peper", "green pepper") in want
    assert rows(similarity.best_of_all(spark.createDataFrame([(n,) for n in names], "n string"), "n", 60.0), "n", "other") == sorted(want)


def test_peer_count_against_all_pairs(spark):
    rows_in = [(1, p) for p in (1.0, 0.7, 1.5, 1.5, 1.0, 2.1, 0.69, 0.0, 0.0, -1.0)] * 2 + [(2, 1.0), (2, None), (None, 1.0)]
    got = rows(relational.peer_count(spark.createDataFrame(rows_in, "k int, p double"), "k", "p", 0.7, 1.5).na.fill({"k": -9, "p": -9.0}), "k", "p", "peers")
    near = lambda k, p: sum(k == j and None not in (k, p, q) and q != p and 0.7 * p <= q <= 1.5 * p for j, q in rows_in)
    assert got == sorted((-9 if k is None else k, -9.0 if p is None else p, near(k, p)) for k, p in rows_in)
