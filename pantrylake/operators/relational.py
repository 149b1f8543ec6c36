"""Relational operators: latest rows, as-of and nearest joins, spines, modes, shares, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. The rank limit runs before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def latest_qualifying(df: DataFrame, keys: list[str], order: list[Column], k: int, qualifies: Column) -> DataFrame:
    """Of the first k rows of each key: the first one that qualifies, else the first one."""
    near = top_k(df, keys, order, k)
    w = Window.partitionBy(*keys).orderBy(qualifies.desc(), "rank")
    return near.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "rank")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Each left row with the newest right row of its key at or before it: one sorted pass over both, no range join."""
    empty = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
    extra = [c for c in left.columns if c not in keys + [at]]
    a = left.select(*keys, at, F.struct(*[F.col(c) for c in extra]).alias("_row"), *empty, F.lit(1).alias("_side"), F.lit(None).cast("boolean").alias("_has"))
    b = right.select(*keys, at, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *values, F.lit(0).alias("_side"), F.lit(True).alias("_has"))
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    packed = F.last(F.when(F.col("_has"), F.struct(*values)), ignorenulls=True).over(w)
    both = a.unionByName(b).withColumn("_last", packed).where("_side = 1")
    return both.select(*keys, at, "_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def last_known(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def nearest_match(left: DataFrame, right: DataFrame, keys: list[str], distance: Column, row: list[str], ties: list[Column]) -> DataFrame:
    """Of the right rows with a left row's keys, the one at the least distance."""
    w = Window.partitionBy(*row).orderBy("distance", *ties)
    return left.join(right, keys).withColumn("distance", distance).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def band_join(points: DataFrame, headers: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """Points with the header whose band (from its place to the next one's) holds them."""
    return last_known(
        headers.select(*keys, at, F.col(name), F.lit(0).alias("_side")).unionByName(points.withColumn("_side", F.lit(1)), allowMissingColumns=True),
        keys, [F.col(at), F.col("_side")], F.when(F.col("_side") == 0, F.col(name)), "_band",
    ).where("_side = 1").drop("_side", name).withColumnRenamed("_band", name)


def zip_join(a: DataFrame, b: DataFrame, keys: list[str], order_a: list[Column], order_b: list[Column]) -> DataFrame:
    """The k-th row of a key on one side with the k-th on the other; the longer side's rest falls away."""
    number = lambda df, order: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return number(a, order_a).join(number(b, order_b), [*keys, "k"])


def mode_with_support(df: DataFrame, keys: list[str], value: str, least: int, share: float) -> DataFrame:
    """Each key's most frequent value (the smallest of equals), where its count and its share suffice."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("total", F.sum("n").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.col("n").desc(), value)))
    return ranked.where((F.col("_rn") == 1) & (F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).drop("_rn")


def share_of_total(df: DataFrame, column: str, name: str, digits: int = 2) -> DataFrame:
    """Percentage of the sum over all rows of an already aggregated table (two passes, no window over all rows)."""
    total = df.agg(F.sum(column).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.round(F.coalesce(F.try_divide(100 * F.col(column), F.col("_total")), F.lit(0.0)), digits)).drop("_total")


def month_spine(df: DataFrame, day: str) -> DataFrame:
    """(month): every first of month from the first to the last, gaps included."""
    span = df.agg(F.trunc(F.min(day), "month").alias("a"), F.trunc(F.max(day), "month").alias("b"))
    return span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))


def day_spine(df: DataFrame, day: str) -> DataFrame:
    span = df.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias(day))


def not_true(condition: Column) -> Column:
    """Negation that keeps rows whose condition is null."""
    return ~F.coalesce(condition, F.lit(False))


def peer_count(rows: DataFrame, key: str, value: str, low: float, high: float) -> DataFrame:
    """(key, value, peers) for each row: other rows of its key from low to high times its value and not equal to it.

    Equal values are counted first; then one sorted pass over values and bounds, so that no row holds a whole key.
    """
    keyed = rows.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_own"))
    n = keyed.groupBy("_key", "_own").agg(F.count("*").alias("_n")).where("_key IS NOT NULL AND _own IS NOT NULL")
    # of equal places the lower bound comes first and the upper bound last
    point = lambda at, kind, count: F.struct(at.alias("at"), F.lit(kind).alias("kind"), count.alias("count"))
    own, none = F.col("_own"), F.lit(0).cast("long")
    marks = n.select("_key", "_own", F.explode(F.array(point(low * own, 0, none), point(own, 1, F.col("_n")), point(high * own, 2, none))).alias("_p"))
    w = Window.partitionBy("_key").orderBy("_p.at", "_p.kind").rowsBetween(Window.unboundedPreceding, 0)
    run = marks.withColumn("_run", F.sum("_p.count").over(w))
    at = lambda kind: F.max(F.when(F.col("_p.kind") == kind, F.col("_run")))
    inside = at(2) - at(0) - F.max("_p.count")
    near = run.groupBy("_key", "_own").agg(F.when(F.col("_own") >= 0, inside).otherwise(0).alias("_peers"))
    return keyed.join(near, ["_key", "_own"], "left").select(F.col("_key").alias(key), F.col("_own").alias(value), F.coalesce("_peers", F.lit(0)).cast("long").alias("peers"))


def neighbour_rule(rows: DataFrame, day: str, slot: str, value: str) -> DataFrame:
    """rows with as_yesterday (the value of the dinner before) and as_lunch (a dinner with the value of that day's lunch)."""
    before = rows.where(F.col(slot) == "dinner").select(F.date_add(day, 1).alias("_day"), F.col(value).alias("_before"))
    lunch = rows.where(F.col(slot) == "lunch").select(F.col(day).alias("_on"), F.col(value).alias("_lunch"))
    both = rows.join(before, F.col(day) == F.col("_day"), "left").join(lunch, F.col(day) == F.col("_on"), "left")
    same = lambda c: F.coalesce(F.col(value) == F.col(c), F.lit(False))
    return both.withColumn("as_yesterday", same("_before")).withColumn("as_lunch", same("_lunch") & (F.col(slot) == "dinner")).drop("_day", "_before", "_on", "_lunch")


def best_version(df: DataFrame, keys: list[str], code: str, order: list[Column]) -> DataFrame:
    """One row of each code, the first in order; rows without a code all stay."""
    coded = F.coalesce(F.col(code).cast("string"), F.lit("")) != ""
    return latest_per_key(df.where(coded), [*keys, code], order).unionByName(df.where(~coded))


def nearest_list(left: DataFrame, right: DataFrame, keys: list[str], at: str, place: str, value: str) -> DataFrame:
    """left with the right value of its key whose place is nearest (the lower of two equally near).

    Each distinct (key, at) is placed once, by two sorted passes over these and the right places: one up, for the last
    place at or below, and one down, for the first above; each keeps one value as it goes. So hot keys make no pairs,
    and left rows only meet what was found. A null `at` gets the lowest place, and null places count only alone.
    """
    kind = left.schema[at].dataType
    marks = right.groupBy(*keys, F.col(place).cast(kind).alias("_at")).agg(F.min(value).alias("_v")).withColumn("_side", F.lit(0))
    points = left.select(*keys, F.col(at).alias("_at")).distinct().withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    both = points.unionByName(marks)
    mark = F.when(F.col("_side") == 0, F.struct("_at", "_v"))
    placed = F.when(F.col("_at").isNotNull(), mark)
    w = Window.partitionBy(*keys)
    up, down = w.orderBy(F.asc_nulls_first("_at"), "_side"), w.orderBy(F.desc_nulls_last("_at"), F.desc("_side"))
    so_far = lambda c, order: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_b", so_far(placed, up)).withColumn("_none", so_far(F.when(F.col("_at").isNull(), mark), up)).withColumn("_a", so_far(placed, down)).where("_side = 1")
    near = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(F.col("_a._at") - F.col("_at") < F.col("_at") - F.col("_b._at"), F.col("_a")).otherwise(F.col("_b"))
    found = both.withColumn("_n", F.coalesce(near, "_none")).where("_n IS NOT NULL").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_at").alias("_from"), F.col("_n._v").alias(value), F.col("_n._at").alias(place))
    same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col(at).eqNullSafe(F.col("_from"))]
    return left.join(found, same).select(*left.columns, value, place)
