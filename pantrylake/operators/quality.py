"""Data quality: duplicates, upserts, outliers, reconciliation, cadence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import cut


def collapse_duplicates(df: DataFrame, keys: list[str], best: list[Column]) -> DataFrame:
    """One row of each key: the first in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where("_rn = 1").drop("_rn")


def merge_upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: Column | None = None, fill: tuple[str, ...] = ()) -> DataFrame:
    """Old rows updated by new ones of their key, and new rows. keep_old: rows that win whole (o is the old side);
    fill: columns that keep the old value where the new one is null."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    has_old, has_new = (F.coalesce(*[F.col(f"{s}.{k}") for k in keys]).isNotNull() for s in "on")
    frozen = F.coalesce(keep_old, F.lit(False)) if keep_old is not None else F.lit(False)
    out = []
    for c in old.columns:
        fresh = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in fill else F.col(f"n.{c}")
        out.append(F.when(~has_new | (has_old & frozen), F.col(f"o.{c}")).otherwise(fresh).alias(c))
    return both.select(*out)


def median_outliers(df: DataFrame, keys: list[str], value: str, least: int, low: float, high: float) -> DataFrame:
    """Rows under low x or over high x of their group's exact median, in groups of `least` rows or more."""
    medians = df.groupBy(*keys).agg(F.median(value).alias("median"), F.count("*").alias("group_n")).where(F.col("group_n") >= least)
    return df.join(medians, keys).where((F.col(value) < low * F.col("median")) | (F.col(value) > high * F.col("median")))


def cadence(df: DataFrame, key: str, day: str, as_of: str, least_days: int = 3, urgent: float = 0.9) -> DataFrame:
    """Keys whose time since the last of their distinct days nears their mean gap: mean_gap, days_since, urgency."""
    days = df.select(key, day).distinct()
    w = Window.partitionBy(key).orderBy(day)
    gaps = days.withColumn("gap", F.datediff(day, F.lag(day).over(w)))
    facts = gaps.groupBy(key).agg(F.count("*").alias("n_days"), F.avg("gap").alias("mean_gap"), F.max(day).alias("last_day"))
    facts = facts.where(F.col("n_days") >= least_days).withColumn("days_since", F.datediff(F.lit(as_of).cast("date"), "last_day"))
    return facts.withColumn("urgency", F.col("days_since") / F.col("mean_gap")).where(F.col("urgency") >= urgent)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Full outer comparison of two sums by key: both, the gap and which side lacks it."""
    both = left.join(right, keys, "full_outer")
    side = F.when(F.col(a).isNull(), "right only").when(F.col(b).isNull(), "left only").otherwise("both")
    return both.select(*keys, F.coalesce(a, F.lit(0.0)).alias(a), F.coalesce(b, F.lit(0.0)).alias(b), side.alias("side"), F.round(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)), 2).alias("gap"))


def coverage(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """How many rows of each key have each column filled, with a total row."""
    filled = [F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(f"has_{c}") for c in columns]
    return df.rollup(key).agg(F.count("*").alias("n"), *filled)


def survivors(df: DataFrame, keys: list[str], edited: str, row_id: str, newest: str | None = None) -> DataFrame:
    """One row of each key: an edited one with the lowest id, else the lowest id, or (newest) the last imported."""
    order = [F.coalesce(F.col(edited), F.lit(False)).desc(), *([F.col(newest).desc()] if newest else []), F.col(row_id)]
    return collapse_duplicates(df, keys, order)


def catalogue_collapse(df: DataFrame, keys: list[str], row_id: str, source: str, amount: str, fill: list[str]) -> DataFrame:
    """Groups of a catalogue key as one row each, with its class: same source, variance (the amounts differ) or cross
    source. The most filled row stays (the lowest id of equals) and takes what it lacks from the others, in order."""
    filled = sum((F.col(c).isNotNull() & (F.col(c).cast("string") != "")).cast("int") for c in fill)
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.col("_filled").desc(), row_id).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.withColumn("_filled", filled).withColumn("_rn", F.row_number().over(w.orderBy(F.col("_filled").desc(), row_id)))
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("_lo", F.min(amount).over(w)).withColumn("_hi", F.max(amount).over(w)).withColumn("_s", F.min(source).over(w)).withColumn("_t", F.max(source).over(w))
    for c in fill:
        value = F.when(F.col(c).cast("string") != "", F.col(c))
        rows = rows.withColumn(f"_{c}", F.first(value, ignorenulls=True).over(order))
    kind = F.when(F.col("n") == 1, "single").when(F.col("_lo") != F.col("_hi"), "variance").when(F.col("_s") == F.col("_t"), "same source").otherwise("cross source")
    out = rows.withColumn("class", kind).where("_rn = 1")
    for c in fill:
        out = out.withColumn(c, F.col(f"_{c}"))
    return out.select(*df.columns, "n", "class")


def not_parsed(rows: DataFrame, parsed: DataFrame, invoice: list[str], key: list[str]) -> DataFrame:
    """Stored rows whose key no parse of their invoice emits; invoices without any parse are left alone."""
    seen = rows.join(parsed.select(*invoice).distinct(), invoice, "left_semi")
    return seen.join(parsed.select(*invoice, *key).distinct(), [*invoice, *key], "left_anti")


def outliers(df: DataFrame, keys: list[str], value: str, least: int = 4, low: float = 0.2, high: float = 5.0, near: tuple[float, float] = (0.7, 1.5), peers: int = 2) -> DataFrame:
    """Rows under low x or over high x of their group's exact median, unless `peers` other rows have a value near theirs."""
    from .relational import peer_count

    found = median_outliers(df, keys, value, least, low, high)
    key = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    suspects = found.select(key.alias("_key")).distinct()
    group = df.withColumn("_key", key).join(suspects, "_key", "left_semi")
    counted = peer_count(group, "_key", value, *near).select(F.col("_key"), F.col(value).alias("_v"), "peers").distinct()
    return found.withColumn("_key", key).join(counted, (F.col("_key") == counted["_key"]) & (F.col(value).cast("double") == F.col("_v"))).where(F.col("peers") < peers).select(*found.columns, "peers")


def list_price_drift(rows: DataFrame, prices: DataFrame, keys: list[str], paid: str, aligned: float = 0.02, top: float = 0.15) -> DataFrame:
    """rows with the net list price nearest to what was paid, the drift and its class: aligned, over, under, far over,
    far under. prices: (*keys, list_price, discount)."""
    net = prices.select(*keys, (F.col("list_price") * (1 - F.coalesce("discount", F.lit(0.0)))).alias("net"))
    best = rows.withColumn("_id", F.monotonically_increasing_id()).join(net, keys)
    best = best.groupBy("_id").agg(F.min_by("net", F.struct(F.abs(F.col(paid) - F.col("net")), "net")).alias("net"), *[F.first(c).alias(c) for c in rows.columns])
    drift = F.try_divide(F.col(paid) - F.col("net"), F.col("net"))
    kind = F.when(F.abs(drift) <= aligned, "aligned").when(drift >= top, "far over").when(drift > 0, "over").when(drift <= -top, "far under").otherwise("under")
    return best.withColumn("drift", drift).withColumn("class", kind).drop("_id")


def swap_suspects(rows: DataFrame, group: list[str], order: list[str], product: str, price: str, band: tuple[float, float] = (0.5, 2.0), least: int = 3) -> DataFrame:
    """Neighbouring rows whose prices are both outside the band of their products' medians and inside it when swapped."""
    medians = rows.groupBy(product).agg(F.median(price).alias("_median"), F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    inside = lambda p, m: F.try_divide(p, m).between(*band)
    w = Window.partitionBy(*group).orderBy(*order)
    ahead = rows.join(medians, product, "left").withColumn("next_product", F.lead(product).over(w)).withColumn("next_price", F.lead(price).over(w)).withColumn("_next", F.lead("_median").over(w))
    out = ahead.where(F.col("_median").isNotNull() & F.col("_next").isNotNull())
    out = out.where(~inside(F.col(price), F.col("_median")) & ~inside(F.col("next_price"), F.col("_next")))
    return out.where(inside(F.col(price), F.col("_next")) & inside(F.col("next_price"), F.col("_median"))).drop("_median", "_next")


def section_check(parsed: DataFrame, printed: DataFrame, keys: list[str], slack: float = 0.50) -> DataFrame:
    """Sections' parsed sums against printed totals: ok, off, implausible (a printed total under parsed - slack was
    misread), parsed only or printed only. A labelled total goes before the largest number in the section's range.

    parsed: (*keys, section, amount). printed: (*keys, section, labelled, largest).
    """
    sums = parsed.groupBy(*keys, "section").agg(F.sum("amount").alias("parsed"))
    both = sums.join(printed.withColumn("printed", F.coalesce("labelled", "largest")), [*keys, "section"], "full_outer")
    gap = F.round(F.col("printed") - F.col("parsed"), 2)
    state = (
        F.when(F.col("parsed").isNull(), "printed only").when(F.col("printed").isNull(), "parsed only")
        .when(F.col("printed") < F.col("parsed") - slack, "implausible").when(F.abs(gap) <= slack, "ok").otherwise("off")
    )
    return both.select(*keys, "section", "parsed", "printed", gap.alias("gap"), state.alias("state"))


def rule_audit(df: DataFrame, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """(tier, rule, severity, n): rows that break each rule, in one pass. rules: (tier, rule, severity, condition)."""
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, (*_, c) in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.col(f"r{i}").alias("n")) for i, (t, r, s, _) in enumerate(rules)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def variant_clusters(df: DataFrame, product: str, words: Column, least: int = 1) -> DataFrame:
    """(product, variant, cluster): a product's descriptions that share words, directly or through others, have one
    cluster: its first description. words: the words of a description; `least` of them must be shared.

    Descriptions meet in the lists of their words, and clusters are the components of those links."""
    rows = df.select(F.col(product).alias("product"), F.col("variant"), F.array_distinct(words).alias("w")).where(F.col("variant").isNotNull()).distinct()
    by_word = rows.select("product", "variant", F.explode("w").alias("w"))
    pairs = by_word.join(by_word.select("product", F.col("variant").alias("other"), "w"), ["product", "w"]).where("variant > other")
    links = pairs.groupBy("product", "variant", "other").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("product", "variant", "other")
    label = rows.select("product", "variant", F.col("variant").alias("cluster"))
    both = cut(links.unionByName(links.select("product", F.col("other").alias("variant"), F.col("variant").alias("other"))))
    while True:  # each round carries a cluster's name one description further, and to the end of known names
        near = both.join(label.select("product", F.col("variant").alias("other"), F.col("cluster").alias("_c")), ["product", "other"]).groupBy("product", "variant").agg(F.min("_c").alias("_c"))
        new = label.join(near, ["product", "variant"], "left").select("product", "variant", "cluster", F.least("cluster", F.coalesce("_c", "cluster")).alias("_new"))
        jump = new.select("product", F.col("variant").alias("_new"), F.col("_new").alias("_far"))
        new = cut(new.join(jump, ["product", "_new"], "left").select("product", "variant", "cluster", F.coalesce("_far", "_new").alias("_new")))
        if new.where("cluster != _new").isEmpty():
            return label
        label = new.select("product", "variant", F.col("_new").alias("cluster"))


#: Grams of a unit of goods by how they are counted: pounds, fluid ounces, pieces.
GRAMS = {"weighed": 453.59237, "counted_with_volume": 29.5735, "counted_each": 50.0}


def macros(rows: DataFrame, keys: list[str], kind: str, quantity: str, spend: str, nutrients: list[str], grams: dict[str, float] = GRAMS) -> DataFrame:
    """(*keys, macro, grams, coverage, n): nutrients of 100 grams times the grams bought, by a weight rule for each class of
    goods; coverage: the share of spend whose weight and nutrients are known."""
    weight = F.try_element_at(F.create_map(*[F.lit(x) for kv in grams.items() for x in kv]), F.col(kind)) * F.col(quantity)
    known = weight.isNotNull()
    for c in nutrients:
        known = known & F.col(c).isNotNull()
    total = F.sum(F.when(known, F.col(spend)).otherwise(0)).cast("double") / F.sum(spend).cast("double")
    g = rows.groupBy(*keys).agg(*[F.sum(weight * F.col(c) / 100).alias(c) for c in nutrients], total.alias("coverage"), F.count("*").alias("n"))
    stacked = ", ".join(f"'{c}', `{c}`" for c in nutrients)
    return g.select(*keys, F.expr(f"stack({len(nutrients)}, {stacked}) AS (macro, grams)"), "coverage", "n")


def budget_trend(spend: DataFrame, heads: DataFrame, as_of: str, months: int, each: float, trust: float = 0.8) -> DataFrame:
    """(month, spend, budget, pace) of the last months up to a day: the budget is so much a head, the pace its share that
    has passed; the cached spend counts unless it is under `trust` of the reconciled one.

    spend: (month, spend, cached). heads: (month, heads).
    """
    day = F.lit(as_of).cast("date")
    spine = spend.sparkSession.range(months).select(F.trunc(F.add_months(day, -F.col("id").cast("int")), "month").alias("month"))
    both = spine.join(spend, "month", "left").join(heads, "month", "left")
    used = F.when(F.col("cached") < trust * F.col("spend"), F.col("spend")).otherwise(F.col("cached"))
    budget = F.coalesce("heads", F.lit(0)) * each
    share = F.when(F.col("month") == F.trunc(day, "month"), F.dayofmonth(day) / F.dayofmonth(F.last_day(day)).cast("double")).otherwise(1.0)
    return both.select("month", F.coalesce(used, F.lit(0.0)).alias("spend"), budget.alias("budget"), (budget * share).alias("pace"))
