"""Similarity joins, blocked so that only pairs are made that can reach the threshold."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy, tables, text
from .relational import latest_per_key


def _rarest_first(sets: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """sets (key, _t) with _t in order of how rare its tokens are among `counted` (key, _t), the rarest first."""
    n = counted.select(F.explode("_t").alias("_w")).groupBy("_w").agg(F.count("*").alias("_n"))
    each = sets.select(key, F.explode("_t").alias("_w")).join(n, "_w", "left").select(key, F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_w").alias("w")).alias("_x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["w"]).alias("_t"))


def jaccard_best(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str, threshold: float, least: int = 2, apart: bool = False) -> DataFrame:
    """Each left row's best right row by Jaccard of token sets (lowest id of equals), at the threshold or above.

    apart: both sides are one table, and no row is matched with its own id. Equal sets are one set with its two lowest
    ids. Two sets of Jaccard j share a token among the first n - ceil(j * n) + 1 of each, whatever the order of tokens,
    so sets meet only in those, with the rarest tokens first: a common token makes pairs only of sets that lack others.
    """
    key = lambda c: F.array_join(F.array_sort(c), "\u0001")
    side = lambda df, i: df.where(F.size(tokens) >= least).select(F.col(i).alias("_id"), F.array_distinct(tokens).alias("_t")).withColumn("_k", key(F.col("_t")))
    a, b = side(left, left_id), side(right, right_id)
    low = b.groupBy("_k").agg(F.first("_t").alias("_t"), F.min("_id").alias("_r1"))
    second = b.join(low.select("_k", "_r1"), "_k").where("_id > _r1").groupBy("_k").agg(F.min("_id").alias("_r2"))
    sets_b, sets_a = low.join(second, "_k", "left"), a.groupBy("_k").agg(F.first("_t").alias("_t"))
    every = sets_a.select("_k", "_t").unionByName(sets_b.select("_k", "_t")).dropDuplicates(["_k"])
    ordered = _rarest_first(every, every, "_k")
    cut = F.slice("_t", F.lit(1), (F.size("_t") - F.ceil(threshold * F.size("_t") - 1e-9) + 1).cast("int"))
    head = ordered.select("_k", F.explode(cut).alias("_w"))
    x = head.join(sets_a.select("_k"), "_k", "left_semi").select(F.col("_k").alias("_ka"), "_w")
    y = head.join(sets_b.select("_k"), "_k", "left_semi").select(F.col("_k").alias("_kb"), "_w")
    pairs = x.join(y, "_w").select("_ka", "_kb").distinct()
    full = pairs.join(sets_a.select(F.col("_k").alias("_ka"), F.col("_t").alias("_ta")), "_ka").join(sets_b.select(F.col("_k").alias("_kb"), F.col("_t").alias("_tb"), "_r1", "_r2"), "_kb")
    both = F.size(F.array_intersect("_ta", "_tb"))
    scored = full.withColumn("score", both / (F.size("_ta") + F.size("_tb") - both)).where(F.col("score") >= threshold)
    # a left row's best is among the best two sets: only its own id can put one of them back
    w = Window.partitionBy("_ka").orderBy(F.col("score").desc(), "_r1")
    top = scored.withColumn("_n", F.row_number().over(w)).where("_n <= 2").select(F.col("_ka").alias("_k"), "score", "_r1", "_r2")
    met = a.select("_id", "_k").join(top, "_k")
    other = F.when(F.col("_r1") != F.col("_id"), F.col("_r1")).otherwise(F.col("_r2")) if apart else F.col("_r1")
    return latest_per_key(met.withColumn("_r", other).where("_r IS NOT NULL"), ["_id"], [F.desc("score"), F.col("_r")]).select(F.col("_id").alias(left_id), F.col("_r").alias(right_id), "score")


def subset_match(raw: DataFrame, names: DataFrame, raw_id: str, name: str, raw_tokens: str, name_tokens: str, noise: list[str] | None = None, heads: list[str] | None = None) -> DataFrame:
    """Names all of whose tokens occur in a raw text, the most specific one if it stands alone.

    Names of noise alone match nothing, and where a text has a head noun, a name must have one of the text's. A name meets
    the texts that have its rarest token.
    """
    noise, heads = (tables.PACKAGING if noise is None else noise), (tables.DISHES if heads is None else heads)
    lits = lambda ws: F.array(*map(F.lit, ws)) if ws else F.array().cast("array<string>")
    have = raw.select(raw_id, F.array_distinct(raw_tokens).alias("_t"))
    need = names.select(name, F.array_distinct(name_tokens).alias("_t")).where((F.size("_t") > 0) & (F.size(F.array_except("_t", lits(noise))) > 0))
    rare = _rarest_first(need, have, name).select(name, F.get("_t", 0).alias("_w"), F.col("_t").alias("_need"))
    met = have.select(raw_id, F.col("_t").alias("_have"), F.explode("_t").alias("_w")).join(rare, "_w").where(F.size(F.array_except("_need", "_have")) == 0)
    own = F.array_intersect("_have", lits(heads))
    met = met.where((F.size(own) == 0) | F.arrays_overlap("_need", own)).select(raw_id, name, F.size("_need").alias("_n"))
    w = Window.partitionBy(raw_id)
    top = met.withColumn("_most", F.max("_n").over(w)).where("_n = _most").withColumn("_alone", F.count("*").over(w)).where("_alone = 1")
    return top.select(raw_id, name, F.col("_n").cast("long").alias("n_tokens"))


def greedy_match(left: DataFrame, right: DataFrame, group: str, a: str, b: str, tokens: str, low: float = 0.7) -> DataFrame:
    """(group, a, b, score): one to one within a group, in the order of the left ids: equal token sets first, then the
    best Jaccard from `low` on of the right rows that are left (the lowest id of equals). Groups are small: a group is
    one row of two lists, and Arrow batches hold many groups."""
    import pandas as pd

    def pairs(x: list, y: list) -> list:
        rows = sorted((r["id"], frozenset(r["t"])) for r in x if r["t"] is not None)
        free = dict(sorted((r["id"], frozenset(r["t"])) for r in y if r["t"] is not None))
        out, open_rows = [], []
        for i, t in rows:
            same = next((j for j, u in free.items() if t and u == t), None)
            if same is None:
                open_rows.append((i, t))
            else:
                del free[same]
                out.append((i, same, 1.0))
        for i, t in open_rows:
            scored = [(-len(t & u) / len(t | u), j) for j, u in free.items() if t]
            score, j = min(scored, default=(0.0, None))
            if j is not None and -score >= low and score < 0:
                del free[j]
                out.append((i, j, -score))
        return out

    def match(batches):
        for frame in batches:
            found = [(g, *p) for g, x, y in zip(frame["g"], frame["x"], frame["y"]) for p in pairs(x, y)]
            yield pd.DataFrame(found, columns=[group, a, b, "score"])

    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema, *right.schema]}
    schema = f"{group} {kinds[group]}, {a} {kinds[a]}, {b} {kinds[b]}, score double"
    listed = lambda df, c, name: df.groupBy(F.col(group).alias("g")).agg(F.collect_list(F.struct(F.col(c).alias("id"), F.col(tokens).alias("t"))).alias(name))
    return listed(left, a, "x").join(listed(right, b, "y"), "g").mapInPandas(match, schema)


def typo_pairs(names: DataFrame, name: str, score: Callable[[Column, Column], Column], low: float = 90.0, length: int = 3) -> DataFrame:
    """Pairs of distinct names that are alike but not equal; skipped only if both have words of four letters or more
    and share none, or their lengths differ by more."""
    from .resolution import band_pairs

    long_words = F.filter(text.words(F.col(name)), lambda w: F.length(w) >= 4)
    unique = names.select(name).where(F.col(name).isNotNull()).distinct().select(F.col(name).alias("a"), long_words.alias("_x"), F.length(name).alias("_m"))
    other = unique.select(F.col("a").alias("b"), F.col("_x").alias("_y"), F.col("_m").alias("_n"))
    pairs = band_pairs(unique, other, "a", "b", low).where("a < b").join(unique, "a").join(other, "b")
    shares = (F.size("_x") == 0) | (F.size("_y") == 0) | F.arrays_overlap("_x", "_y")
    pairs = pairs.where(shares & (F.abs(F.col("_m") - F.col("_n")) <= length)).select("a", "b")
    return pairs.withColumn("ratio", score(F.col("a"), F.col("b"))).where((F.col("ratio") >= low) & (F.col("ratio") < 100))


def best_of_all(names: DataFrame, name: str, low: float) -> DataFrame:
    """Each name's best other name by token-sort ratio (first of equals), at `low` or above: (name, other, score)."""
    from .resolution import band_pairs

    words = F.filter(F.split(F.col(name), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    a = names.select(name).where(F.col(name).isNotNull()).distinct().withColumn("_a", F.array_join(F.array_sort(words), " "))
    b = a.select(F.col(name).alias("other"), F.col("_a").alias("_b"))
    pairs = band_pairs(a, b, "_a", "_b", low).join(a, "_a").join(b, "_b").where(F.col(name) != F.col("other"))
    scored = pairs.withColumn("score", fuzzy.scorer(fuzzy.indel)(F.col("_a"), F.col("_b"))).where(F.col("score") >= low)
    return latest_per_key(scored.select(name, "other", "score"), [name], [F.desc("score"), F.col("other")])


def resolve(items: DataFrame, mappings: DataFrame, item_id: str, tiers: list[tuple[str, Column, Column]]) -> DataFrame:
    """Tiered entity resolution by equal keys: the first tier whose key matches gives the target.

    tiers: (name, key of an item, key of a mapping). Rows that no tier matches are 'unmatched'.
    """
    left, done = items, None
    for label, item_key, map_key in tiers:
        keyed = mappings.select(map_key.alias("_k"), "target").where("_k IS NOT NULL AND _k != ''").groupBy("_k").agg(F.min("target").alias("target"))
        tried = left.withColumn("_k", item_key).join(keyed, "_k", "left").drop("_k")
        hit = tried.where(F.col("target").isNotNull()).withColumn("tier", F.lit(label))
        done = hit if done is None else done.unionByName(hit)
        left = tried.where(F.col("target").isNull()).drop("target")
    rest = left.withColumn("target", F.lit(None).cast(mappings.schema["target"].dataType)).withColumn("tier", F.lit("unmatched"))
    return rest if done is None else done.unionByName(rest)


def food_score(name: Column, other: Column, words: Column, other_words: Column, disqualifying: list[str]) -> Column:
    """0.6 of the name's words covered and 0.4 of string likeness, less 0.35 without its first word and 0.5 for each
    disqualifying word that only the other has; never under 0."""
    covered = F.size(F.array_intersect(words, other_words)) / F.size(F.array_distinct(words))
    extra = F.size(F.array_intersect(F.array_except(other_words, words), F.array(*map(F.lit, disqualifying))))
    head = F.when(F.array_contains(other_words, F.get(words, 0)), 0.0).otherwise(0.35)
    return F.greatest(F.lit(0.0), 0.6 * covered + 0.4 * fuzzy.scorer(fuzzy.sequence)(name, other) - head - 0.5 * extra)
