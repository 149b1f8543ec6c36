"""Fact upsert: incoming invoice lines meet stored ones through an ordered cascade of keys.

stored: (id, vendor, number, day, code, fk, file, raw, product, unit_price, extended, quantity, edited, *fields).
incoming: the same without id and edited, with seq, its place in the batch. Every step joins what is still open on both
sides by its key and pairs the k-th incoming row with the k-th stored one, so a stored row is claimed once; stored rows
of a collapsing key that are left over are merged into the one that was claimed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import cut

#: Fields that keep the stored value where the incoming one is missing.
KEPT = ["per_pound", "quantity", "purchase_unit", "pack_count", "pack_size", "pack_unit", "total_pounds", "count_low", "count_high"]


def text_key(c: Column) -> Column:
    """Upper case without blanks and without a leading word of one letter."""
    t = F.upper(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    return F.replace(F.regexp_replace(t, r"^\p{L}(?: |$)", ""), F.lit(" "), F.lit(""))


def _missing(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def cascade(stored: DataFrame, incoming: DataFrame, guarded: bool = True) -> tuple[DataFrame, DataFrame]:
    """((seq, id, step), (id)): which stored row each incoming one updates (none: it is new), and stored rows that are
    merged away.

    Steps: 1 number and code, equal price first (left over: merged); 2 a row a person edited, by number, price and sum;
    3 catalogue key, number, day and text; 4 without a number: catalogue key, day and file, or its hash before a "+";
    5 text, within the number or, without one, the day; 6 product, day, price, quantity and text, unless 3 decided
    (left over: merged). guarded=False lets step 3 go before 1 and 2 where it applies: the order that was in use, in which
    a row that 3 does not find is not looked up by 1 or 2 either.
    """
    s = stored.select("id", "vendor", "number", "day", "code", "fk", "file", text_key(F.col("raw")).alias("t"), "product", "unit_price", "extended", "quantity", F.coalesce("edited", F.lit(False)).alias("edited"))
    s = s.withColumn("hash", F.split_part(F.coalesce("file", F.lit("")), F.lit("+"), F.lit(1)))
    i = incoming.select("seq", "vendor", "number", "day", "code", "fk", "file", text_key(F.col("raw")).alias("t"), "product", "unit_price", "extended", "quantity")
    i = i.withColumn("hash", F.split_part(F.coalesce("file", F.lit("")), F.lit("+"), F.lit(1)))
    matched, merged = None, None
    numbered = ~_missing("number")
    decided = numbered & F.col("fk").isNotNull() & F.col("day").isNotNull()

    def step(name: str, keys: list[str], which: Column, of: Column, collapse: bool) -> None:
        nonlocal s, i, matched, merged
        k = [F.col(c) for c in keys]
        present = which
        for c in keys:
            present = present & F.col(c).isNotNull()
        a = i.where(present).withColumn("_k", F.row_number().over(Window.partitionBy(*k).orderBy("seq")))
        b = s.where(of).withColumn("_k", F.row_number().over(Window.partitionBy(*k).orderBy("id")))
        pairs = a.select(*keys, "_k", "seq").join(b.select(*keys, "_k", "id"), [*keys, "_k"]).select("seq", "id", *keys)
        pairs = cut(pairs)
        hit = pairs.select("seq", "id", F.lit(name).alias("step"))
        matched = hit if matched is None else matched.unionByName(hit)
        s, i = s.join(pairs.select("id"), "id", "left_anti"), i.join(pairs.select("seq"), "seq", "left_anti")
        if collapse:
            rest = s.where(of).join(pairs.select(*keys).distinct(), keys, "left_semi").select("id")
            rest = cut(rest)
            merged = rest if merged is None else merged.unionByName(rest)
            s = s.join(rest, "id", "left_anti")

    yes = F.lit(True)

    def catalogue() -> None:
        step("3 catalogue key", ["vendor", "fk", "number", "day", "t"], numbered, yes, False)

    open_ = yes if guarded else ~decided
    if not guarded:
        catalogue()
    step("1 code and price", ["vendor", "number", "code", "unit_price"], numbered & ~_missing("code") & open_, ~_missing("code"), True)
    step("1 code", ["vendor", "number", "code"], numbered & ~_missing("code") & open_, ~_missing("code"), True)
    step("2 edited", ["vendor", "number", "unit_price", "extended"], numbered & open_, F.col("edited"), False)
    if guarded:
        catalogue()
    step("4 file", ["vendor", "fk", "file", "day"], ~numbered & ~_missing("file"), yes, False)
    step("4 hash", ["vendor", "fk", "hash", "day"], ~numbered & ~_missing("file"), yes, False)
    # a text that several open rows share waits for step 6, unless it has no product
    shared = Window.partitionBy("vendor", "number", "t")
    s = s.withColumn("_n", F.count("*").over(shared))
    step("5 text in number", ["vendor", "number", "t"], numbered & F.col("product").isNull(), yes, True)
    step("5 text in number", ["vendor", "number", "t"], numbered, F.col("_n") == 1, False)
    s = s.withColumn("_n", F.count("*").over(Window.partitionBy("vendor", "day", "t")))
    step("5 text on day", ["vendor", "day", "t"], ~numbered & F.col("product").isNull(), yes, True)
    step("5 text on day", ["vendor", "day", "t"], ~numbered, F.col("_n") == 1, False)
    step("6 product", ["vendor", "product", "day", "unit_price", "quantity", "t"], ~decided, yes, True)
    return matched, merged


def applied(stored: DataFrame, incoming: DataFrame, matched: DataFrame, merged: DataFrame) -> DataFrame:
    """The table after the upsert: edited rows stay as they are, KEPT fields keep a stored value where the incoming one
    is missing, a stored catalogue key stays, merged rows go, and rows without a match are new (id null)."""
    fields = [c for c in stored.columns if c not in ("id", "edited")]
    n = incoming.select("seq", *[F.col(c).alias(f"_{c}") for c in fields]).join(matched.select("seq", "id"), "seq")
    both = stored.join(merged, "id", "left_anti").join(n, "id", "left")
    fresh = F.col("seq").isNotNull() & ~F.coalesce("edited", F.lit(False))

    def value(c: str) -> Column:
        new = F.col(f"_{c}")
        if c in KEPT:
            new = F.when(F.coalesce(new.cast("string"), F.lit("")) == "", F.col(c)).otherwise(new)
        if c == "fk":
            return F.when(F.col("seq").isNotNull(), F.coalesce("fk", new)).otherwise(F.col("fk"))
        return F.when(fresh, new).otherwise(F.col(c))

    old = both.select("id", "edited", *[value(c).alias(c) for c in fields])
    new = incoming.join(matched.select("seq"), "seq", "left_anti")
    return old.unionByName(new.select(F.lit(None).cast("long").alias("id"), F.lit(False).alias("edited"), *fields))


def without_placeholders(rows: DataFrame, written: DataFrame) -> DataFrame:
    """Placeholder lines ("[... #code]") go once a line with a real text and that code is written for the vendor and day."""
    code = F.regexp_extract("raw", r"^\[[^\]]*#(\d+)\]$", 1)
    real = written.where(~_missing("code") & ~F.rlike(F.coalesce("raw", F.lit("")), F.lit(r"^\[[^\]]*#\d+\]$"))).select(F.col("vendor").alias("_v"), F.col("day").alias("_d"), F.col("code").alias("_c")).distinct()
    same = (F.col("vendor") == F.col("_v")) & (F.col("day") == F.col("_d")) & (code == F.col("_c"))
    return rows.join(real, same, "left_anti")
