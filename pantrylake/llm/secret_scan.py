"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order models over a 66-symbol alphabet are trained from labelled samples. Random: keys made from SHA-256 in
several alphabets, and the values that the fixed patterns find. Ordinary: long words of the corpus outside any such
match, also joined as snake_case and camelCase identifiers. A token of LEAST_VALUE characters or more is a secret when
its log-likelihood ratio passes THRESHOLD and EACH; where a fixed pattern's match covers part of a token, the rest is
judged. The classifier's sample is bounded
(TRAIN_DOCS documents by a hash of doc_id and text, MADE_KEYS made keys); every text is scanned whole. DataFrame functions
only.

Positions are code points, end exclusive. Defined cases: a null text counts as empty and has no spans; ties are
ordered by start, then kind (assign, access, hex, random); repeated rows are scanned alike; an empty table gives no
rows; without any ordinary words only the made samples and smoothing speak. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, staged

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "random")
#: Tokens that the models judge: runs of key characters, as long as an assigned value must be.
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_VALUE},}}={{0,2}}(?![A-Za-z0-9+/_-])"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
SIZE = len(SYMBOLS) + 1
#: Nats that the ratio must reach, in all and for each character.
THRESHOLD, EACH = 12.0, 0.45
TRAIN_DOCS, MADE_KEYS, LEAST_WORD = 2000, 4000, 8
#: Matches of a text that are placed together.
LOT = 512


def _code(c: Column) -> Column:
    return F.instr(F.lit(SYMBOLS), c)


def _pairs(tokens: DataFrame) -> DataFrame:
    """(label, pair, n): how often each pair of neighbouring symbols occurs; a token starts after symbol 0."""
    codes = F.concat(F.array(F.lit(0)), F.transform(F.split("token", ""), _code))
    pairs = F.transform(F.sequence(F.lit(0), F.size("codes") - 2), lambda i: F.get("codes", i) * SIZE + F.get("codes", i + 1))
    return tokens.withColumn("codes", codes).where(F.size("codes") > 1).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))


def made_keys(spark: SparkSession) -> DataFrame:
    """Random strings by rule: SHA-256 of a counter in hexadecimal, upper-case hexadecimal, base64 and letters with digits."""
    made = spark.range(MADE_KEYS).select("id", F.sha2(F.concat(F.lit("key"), F.col("id").cast("string")).cast("binary"), 256).alias("h"))
    wide = F.base64(F.unhex("h"))
    token = F.when(F.col("id") % 5 == 0, F.substring("h", 1, 40)).when(F.col("id") % 5 == 1, F.upper(F.substring("h", 1, 32))).when(F.col("id") % 5 == 2, wide).when(
        F.col("id") % 5 == 3, F.regexp_replace(wide, "[+/=]", "")
    ).otherwise(F.substring(F.upper(F.regexp_replace(wide, "[+/=]", "")), 1, 32))
    return made.select(F.lit(1).alias("label"), token.alias("token"))


def training_tokens(docs: DataFrame) -> DataFrame:
    """(label, token): labelled samples; 1 random, 0 ordinary."""
    sample = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    few = hash_sample(sample, TRAIN_DOCS, sample.count(), "doc_id", "text")
    sample = staged(few.orderBy(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1), "doc_id", "text").limit(TRAIN_DOCS), "sample")
    values = F.concat(
        F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST_VALUE),
        F.regexp_extract_all("text", F.lit(f"({ACCESS}|{HEX})"), F.lit(1)),
    )
    clean = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    words = F.filter(F.regexp_extract_all(clean, F.lit(rf"(?<![A-Za-z0-9])([A-Za-z]{{{LEAST_WORD},}})(?![A-Za-z0-9])"), F.lit(1)), lambda w: ~F.rlike(w, F.lit("[a-z][A-Z]")))
    found = sample.select(values.alias("values"), words.alias("words"))
    pair = lambda i: F.get("words", i)
    index = F.when(F.size("words") > 1, F.sequence(F.lit(0), F.size("words") - 2)).otherwise(F.array().cast("array<int>"))
    joined = F.transform(index, lambda i: F.when(i % 2 == 0, F.concat_ws("_", pair(i), pair(i + 1))).otherwise(F.concat(F.lower(pair(i)), F.initcap(pair(i + 1)))))
    return (
        found.select(F.lit(1).alias("label"), F.explode("values").alias("token"))
        .unionByName(found.select(F.lit(0).alias("label"), F.explode(F.concat("words", joined)).alias("token")))
        .unionByName(made_keys(docs.sparkSession))
    )


def fit(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios of all symbol pairs (SIZE x SIZE of them), with add-half smoothing."""
    counts = {0: [0.5] * SIZE * SIZE, 1: [0.5] * SIZE * SIZE}
    for label, pair, n in _pairs(training_tokens(docs)).collect():  # at most 2 * SIZE * SIZE rows
        counts[label][pair] += n
    ratio = []
    for before in range(SIZE):
        own = {k: counts[k][before * SIZE : (before + 1) * SIZE] for k in (0, 1)}
        total = {k: sum(v) for k, v in own.items()}
        ratio += [math.log(r / total[1]) - math.log(o / total[0]) for r, o in zip(own[1], own[0])]
    return ratio


def likelihood_ratio(token: Column, model: list[float]) -> Column:
    table = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in model) + "]"), "array<double>")
    step = lambda s, c: F.struct(_code(c).alias("at"), (s["sum"] + F.get(table, s["at"] * SIZE + _code(c))).alias("sum"))
    return F.aggregate(F.split(token, ""), F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"])


def _spans(pattern: str, value_group: int | None, kind: str) -> Column:
    """All matches with their places: struct(start, rank, end, value). Each match is read with the gap before it.

    The last gap ends with the text, so that no search fails and starts over from the next character.
    """
    whole = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    gap, match = F.regexp_extract_all("text", whole, F.lit(1)), F.regexp_extract_all("text", whole, F.lit(2))
    value = F.regexp_extract_all("text", whole, F.lit(value_group)) if value_group else match
    parts = F.transform(F.arrays_zip(gap.alias("g"), match.alias("m"), value.alias("v")), lambda p: F.struct(F.length(p["g"]).alias("g"), F.length(p["m"]).alias("n"), p["v"].alias("v")))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    step = lambda s, p: F.struct(
        (s["at"] + p["g"] + p["n"]).alias("at"),
        F.array_append(s["out"], F.struct((s["at"] + p["g"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (s["at"] + p["g"] + p["n"]).alias("end"), p["v"].alias("value"))).alias("out"),
    )
    placed = lambda lot, at: F.aggregate(lot, F.struct(at.alias("at"), empty.alias("out")), step, lambda s: s["out"])
    # an array grows by one at the cost of a copy, so many matches are placed in lots
    lots = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / LOT).cast("int")), lambda k: F.slice(parts, k * LOT + 1, F.lit(LOT)))
    width = lambda lot: F.aggregate(lot, F.lit(0), lambda s, p: s + p["g"] + p["n"])
    starts = F.aggregate(lots, F.array(F.lit(0)), lambda s, lot: F.array_append(s, F.element_at(s, -1) + width(lot)))
    in_lots = F.flatten(F.zip_with(lots, F.slice(starts, F.lit(1), F.size(lots)), placed))
    found = F.filter(F.when(F.size(parts) <= LOT, placed(parts, F.lit(0))).otherwise(in_lots), lambda x: x["end"] > x["start"])
    return F.when(F.rlike("text", F.lit(pattern)), found).otherwise(empty)


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _outside(tokens: Column, base: Column) -> Column:
    """The parts of tokens that no base span covers, from LEAST_VALUE characters on."""

    def parts(t: Column) -> Column:
        near = F.filter(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
        starts = F.array_distinct(F.concat(F.array(t["start"]), F.transform(near, lambda b: b["end"])))
        starts = F.filter(starts, lambda p: (p < t["end"]) & ~F.exists(near, lambda b: (b["start"] <= p) & (p < b["end"])))
        stop = lambda p: F.least(t["end"], F.array_min(F.transform(F.filter(near, lambda b: b["start"] > p), lambda b: b["start"])))
        part = lambda p: F.struct(p.alias("start"), t["rank"].alias("rank"), stop(p).alias("end"), F.substring(t["value"], p - t["start"] + 1, stop(p) - p).alias("value"))
        return F.when(F.size(near) == 0, F.array(t)).otherwise(F.transform(starts, part))

    return F.filter(F.flatten(F.transform(tokens, parts)), lambda x: x["end"] - x["start"] >= LEAST_VALUE)


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """(doc_id, base, added): spans of the fixed patterns, and those that the models add, as arrays."""
    model = fit(docs) if model is None else model
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        F.filter(_spans(ASSIGN, 4, "assign"), lambda s: F.length(s["value"]) >= LEAST_VALUE).alias("assign"),
        _spans(ACCESS, None, "access").alias("access"),
        _spans(HEX, None, "hex").alias("hex"),
        _spans(TOKEN, None, "random").alias("tokens"),
    )
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    rows = rows.withColumn("free", _outside(F.col("tokens"), F.col("base")))
    score = lambda t: likelihood_ratio(t["value"], model)
    added = F.filter("free", lambda t: score(t) >= F.greatest(F.lit(THRESHOLD), EACH * F.length(t["value"])))
    return rows.select("doc_id", "assign", "access", "hex", "base", F.when(F.size("free") > 0, added).otherwise(F.col("free")).alias("added"))


def op4(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
    )
