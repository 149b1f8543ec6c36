"""Mixing sources to target weights by temperature.

Source weights are the token shares to the power of an exponent, made to sum to one. The exponent is found by
bisection: the smallest one in [0, 1] at which no source is repeated more than a limit, or the one at which the
weights reach a target entropy. The budget, unless one is given, is the least number of tokens at which every source
comes whole at least once, so mixing repeats small sources and drops no document; under a smaller budget a source ends
early. Each source's stream is a sequence of epochs; an epoch permutes the source's blocks by a keyed hash, and documents
inside a block likewise, and the stream ends where the source's share of the budget does. mix_key (place in the stream
over its length) interleaves all streams at the target weights. DataFrame functions only.

Blocks are hash classes of about BLOCK_DOCS documents, so a source that holds a third of all rows is many small
groups; sums over blocks run in ranges of the permutation (two levels), never over one source in one task. Where in the
last epoch a source ends is one row for each source, so a table is mixed without dealing its rows anew.

Defined cases: a null text has no tokens; a null source is a source of its own; rows that repeat (doc_id, source)
are one document, repeated together; a document (in `mixed`: a row) without tokens is taken once; ties of the hash go by
doc_id; a table without tokens keeps its natural weights and comes once; an empty table gives no rows; other columns
pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, join_classes, running_start, staged

BLOCK_DOCS, RANGES = 256, 256
#: No source is repeated more often than this on average.
REPEATS = 2.0
#: Halvings of the exponent's interval; LEVELS of them are tried in one pass over the sources.
STEPS, LEVELS = 30, 5
SEED = 20


def word_tokens() -> Column:
    """Tokens of a text: its runs of non-space characters."""
    return F.coalesce(F.regexp_count("text", F.lit(r"\S++")), F.lit(0)).cast("long")


def _measures(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy of the weights, most repeats of a source at the least whole budget) for each exponent."""
    top = sources.agg(F.sum("tokens").alias("all"), F.max("tokens").alias("top"))
    p = sources.where("tokens > 0").crossJoin(F.broadcast(top)).select((F.col("tokens") / F.col("all")).alias("p"), (F.col("tokens") / F.col("top")).alias("q"))
    tried = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("x")) for i, x in enumerate(exponents)])).alias("e")
    each = p.select("p", "q", tried).select("e.i", "q", F.pow("p", "e.x").alias("w"), F.col("e.x").alias("x"), F.log("p").alias("logp"))
    found = each.groupBy("i").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("x") * F.col("logp")).alias("s"), F.max(F.pow("q", F.col("x") - 1)).alias("r"))
    by = {r["i"]: (math.log(r["z"]) - r["s"] / r["z"], r["r"]) for r in found.collect()}  # a row for each exponent tried
    return [by[i] for i in range(len(exponents))]


def bisect_exponent(sources: DataFrame, repeats: float | None = REPEATS, entropy: float | None = None) -> float:
    """sources: (source, tokens). Both measures fall as the exponent grows, so halving finds where the target is met."""
    if sources.where("tokens > 0").isEmpty():
        return 1.0
    met = (lambda m: m[0] <= entropy) if entropy is not None else (lambda m: m[1] <= repeats)
    low, high = 0.0, 1.0
    if met(_measures(sources, [low])[0]):
        return low
    for _ in range(STEPS // LEVELS):
        n = 1 << LEVELS
        grid = [low + (high - low) * k / n for k in range(1, n)]
        first = next((k for k, m in enumerate(_measures(sources, grid)) if met(m)), n - 1)
        low, high = (grid[first - 1] if first else low), (grid[first] if first < n - 1 else high)
    return high


def _block(n_blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "source"), n_blocks)


def _block_rank(epoch: Column, source: Column, block: Column) -> Column:
    return F.xxhash64(F.lit(SEED + 1), epoch, source, block)


def _doc_rank(epoch: Column) -> Column:
    return F.xxhash64(F.lit(SEED + 2), epoch, F.col("doc_id"))


def _dealt(docs: DataFrame, repeats: float | None, entropy: float | None, budget: int | None) -> tuple[DataFrame, DataFrame]:
    """Documents by epoch with their places in their source's stream, and a row for each source."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_tokens().alias("n"))
    sized = staged(sized.groupBy("doc_id", "source").agg(F.sum("n").alias("n")).withColumn("src", F.struct("source")), "sized")
    sources = staged(sized.groupBy("src").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")), "sources")
    exponent = bisect_exponent(sources, repeats, entropy)
    whole = sources.agg(F.max("tokens").alias("top"), F.sum(F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent)))).alias("z"))
    sources = sources.crossJoin(F.broadcast(whole))  # one row
    has = F.col("tokens") > 0
    weight = F.when(has, F.pow(F.col("tokens").cast("double"), F.lit(exponent)) / F.col("z")).otherwise(0.0)
    if budget is None:
        quota = F.greatest(F.col("tokens"), F.round(F.col("tokens") * F.pow(F.col("tokens") / F.col("top"), F.lit(exponent - 1))).cast("long"))
    else:
        quota = F.round(weight * budget).cast("long")
    sources = sources.select("src", "tokens", weight.alias("weight"), F.when(has, quota).otherwise(0).cast("long").alias("quota"), F.ceil(F.col("docs") / BLOCK_DOCS).alias("n_blocks"), F.col("docs").alias("_n"))
    sources = staged(sources.withColumn("epochs", F.greatest(F.lit(1), F.ceil(F.col("quota") / F.greatest("tokens", F.lit(1)))).cast("int")), "weights")
    dealt = join_classes(sized, sources, ["src"], sized.count(), "inner").withColumn("block", _block(F.col("n_blocks")))
    blocks = dealt.groupBy("src", "block").agg(F.sum("n").alias("block_tokens"), *[F.first(c).alias(c) for c in ("tokens", "weight", "quota", "epochs")])
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    blocks = blocks.withColumn("rank", _block_rank(F.col("epoch"), F.col("src.source"), F.col("block"))).withColumn("range", F.shiftrightunsigned("rank", 64 - int(math.log2(RANGES))))
    order = [F.shiftrightunsigned("rank", 1), F.col("rank"), F.col("block")]
    blocks = running_start(blocks, "range", order, F.col("block_tokens"), "in_epoch", by=["src", "epoch"])
    first = F.col("epoch") == 0 if budget is None else (F.col("epoch") == 0) & (F.col("tokens") == 0)
    blocks = blocks.withColumn("first", first).withColumn("block_start", F.col("epoch") * F.col("tokens") + F.col("in_epoch")).where("first OR block_start < quota")
    taken = dealt.select("src", "doc_id", "source", "n", "block").join(blocks.select("src", "block", "epoch", "epochs", "first", "rank", "block_start", "quota", "weight"), ["src", "block"])
    taken = taken.withColumn("doc_rank", _doc_rank(F.col("epoch")))
    inside = Window.partitionBy("src", "epoch", "block").orderBy("doc_rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    taken = taken.withColumn("start", F.col("block_start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return taken.where("first OR (start < quota AND (n > 0 OR epoch = 0))"), sources


def plan(docs: DataFrame, repeats: float | None = REPEATS, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, start, weight, mix_key): a row for each time a document is taken."""
    return _dealt(docs, repeats, entropy, budget)[0].select(
        "doc_id", "source", F.col("n").alias("n_tokens"), "epoch", "block", "start", "weight",
        F.when(F.col("quota") > 0, F.col("start") / F.col("quota")).otherwise(0.0).alias("mix_key"),
    )


def mixed(docs: DataFrame, repeats: float | None = REPEATS, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """docs with each row repeated as often as the plan takes its document; columns as they came.

    All epochs but a source's last take all of it. Of the last one a row tells by its own hashes whether it comes
    before the place where the source ends.
    """
    taken, sources = _dealt(docs, repeats, entropy, budget)
    key = F.struct(F.shiftrightunsigned("rank", 1).alias("a"), F.col("rank").alias("b"), F.col("block").alias("c"), F.col("doc_rank").alias("d"), F.col("doc_id").alias("e"))
    last = taken.where(F.col("epoch") == F.col("epochs") - 1).groupBy("src").agg(F.max(key).alias("last"))
    ends = staged(sources.join(last, "src", "left").select("src", "epochs", "n_blocks", "last", "_n"), "ends")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.rlike("text", F.lit(r"\S")), F.lit(False)).alias("has"))
    rows = rows.withColumn("src", F.struct("source"))
    few = ends.drop("_n")
    rows = rows.join(checked_broadcast(few), "src") if few.count() <= 100_000 else join_classes(rows, ends, ["src"], docs.count(), "inner")
    rows = rows.withColumn("block", _block(F.col("n_blocks"))).withColumn("epoch", F.col("epochs") - 1)
    rows = rows.withColumn("rank", _block_rank(F.col("epoch"), F.col("source"), F.col("block"))).withColumn("doc_rank", _doc_rank(F.col("epoch")))
    in_last = F.coalesce(key <= F.col("last"), F.lit(False)).cast("int")
    full = F.col("epochs") - 1
    times = F.when(F.col("has"), full + in_last).when(full > 0, 1).otherwise(in_last)
    return rows.withColumn("_copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).select("_row.*")


def op3(docs: DataFrame) -> DataFrame:
    return plan(docs)
