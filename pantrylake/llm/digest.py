"""Document fingerprints: canonical exact digest.

A text is canonical after Unicode compatibility composition (NFKC), lower-casing and folding each run of white space
to one space, none at the ends. Its fingerprint is 128 bits of xxHash64 under two seeds. Groups of equal texts are
made from equal fingerprints; inside a bucket the canonical bytes themselves are compared, so two texts that share a
fingerprint by chance still fall into two groups. DataFrame functions only; NFKC is one `reflect` call to the ICU
library that Spark itself brings for its collations (com.ibm.icu.text.Normalizer).

Defined cases: a null text counts as empty; documents follow one another by descending doc_id, then descending hash
of the text, null ids last; after the last comes the first, so a single document is its own next one; repeated rows
each get a row, and equal rows follow one another; an empty table gives no rows. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bucket_count, join_classes, range_bucket, staged, text_or_empty

#: Characters that stay white space under NFKC: Java's \s, then next line, line and paragraph separators and the
#: separators 1C to 1F. (NFKC makes plain spaces of the others.)
SPACES = r"[\s\x{85}\x{1680}\x{2028}\x{2029}\x1c-\x1f]+"
#: Copies of one row that a task writes.
COPIES = 100_000


def composed(text: str) -> Column:
    """NFKC of a column; ASCII texts are composed as they are. Belongs in a select of its own (it calls a Java method)."""
    folded = F.expr(f"reflect('com.ibm.icu.text.Normalizer', 'compose', `{text}`, true)")
    return F.when(F.octet_length(text) == F.length(text), F.col(text)).otherwise(folded)


def folded(composed_text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(composed_text), SPACES, " "))


def wide_hash(canonical: Column) -> Column:
    """128 bits as 32 hex digits: xxHash64 under Spark's seed, and under another seed derived from it."""
    digits = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.lower(F.concat(digits(F.xxhash64(canonical)), digits(F.xxhash64(F.lit(1), canonical))))


def with_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Add the fingerprint of a text column."""
    return docs.withColumn("_composed", composed(text)).withColumn(name, wide_hash(folded(F.col("_composed")))).drop("_composed")


def groups(docs: DataFrame, fingerprints: DataFrame | None = None) -> DataFrame:
    """(doc_id, fingerprint, group_id): group_id is the smallest doc_id with the same canonical bytes.

    fingerprints: (doc_id, fingerprint, *more) of the same documents, where they are known already; more is kept.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    known = fingerprints if fingerprints is not None else staged(with_fingerprint(texts, "text", "fingerprint").select("doc_id", "fingerprint"), "digests")
    sizes = staged(known.groupBy("fingerprint").agg(F.count("*").alias("_n"), F.min("doc_id").alias("group_id")), "sizes")
    shared = sizes.where("_n > 1").select(F.col("fingerprint").alias("_shared"))
    # bytes are compared where a fingerprint occurs more than once: grouped by fingerprint and the text itself
    ids = staged(known.join(shared, known.fingerprint == F.col("_shared"), "left_semi").select(F.col("doc_id").alias("_id")).distinct(), "shared")
    if ids.count() <= BROADCAST_ROWS:
        again = texts.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    else:  # dealing all texts to pick some costs as much as grouping them all
        again = texts
    again = again.withColumn("_composed", composed("text")).select("doc_id", folded(F.col("_composed")).alias("canonical"))
    again = again.withColumn("fingerprint", wide_hash(F.col("canonical")))
    classes = staged(again.groupBy("fingerprint", F.sha2("canonical", 256).alias("bytes"), "canonical").agg(F.min("doc_id").alias("least")).drop("canonical"), "classes")
    clashes = classes.groupBy("fingerprint").agg(F.count("*").alias("texts")).where("texts > 1").select("fingerprint")
    found = join_classes(known, sizes, ["fingerprint"], known.count())
    if clashes.isEmpty():
        return found
    apart = again.join(F.broadcast(clashes), "fingerprint").select("doc_id", "fingerprint", F.sha2("canonical", 256).alias("bytes"))
    apart = apart.join(classes, ["fingerprint", "bytes"]).select(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_fp"), "least").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("fingerprint") == F.col("_fp"))
    return found.join(apart, same, "left").withColumn("group_id", F.coalesce("least", "group_id")).drop("_id", "_fp", "least")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint, copies), each document beside the one after it.

    Documents are dealt into ranges of doc_id; the first document of a range also stands at the end of the range
    before it (at most one for each range), so no window spans more than a range. Where one doc_id, or none, is on a
    range's worth of rows, equal rows are one row until the end; copies: rows that this one stands for.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("_hash", F.xxhash64("text"))
    tie = (F.shiftright("_hash", 44) + (1 << 19)) / (1 << 20)
    bucket, special = range_bucket(texts, "doc_id", bucket_count(docs.sparkSession), tie)
    if special is None:
        texts = texts.withColumn("copies", F.lit(1).cast("long"))
    else:
        crowd = texts.where(special).groupBy("doc_id", "text", "_hash").agg(F.count("*").alias("copies"))
        texts = texts.where(~special).withColumn("copies", F.lit(1).cast("long")).unionByName(crowd)
    texts = texts.withColumn("bucket", bucket)
    # the heads of at most 2 * bucket_count() + 1 ranges: a bounded table
    ids = texts.select("bucket", F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.col("_hash").alias("_h")).alias("head"))
    heads = ids.groupBy("bucket").agg(F.max("head").alias("head"))
    every = Window.partitionBy(F.lit(0)).orderBy("bucket")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("bucket", "head", F.coalesce(F.lead("bucket").over(every), F.first("bucket").over(whole)).alias("_to"))
    heads = heads.select("_to", F.col("bucket").alias("_from"), F.col("head._id").alias("_id"), F.col("head._h").alias("_h"))
    mine = (F.col("bucket") == F.col("_from")) & (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("_id")) & (F.col("_hash") == F.col("_h"))
    ghosts = texts.join(F.broadcast(heads), mine).dropDuplicates(["_from"])
    ghosts = ghosts.select("doc_id", "text", F.col("_to").alias("bucket"), "_hash", "copies", F.lit(1).alias("_ghost"))
    lined = with_fingerprint(texts.withColumn("_ghost", F.lit(0)).unionByName(ghosts), "text", "fingerprint")
    after = Window.partitionBy("bucket").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), F.col("_hash").desc(), "text")
    beside = [F.lead(c).over(after).alias(f"next_{c}") for c in ("text", "fingerprint")]
    lined = lined.select("doc_id", "text", "fingerprint", "copies", "_ghost", *beside).where("_ghost = 0").drop("_ghost")
    if special is None:
        return lined
    # of equal rows the last one has the next text, and the others have their own
    own = lined.where("copies > 1").withColumn("next_text", F.col("text")).withColumn("next_fingerprint", F.col("fingerprint")).withColumn("copies", F.col("copies") - 1)
    return lined.withColumn("copies", F.lit(1).cast("long")).unionByName(own)


def op10(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts; an exact digest is alike (1) or not (0)."""
    beside = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("_third", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("_third")), F.substring("next_text", F.lit(1), F.col("_third")))
    beside = with_fingerprint(beside.withColumn("edited", edited), "edited", "edited_fingerprint")
    same = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    rows = beside.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"), "copies",
    )
    rows = staged(rows, "digests")
    if rows.where("copies > 1").isEmpty():
        rows = rows.drop("copies")
    else:  # written in lots, so that one task does not write all copies
        lots = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))
        rows = rows.withColumn("_lot", F.explode(lots)).repartition("_lot", "fingerprint", "edited_sha256", "doc_id")
        rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("_lot") * COPIES)))).drop("_lot", "_copy", "copies")
    return groups(docs, rows)
