"""Shared pieces of the corpus operators: tables, staging, ordering and prefix sums."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's readers only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without it."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if not found:
        found = context.getCheckpointDir()
        if found is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = "file://" + tempfile.mkdtemp(prefix="pantrylake-")
            context.setCheckpointDir(found)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/pantrylake-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage ends there and lost executors cost nothing."""
    return staged_at(df, name)[0]


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As staged, with the path, for a caller that drops the table once nothing reads it any more."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES, BATCH_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """mapInArrow with batches bounded by bytes: a batch lies in the JVM's direct buffers, more than once while they
    grow, and again in the worker, and Spark's own bound of 64 MB holds whole partitions of texts.

    Spark reads the bound when the frame runs, so it stays set in the session; one that the caller has set is kept.
    """
    if df.sparkSession.conf.get(BATCH_KEY, None) is None:
        df.sparkSession.conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Rows of a table that may be broadcast: beyond it joins are by shuffle.
BROADCAST_ROWS = 1_000_000
#: A key is hot when it holds more than this share of all rows, so at most as many keys are hot as its inverse.
HOT_SHARE, HOT_LEAST = 1 / 50_000, 512


def checked_broadcast(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table marked for broadcast if its row count (counted here) is within the bound; else as it is."""
    return F.broadcast(small) if small.count() <= most else small


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], total: int, how: str = "left") -> DataFrame:
    """rows joined with a table of one row for each value of `keys` that states in `_n` how many of `rows` have it.

    Values with many rows are dealt over several tasks: their rows get a salt, and the class is repeated for each.
    At most 1 / HOT_SHARE values can be hot, so the table that says which are is broadcast.
    """
    heavy = max(HOT_LEAST, int(total * HOT_SHARE))
    parts = F.ceil(F.col("_n") / heavy).cast("int")
    hot = classes.where(F.col("_n") > heavy).select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], parts.alias("_parts"))
    same = [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)]
    salt = F.when(F.col("_parts").isNull(), 0).otherwise(F.floor(F.rand(11) * F.col("_parts"))).cast("int")
    dealt = rows.join(F.broadcast(hot), same, "left").withColumn("_salt", salt).drop("_parts", *[f"_h{i}" for i in range(len(keys))])
    dealt_classes = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_n") > heavy, parts).otherwise(1) - 1))).drop("_n")
    for i, k in enumerate(keys):
        dealt_classes = dealt_classes.withColumnRenamed(k, f"_k{i}")
    dealt_classes = dealt_classes.withColumnRenamed("_salt", "_ks")
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col("_salt") == F.col("_ks")]
    return dealt.join(dealt_classes, on, how).drop("_salt", "_ks", *[f"_k{i}" for i in range(len(keys))])


def hash_sample(df: DataFrame, n: int, total: int, *by: str) -> DataFrame:
    """About 4 * n of `total` rows, those whose hash of `by` is low: what a sort and limit(n) then reads does not grow with the table."""
    if total <= 4 * n:
        return df
    cut = int((1 << 63) * min(1.0, 4 * n / total))
    return df.where(F.shiftrightunsigned(F.xxhash64(*by), 1) < cut)


#: Room for the sub-buckets of one hot key.
TIES = 1 << 20


def range_bucket(df: DataFrame, key: str, buckets: int, tie: Column) -> tuple[Column, Column | None]:
    """Ascending bucket number of a long key, nulls first, from at most `buckets` approximate quantiles.

    A key that holds a bucket's worth of rows or more, or no key, is split further by `tie`, a fraction from 0 to below
    1 by which rows of one key are ordered, into as many buckets as its share. The second column tells such rows (None
    if there are none). At most 2 * buckets + 1 buckets come about; only their boundaries reach the driver, and how even
    they are affects speed, never results.
    """
    wanted = [i / buckets for i in range(1, buckets)]
    found = [int(x) for x in df.select(key).stat.approxQuantile(key, wanted, 0.2 / buckets)] if wanted else []
    rows, keyed = df.agg(F.count("*"), F.count(key)).first()
    times = Counter(found)
    edges, hot = sorted(times), {k: n + 1 for k, n in times.items() if n > 1}
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    plain = F.lit(0)
    if edges:
        # two levels: which run of edges, then which edge of the run, so that many ranges cost few comparisons
        run = max(1, math.isqrt(len(edges)))
        runs = [edges[i : i + run] for i in range(0, len(edges), run)]
        below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col(key)))
        nth = below(longs([r[0] for r in runs]))
        inside = F.coalesce(F.get(F.array(*[longs(r) for r in runs]), nth - 1), F.array().cast("array<long>"))
        plain = F.greatest(nth - 1, F.lit(0)) * run + below(inside)
    # in each range a hot key comes first, in sub-buckets of its own, and all other keys share the bucket after those
    null, first = F.col(key).isNull(), (plain + 1).cast("long") * 2 * TIES
    many_nulls = max(1, math.ceil(buckets * (rows - keyed) / max(1, rows)))
    bucket = F.when(null, F.floor(tie * many_nulls))
    if hot:
        shares = F.create_map(*[F.lit(x).cast("long") for kv in hot.items() for x in kv])
        bucket = bucket.when(F.map_contains_key(shares, F.col(key)), first + F.floor(tie * F.element_at(shares, F.col(key))))
    special = (null | F.array_contains(longs(sorted(hot)), F.col(key)) if hot else null) if hot or keyed < rows else None
    return bucket.otherwise(first + TIES).cast("long"), special


def bucket_count(spark: SparkSession) -> int:
    """Range buckets for an ordered pass: a few for each shuffle partition, and a bounded number."""
    return max(8, min(8192, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def running_start(df: DataFrame, bucket: str, order: list[Column], size: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """Add `name`: the sum of `size` over the rows before this one (of the same `by`) in bucket, then `order`.

    Two levels, so that no window spans all rows: within a bucket, and over the buckets' sums.
    """
    by = by or []
    keyed = df.withColumn("_size", size.cast("long"))
    sums = keyed.groupBy(*by, bucket).agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("_within", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    return keyed.join(sums, [*by, bucket]).withColumn(name, F.col("_before") + F.col("_within")).drop("_size", "_before", "_within")
