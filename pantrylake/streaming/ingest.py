"""Structured Streaming: exactly-once folder ingestion, rolling state, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, folder: str, glob: str, schema: StructType) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def ingest_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append all files not seen before, then stop; the checkpoint makes a second run a no-op."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ledger_stream(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, sha256, size, at, content): new files of a folder with the hash of their content."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("at"), "content")


def ingest_once(stream: DataFrame, target: str, ledger: str, checkpoint: str) -> None:
    """Append files whose content was never taken before, whatever their name: a ledger of hashes beside the checkpoint.

    A batch that is run again finds its own number in the ledger, and takes the same files anew (both writes replace
    the batch's folder), so each content is there once.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
        there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        new = batch.dropDuplicates(["sha256"])
        if there:
            new = new.join(spark.read.parquet(ledger).where(F.col("batch") != number).select("sha256"), "sha256", "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")
        spark.read.parquet(f"{target}/batch={number}").select("path", "sha256", "size", "at").write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_available(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: str, buckets: int = 16, frozen: str | None = None) -> None:
    """Keep the newest row of each key in `target`; a repeated batch changes nothing.

    Rows lie in buckets of their keys, and a batch rewrites only the buckets that it touches: the new bucket is written
    beside the old one, then takes its place. frozen: a flag of rows that later rows never replace (late data included:
    there is no bound on lateness).
    """
    from ..operators.relational import latest_per_key
    from ..operators.staging import shared_dir

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most `buckets`
        if not touched:
            return
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        first = [F.coalesce(F.col(frozen), F.lit(False)).desc()] if frozen else []
        if there:
            rows = spark.read.schema(rows.schema).parquet(target).where(F.col("bucket").isin(touched)).unionByName(rows)
        staging = f"{shared_dir(spark)}/upsert-{number}"
        latest_per_key(rows, keys, [*first, F.desc(order)]).write.mode("overwrite").parquet(staging)
        spark.read.schema(rows.schema).parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def derive_available(stream: DataFrame, target: str, checkpoint: str, derive, keys: list[str]) -> None:
    """Rows derived from changed ones, each key once: what a batch derives again is not written again.

    derive: a function from the batch to rows with `keys`.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = derive(batch).dropDuplicates(keys)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            rows = rows.join(spark.read.parquet(target).where(F.col("batch") != number).select(*keys).distinct(), keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def into_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is available of a stream, written to Parquet (append) or by whole batches (complete, update)."""
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return
    stream.writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def joined_within(left: DataFrame, right: DataFrame, on: list[str], at: str, other_at: str, late: str, within: str) -> DataFrame:
    """Stream with stream: right rows of a left row's key from its time to `within` after it."""
    a, b = left.withWatermark(at, late).alias("a"), right.withWatermark(other_at, late).alias("b")
    same = F.expr(" AND ".join(f"a.{k} = b.{k}" for k in on))
    return a.join(b, same & F.expr(f"b.{other_at} >= a.{at} AND b.{other_at} <= a.{at} + interval {within}"))


def windowed_counts(stream: DataFrame, at: str, late: str, width: str, slide: str | None, keys: list[str]) -> DataFrame:
    """Counts by event-time window and keys, with a watermark."""
    frame = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(frame.alias("window"), *keys).agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def session_counts(stream: DataFrame, at: str, late: str, gap: str, keys: list[str]) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("session"), *keys).agg(F.count("*").alias("n"))
