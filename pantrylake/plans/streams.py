"""Streams run to the end of what is there; their results equal the batch form."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..operators.relational import top_k
from ..streaming import ingest
from .base import query


def _shared(spark) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    import uuid

    return f"{found}/stream-{uuid.uuid4().hex}" if found else "file://" + tempfile.mkdtemp(prefix="stream-")


@query("STM_01_available_now", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    folder = _shared(t.spark)
    stream = ingest.file_stream(t.spark, t.sf_dir, "events*.parquet", t.events.schema)
    ingest.ingest_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("STM_04_rolling_state", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events WHERE event_type = 'click') SELECT user_id, count(*) AS n, round(avg(value), 6) AS rate FROM r WHERE rn <= 10 GROUP BY 1")
def _(t):
    folder = _shared(t.spark)
    stream = ingest.file_stream(t.spark, t.sf_dir, "events*.parquet", t.events.schema).where("event_type = 'click'")

    def keep_last(batch, number):
        old = t.spark.read.schema(batch.schema).parquet(f"{folder}/s{number - 1}") if number else batch.limit(0)
        top_k(old.unionByName(batch), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).drop("rank").write.mode("overwrite").parquet(f"{folder}/s{number}")
        last["batch"] = number

    last = {"batch": 0}
    stream.writeStream.foreachBatch(keep_last).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/s{last['batch']}").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("rate"))


@query("STM_06_tumbling_windows", "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    hour = F.window(F.col("ts").cast("timestamp"), "1 hour")["start"]
    return t.events.groupBy(F.date_format(hour, "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type").agg(F.count("*").alias("n"))
