"""The streams run over the event log until it is read, and the tables they leave."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stacklight.plans import maintenance as B
from stacklight.session import checkpoint_dir
from stacklight.sources.tables import table
from stacklight.streaming import refresh as R


def _log(spark, d):
    batch = table(spark, d, "events")  # its schema only; the pattern below reads a single file as well as a folder
    s = R.mutation_log(spark, f"{d}/event[s].parquet", batch.schema, "ts")
    return s.withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("refresh"))


def _place(spark):
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_refresh(spark, d):
    """The queue that the stream leaves: the same as the batch query's."""
    p = _place(spark)
    R.coalesce_stream(_log(spark, d), ["user_id"], "op", "ts", "event_id", f"{p}/state", f"{p}/log")
    return R.latest(spark, f"{p}/state").select("user_id", "operation", F.unix_micros("at").alias("queued_at"))


def stream_rate(spark, d):
    """Requests by user and hour; written in full by the last batch."""
    p = _place(spark)

    def write(batch, number):
        batch.select("user_id", F.unix_micros("window.start").alias("start"), "requests", F.round("tokens", 4).alias("tokens")).write.mode("overwrite").parquet(f"{p}/out/v{number}")

    q = R.rate_stream(_log(spark, d), "user_id", "ts", "value", "1 hour").writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{p}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return R.latest(spark, f"{p}/out")


def stream_sessions(spark, d):
    """Sessions of each user's events, parted by gaps of fifteen minutes."""
    p = _place(spark)

    def write(batch, number):
        batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("uses").alias("most")).write.mode("overwrite").parquet(f"{p}/out/v{number}")

    q = R.session_stream(_log(spark, d), "user_id", "ts").writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{p}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return R.latest(spark, f"{p}/out")


QUERIES = [stream_refresh, stream_rate, stream_sessions]
SQL = {
    "stream_refresh": B.SQL["refresh_coalesce"],
    "stream_rate": "SELECT user_id, epoch_us(date_trunc('hour', ts)) AS start, count(*) AS requests, round(sum(value), 4) AS tokens FROM events GROUP BY user_id, date_trunc('hour', ts)",
    "stream_sessions": """WITH e AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 900000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e),
g AS (SELECT user_id, s, count(*) AS uses FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(uses) AS most FROM g GROUP BY 1""",
}
