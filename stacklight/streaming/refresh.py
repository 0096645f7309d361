"""The maintenance rules over unbounded input: Structured Streaming from a mutation log.

Late rows are bounded by a watermark; state that outlives a batch is either Spark's own (windows, keyed state) or a table
written once per batch under the batch's number, so a batch that runs twice writes the same state twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stacklight.operators import maintenance as M


def mutation_log(spark: SparkSession, path: str, schema, at: str, late: str = "1 hour", files_per_batch: int = 16) -> DataFrame:
    """The log as a stream with a watermark on ``at``."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return s.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def _versions(spark: SparkSession, path: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName()[1:]) for f in fs.listStatus(p) if f.getPath().getName().startswith("v")) if fs.exists(p) else []


def latest(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    found = [v for v in _versions(spark, path) if below is None or v < below]
    return spark.read.parquet(f"{path}/v{found[-1]}") if found else None


def coalesce_stream(stream: DataFrame, keys: list[str], operation: str, at: str, seq: str, state: str, checkpoint: str) -> None:
    """Folds the log into the queue: one entry per key, a delete beats a refresh. Runs until the log is read."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keys, F.col(operation).alias("operation"), F.col(at).alias("at"), F.col(seq).alias("seq"))
        old = latest(spark, state, number)
        if old is not None:
            rows = rows.unionByName(old)
        best = F.max(F.struct((F.col("operation") == "delete").alias("d"), "at", "seq", "operation")).alias("m")
        rows.groupBy(*keys).agg(best).select(*keys, F.col("m.operation").alias("operation"), F.col("m.at").alias("at"), F.col("m.seq").alias("seq")).write.mode("overwrite").parquet(f"{state}/v{number}")

    q = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def rate_stream(stream: DataFrame, key: str, at: str, tokens: str, window: str = "60 seconds") -> DataFrame:
    """Requests and tokens of each key and window; windows close as the watermark passes them."""
    return stream.groupBy(F.window(at, window), key).agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens"))


def session_stream(stream: DataFrame, key: str, at: str, gap: str = "15 minutes") -> DataFrame:
    """Uses of a page between gaps."""
    return stream.groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("uses"))


def retry_stream(stream: DataFrame, key: str, failed: str) -> DataFrame:
    """(key, attempts, state): keyed state counts the failures in a row; a success clears it and the bound drops the key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        last = "done"
        for pdf in batches:
            for f in pdf.sort_values("seq")[failed]:
                n = n + 1 if f else 0
                last = "done" if not f else "dropped" if n >= M.REFRESH_ATTEMPTS else "retry"
                if last == "dropped":
                    n = 0
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "attempts": [n], "state": [last]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, attempts int, state string", "attempts int", "update", GroupStateTimeout.NoTimeout)
