"""Incremental maintenance: coalescing, retries, change detection, rate windows, index replacement, statistics.

The transition rules are expressions over rows, shared by the batch queries and the streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Retry delays and bounds in seconds.
DELETE_BASE, DELETE_CAP, REFRESH_ATTEMPTS = 60, 600, 8
EMBED_DELAYS, EMBED_ATTEMPTS = (0, 30, 120, 600, 1800, 7200), 6
SCAN_CEILING = 3600


def coalesced(mutations: DataFrame, keys: list[str], operation: str, at: str, seq: str) -> DataFrame:
    """(keys, operation, at): one entry per key. A delete beats any refresh; of several the latest counts. Partial
    maxima run before the shuffle, so a hot key moves one row per task."""
    best = F.max(F.struct((F.col(operation) == "delete").alias("d"), F.col(at).alias("at"), F.col(seq).alias("seq"), F.col(operation).alias("op"))).alias("m")
    return mutations.groupBy(*keys).agg(best).select(*keys, F.col("m.op").alias("operation"), F.col("m.at").alias("at"))


def delete_delay(attempts: Column) -> Column:
    """Seconds until the next try of a delete: doubled each time, capped."""
    return F.least(F.lit(DELETE_BASE) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(DELETE_CAP)).cast("long")


def embed_delay(attempts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in EMBED_DELAYS]), F.least(attempts + 1, F.lit(len(EMBED_DELAYS))))


def drained(queue: DataFrame, failed: Column, now: Column) -> DataFrame:
    """queue(operation, attempts, ...) after one drain -> state (done, retry, dropped), attempts, next_at in seconds."""
    n = F.col("attempts") + F.when(failed, 1).otherwise(0)
    gone = (F.col("operation") != "delete") & (n >= REFRESH_ATTEMPTS)
    state = F.when(~failed, "done").when(gone, "dropped").otherwise("retry")
    return queue.select(*[c for c in queue.columns if c != "attempts"], n.alias("attempts"), state.alias("state"), F.when(state == "retry", now + delete_delay(n)).alias("next_at"))


def due(queue: DataFrame, now: Column, limit: int) -> DataFrame:
    """Entries whose time has come and that have tries left, the earliest first."""
    return queue.filter((F.col("next_at") <= now) & (F.col("attempts") < EMBED_ATTEMPTS)).orderBy("next_at", "key").limit(limit)


def change(status: dict[str, Column]) -> Column:
    """Why a document is indexed anew: new, version, modified, content, rules or space; null where nothing changed."""
    return (
        F.when(status["indexed_at"].isNull(), "new").when(status["version"] < 2, "version").when(status["modified"] > status["indexed_at"], "modified")
        .when(~status["hash"].eqNullSafe(status["indexed_hash"]), "content").when(~status["rules"].eqNullSafe(status["indexed_rules"]), "rules")
        .when(~status["space"].eqNullSafe(status["indexed_space"]), "space")
    )


def rate_window(requests: DataFrame, key: str, at: str, tokens: str, seconds: int = 60) -> DataFrame:
    """Requests and tokens of the last ``seconds``, the row included; a request exactly that old is out."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(at)).rangeBetween(-(seconds * 1_000_000 - 1), Window.currentRow)
    return requests.withColumn("requests", F.count(F.lit(1)).over(w)).withColumn("tokens", F.sum(tokens).over(w))


def index_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What replacing an index does to each key: insert, update, delete or keep."""
    o, n = old.select(*keys, F.col(value).alias("o")), new.select(*keys, F.col(value).alias("n"))
    act = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(F.col("o") != F.col("n"), "update").otherwise("keep")
    return o.join(n, keys, "full_outer").select(*keys, act.alias("action"))


def replace_index(new: DataFrame, path: str, partition: str) -> None:
    """Rewrites only the partitions that ``new`` holds."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def assert_complete(rows: DataFrame, expected: int) -> DataFrame:
    """The rows, or an error where fewer came than were listed: an empty listing never passes as an empty library."""
    n = rows.count()
    if n < expected:
        raise ValueError(f"{n} of {expected} items could be listed")
    return rows


def circuit(failures: Column, opened_for: Column) -> Column:
    """State of a branch: open after three failures until its time is over, then half-open, else closed."""
    return F.when(failures < 3, "closed").when(opened_for < F.least(F.lit(60) * F.pow(F.lit(2.0), failures - 3), F.lit(600)), "open").otherwise("half-open")


def timing(rows: DataFrame, ms: str) -> DataFrame:
    """min, mean, max, and the time to allow: ceil(max(2 max, max + 3 (max - mean), 3000))."""
    g = rows.agg(F.round(F.min(ms), 6).alias("low"), F.round(F.avg(ms), 6).alias("mean"), F.round(F.max(ms), 6).alias("high"))
    return g.withColumn("allow", F.ceil(F.greatest(2 * F.col("high"), F.col("high") + 3 * (F.col("high") - F.col("mean")), F.lit(3000.0))).cast("long"))


def scan_budget(base: float, queries: int, gpu: bool = False) -> float:
    a, b = (0.5, 1.1) if gpu else (0.8, 0.35)
    return min(base * (a + b * queries), SCAN_CEILING)


def next_batch(low: int, high: int | None, tolerance: float = 0.1) -> int:
    """The size to try between the largest that worked and the smallest that failed; the former once they are near."""
    if high is None:
        return low * 2
    return low if high - low <= max(1000, tolerance * low) else (low + high) // 2


def attachment(rows: DataFrame, keys: list[str], wanted: str | None = None) -> DataFrame:
    """rows(keys, attachment, readable, generated) -> the asked attachment, else the only readable one that isn't generated,
    else the number of candidates."""
    ok = F.col("attachment") == wanted if wanted else F.col("readable") & ~F.col("generated")
    g = rows.groupBy(*keys).agg(F.count_if(ok).alias("candidates"), F.min(F.when(ok, F.col("attachment"))).alias("first"))
    return g.select(*keys, "candidates", F.when(F.col("candidates") == 1, F.col("first")).alias("attachment"))
