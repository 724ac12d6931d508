"""Streaming forms of the status refresh and the request audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def request_rates(requests: DataFrame, slide: str | None = None, late: str = "2 minutes") -> DataFrame:
    """Requests per key in 60-second windows, tumbling or sliding; later rows than ``late`` are dropped."""
    span = F.window("ts", "60 seconds", slide) if slide else F.window("ts", "60 seconds")
    return (
        requests.withWatermark("ts", late)
        .groupBy("key", span.alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select("key", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests")
    )


def burst_sessions(requests: DataFrame, gap: str = "1 second", late: str = "2 minutes") -> DataFrame:
    """Sessions of requests less than ``gap`` apart, per key."""
    return (
        requests.withWatermark("ts", late)
        .groupBy("key", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select("key", "first_ts", "last_ts", "requests")
    )


def distinct_hits(hits: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Search hits with repeats of (repo_id, path) inside the watermark suppressed."""
    return hits.withWatermark("ts", late).dropDuplicatesWithinWatermark(["repo_id", "path"])


STATE = "repository_id string, iid string, state string, seen_at timestamp, ord bigint, old_status string"


def track_states(
    spark: SparkSession,
    updates: DataFrame,
    folder: str,
    checkpoint: str,
    compact_every: int = 20,
    available_now: bool = True,
) -> StreamingQuery:
    """Keep the newest state per (repository_id, iid) and log its transitions.

    Micro-batch N writes ``folder/batch=N`` with the requests it changed (and, every ``compact_every``
    batches, all others too), each with the status it had before. A batch only reads tables of earlier
    batches, so running one again after a lost executor or driver gives the same table.
    """

    def one_batch(batch: DataFrame, n: int) -> None:
        advance(spark, batch, folder, n, compact_every)

    writer = updates.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _batches(spark: SparkSession, folder: str, before: int, compact_every: int) -> DataFrame:
    """Tables from the last compacted batch up to, not including, ``before``."""
    if before <= 0:
        return spark.createDataFrame([], STATE)
    first = (before - 1) // compact_every * compact_every
    return spark.read.schema(STATE).parquet(*[f"{folder}/batch={i}" for i in range(first, before)])


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repository_id", "iid").agg(
        F.max_by(F.struct("state", "seen_at", "ord"), F.struct("seen_at", "ord")).alias("_row")
    )


def advance(spark: SparkSession, batch: DataFrame, folder: str, n: int, compact_every: int = 20) -> None:
    newest = _newest(batch).withColumnRenamed("_row", "_new")
    old = _newest(_batches(spark, folder, n, compact_every)).withColumnRenamed("_row", "_old")
    merged = newest.join(old, ["repository_id", "iid"], "full" if n % compact_every == 0 else "left")
    later = F.struct("_new.seen_at", "_new.ord") > F.struct("_old.seen_at", "_old.ord")
    takes = F.col("_new").isNotNull() & (F.col("_old").isNull() | later)
    kept = merged.withColumn("_now", F.when(takes, F.col("_new")).otherwise(F.col("_old")))
    old_status = F.coalesce("_old.state", F.lit("unknown"))
    kept.select(
        "repository_id", "iid", "_now.*", old_status.alias("old_status"), F.col("_new").isNotNull().alias("touched")
    ).write.mode("overwrite").parquet(f"{folder}/batch={n}")


def transitions(spark: SparkSession, folder: str) -> DataFrame:
    """All changes logged so far: (batch, repository_id, iid, old_status, new_status)."""
    log = spark.read.schema(STATE + ", batch int").parquet(folder)
    new = F.coalesce("state", F.lit("unknown"))
    return log.filter(F.col("old_status") != new).select("batch", "repository_id", "iid", "old_status", new.alias("new_status"))


def transition_counters(spark: SparkSession, folder: str) -> DataFrame:
    """What each batch did: (batch, requests, updated, errors, opened, merged, closed).

    ``requests`` had news, ``updated`` changed their status, ``errors`` had no status in their newest news. The last three
    count all requests known after the batch; they are running sums over one row per batch.
    """
    log = spark.read.schema(STATE + ", touched boolean, batch int").parquet(folder)
    new = F.coalesce("state", F.lit("unknown"))

    def net(status: str) -> Column:
        return F.count_if(new == status) - F.count_if(F.col("old_status") == status)

    statuses = ("opened", "merged", "closed")
    each = log.filter("touched").groupBy("batch").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("old_status") != new).alias("updated"),
        F.count_if(F.col("state").isNull()).alias("errors"),
        *[net(status).alias(status) for status in statuses],
    )
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumns({status: F.sum(status).over(so_far) for status in statuses})


def current_states(spark: SparkSession, folder: str, last_batch: int, compact_every: int = 20) -> DataFrame:
    rows = _newest(_batches(spark, folder, last_batch + 1, compact_every))
    return rows.select("repository_id", "iid", "_row.*")


def last_batch(query: StreamingQuery) -> int:
    """Number of the last micro-batch of a finished query, -1 where there was none."""
    progress = query.lastProgress
    return progress["batchId"] if progress else -1
