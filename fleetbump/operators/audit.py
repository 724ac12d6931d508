"""Request-log audit: trailing-minute rates, gaps and bursts.

All of it is computed inside (key, time bucket) chunks. Each chunk also sees the last minute of the
one before it and the time of the last earlier request, so results equal those over the whole key
while even a key that makes most requests is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_US = 60_000_000


def _bucketed(log: DataFrame, bucket_seconds: int) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return log.withColumn("_us", us).withColumn("_bucket", F.floor(F.col("_us") / (bucket_seconds * 1_000_000)))


def _last_before(rows: DataFrame) -> DataFrame:
    """Per (key, bucket): time of the key's last request in an earlier bucket."""
    ends = rows.groupBy("key", "_bucket").agg(F.max("_us").alias("_end"))
    earlier = Window.partitionBy("key").orderBy("_bucket")
    return ends.select("key", "_bucket", F.lag("_end").over(earlier).alias("_carry"))


def request_rates(
    log: DataFrame, per_minute: int = 600, bucket_seconds: int = 3600, threshold: float = 0.9
) -> DataFrame:
    """Per request: earlier requests of its key in the trailing 60 s, whether they reach the threshold of
    the quota and for how many seconds, the gap to the previous request, and whether it is too short."""
    rows = _bucketed(log, bucket_seconds)
    width = bucket_seconds * 1_000_000
    # A request is also shown to the next bucket when it lies in the last minute of its own.
    reach = F.floor((F.col("_us") + WINDOW_US - 1) / width)
    shown = rows.withColumn("_at", F.explode(F.sequence("_bucket", reach)))
    by_time = Window.partitionBy("key", "_at").orderBy("_us")
    by_row = Window.partitionBy("key", "_at").orderBy("_us", "request_id")
    expired = F.count(F.lit(1)).over(by_time.rangeBetween(Window.unboundedPreceding, -WINDOW_US))
    numbered = (
        shown.withColumn("_number", F.row_number().over(by_row))
        .withColumn("_expired", F.coalesce(expired, F.lit(0)))
        .withColumn("_previous", F.lag("_us").over(by_row))
    )
    # The oldest request still in the minute is the one after those that have left it. Every request also asks at
    # that place; times do not fall along the places, so a running maximum answers. Cost is that of two more rows,
    # however many requests a minute holds, and the rows stay where the first windows left them.
    place = F.struct(F.col("_number").alias("at"), F.col("_us").alias("us"))
    asked = F.struct((F.col("_expired") + 1).alias("at"), F.lit(None).cast("long").alias("us"))
    own = F.col("_at") == F.col("_bucket")
    both = numbered.withColumn("_p", F.explode(F.when(own, F.array(place, asked)).otherwise(F.array(place))))
    running = Window.partitionBy("key", "_at").orderBy("_p.at", F.col("_p.us").isNull())
    measured = (
        both.withColumn("_oldest", F.max("_p.us").over(running.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("_p.us").isNull())
        .withColumn("_seen", F.col("_number") - 1)
    )
    # Joined on the columns the windows are partitioned by, so the requests are not shuffled again.
    carried = measured.join(_last_before(rows).withColumnRenamed("_bucket", "_at"), ["key", "_at"])
    previous = F.coalesce("_previous", "_carry")
    trailing = F.col("_seen") - F.col("_expired")
    limit = per_minute * threshold
    min_gap = 60.0 / per_minute if per_minute > 0 else 0.1
    gap_us = F.col("_us") - previous
    throttled = trailing >= limit
    return carried.select(
        "request_id",
        "key",
        "ts",
        trailing.alias("trailing_requests"),
        throttled.alias("throttled"),
        F.when(throttled & (trailing > 0), (F.lit(WINDOW_US) - (F.col("_us") - F.col("_oldest")))).alias("wait_us"),
        gap_us.alias("gap_us"),
        F.coalesce(gap_us < int(min_gap * 1_000_000), F.lit(False)).alias("below_min_gap"),
    )


def burst_runs(
    log: DataFrame, burst_limit: int = 10, gap_seconds: float = 1.0, bucket_seconds: int = 3600
) -> DataFrame:
    """Runs of requests less than ``gap_seconds`` apart: per (key, run) size, ends, bursts reached.

    A burst counts each time ``burst_limit`` requests followed the first of the run or the last burst.
    """
    rows = _bucketed(log, bucket_seconds)
    by_row = Window.partitionBy("key", "_bucket").orderBy("_us", "request_id")
    gap_us = int(gap_seconds * 1_000_000)
    # Runs of a bucket by itself, the first one being 0; whether that one goes on from before is seen below.
    apart = F.coalesce(F.col("_us") - F.lag("_us").over(by_row) >= gap_us, F.lit(False)).cast("int")
    local = rows.withColumn("_apart", apart).withColumn(
        "_run", F.sum("_apart").over(by_row.rowsBetween(Window.unboundedPreceding, 0))
    )
    pieces = local.groupBy("key", "_bucket", "_run").agg(
        F.count(F.lit(1)).alias("requests"), F.min("_us").alias("first_us"), F.max("_us").alias("last_us")
    )
    # One row per bucket: its ends and how many runs begin in it.
    ends = pieces.groupBy("key", "_bucket").agg(
        F.min("first_us").alias("_first"), F.max("last_us").alias("_last"), F.max("_run").alias("_more")
    )
    in_order = Window.partitionBy("key").orderBy("_bucket")
    begins = F.coalesce(F.col("_first") - F.lag("_last").over(in_order) >= gap_us, F.lit(True)).cast("int")
    earlier = F.coalesce(F.sum(F.col("_begins") + F.col("_more")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ends.withColumn("_begins", begins).select("key", "_bucket", (earlier + F.col("_begins")).alias("_offset"))
    return (
        pieces.join(offsets, ["key", "_bucket"])
        .groupBy("key", (F.col("_run") + F.col("_offset")).alias("run"))
        .agg(F.sum("requests").alias("requests"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
        .withColumn("bursts", F.floor((F.col("requests") - 1) / burst_limit))
    )


def retry_log(log: DataFrame, base: float = 1.0, cap: float = 300.0) -> DataFrame:
    from fleetbump.functions.patterns import request_outcome, retry_delay

    outcome = request_outcome(F.col("status_code"))
    return log.withColumn("outcome", outcome).withColumn(
        "delay_seconds",
        F.when(outcome == "rate_limited", retry_delay(F.col("retry_after"), F.col("attempt"), base, cap)).when(
            outcome == "retryable", retry_delay(F.lit(None).cast("string"), F.col("attempt"), base, cap)
        ),
    )
