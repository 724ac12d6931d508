"""Merge-request tracking: refresh, counters, filters, dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbump.functions.patterns import BUCKETS, status_bucket


def _url() -> Column:
    return F.coalesce("merge_request_url", F.lit(""))


def _status() -> Column:
    return F.coalesce("status", F.lit(""))


def canonical_order(tracked: DataFrame) -> DataFrame:
    """By address, then status; missing ones sort as empty text."""
    return tracked.orderBy(_url(), _status())


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Newest state per (repository_id, iid); combined before the shuffle."""
    return snapshots.groupBy("repository_id", "iid").agg(F.max_by("state", F.struct("seen_at", "ord")).alias("state"))


def can_refresh(tracked: DataFrame) -> Column:
    def given(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) != ""

    return given("merge_request_iid") & given("repository_id")


def refresh(tracked: DataFrame, latest: DataFrame, now: Column) -> DataFrame:
    """Tracking rows with their newest state.

    ``refresh_outcome``: updated / unchanged / error (no state found, old one kept) / insufficient (no
    repository or request id; neither an update nor an error). ``latest`` has one row per request.
    """
    eligible = can_refresh(tracked)
    snap = latest.select(
        F.col("repository_id").alias("_repo"), F.col("iid").alias("_iid"), F.nullif(F.col("state"), F.lit("")).alias("_new")
    )
    joined = tracked.join(
        snap,
        (F.col("repository_id") == F.col("_repo")) & (F.col("merge_request_iid") == F.col("_iid")),
        "left",
    )
    found = eligible & F.col("_new").isNotNull()
    outcome = (
        F.when(~eligible, F.lit("insufficient"))
        .when(F.col("_new").isNull(), F.lit("error"))
        .when(F.coalesce("status", F.lit("unknown")) != F.col("_new"), F.lit("updated"))
        .otherwise(F.lit("unchanged"))
    )
    return (
        joined.withColumn("refresh_outcome", outcome)
        .withColumn("old_status", F.coalesce("status", F.lit("unknown")))
        .withColumn("status", F.when(found, F.col("_new")).otherwise(F.col("status")))
        .withColumn("last_checked", F.when(found, now).otherwise(F.col("last_checked")))
        .drop("_repo", "_iid", "_new")
    )


def refresh_counters(refreshed: DataFrame) -> DataFrame:
    return refreshed.agg(
        F.count_if(F.col("refresh_outcome") == "updated").alias("updated"),
        F.count_if(F.col("refresh_outcome") == "error").alias("errors"),
        F.count_if(F.col("refresh_outcome") == "insufficient").alias("insufficient"),
    )


def status_counters(tracked: DataFrame) -> DataFrame:
    return tracked.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("opened", "merged", "closed")],
    )


def with_status(tracked: DataFrame, status: str) -> DataFrame:
    return canonical_order(tracked.filter(F.lower(_status()) == status.lower()))


def dashboard_cards(tracked: DataFrame, errors: int = 0) -> DataFrame:
    """(label, value) of the five cards."""
    counts = status_counters(tracked)
    cards = F.array(
        *[
            F.struct(F.lit(i).alias("rank"), F.lit(label).alias("label"), value.cast("bigint").alias("value"))
            for i, (label, value) in enumerate(
                [
                    ("Total MRs", F.col("total")),
                    ("Open", F.col("opened")),
                    ("Merged", F.col("merged")),
                    ("Closed", F.col("closed")),
                    ("Errors", F.lit(errors)),
                ]
            )
        ]
    )
    return counts.select(F.explode(cards).alias("c")).select("c.*")


def dashboard_items(tracked: DataFrame) -> DataFrame:
    """Items of each bucket, to be shown by bucket, address and status."""
    return tracked.select(
        status_bucket(F.col("status")).alias("bucket"),
        "repository_name",
        _url().alias("url"),
        F.concat(
            F.coalesce("package_name", F.lit("Unknown")), F.lit(" → "), F.coalesce("new_version", F.lit("Unknown"))
        ).alias("package"),
        F.coalesce("target_branch", F.lit("Unknown")).alias("target_branch"),
        F.coalesce("source_branch", F.lit("Unknown")).alias("source_branch"),
        (F.coalesce("existed", F.lit(False)) | F.coalesce("was_existing", F.lit(False))).alias("pre_existing"),
        _status().alias("status"),
    )


def bucket_rank(bucket: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), bucket)
