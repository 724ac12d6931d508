"""Sinks: ordered text reports and tracking snapshots, written in parallel.

Ordered output is range-partitioned, so the part files, read in name order, are the document.
Every write goes to a new folder; nothing is overwritten in place.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    lines.orderBy(*order).select("line").write.text(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


_ORDER = ["_url", "_status"]


def _ordered(tracked: DataFrame) -> DataFrame:
    return tracked.withColumn("_url", F.coalesce("merge_request_url", F.lit(""))).withColumn(
        "_status", F.coalesce("status", F.lit(""))
    )


def write_tracking_rows(tracked: DataFrame, path: str) -> None:
    """One JSON object per line, by (address, status)."""
    _ordered(tracked).orderBy(*_ORDER).drop(*_ORDER, "ord").write.json(path)


def write_tracking_document(tracked: DataFrame, metadata: dict, path: str) -> None:
    """The nested document: the part files, concatenated in name order, are one JSON text.

    Each row is its own line, so the array is never assembled in one place. ``ord`` must be unique;
    it breaks ties and tells which row comes first (the only one without a leading comma).
    """
    rows = _ordered(tracked)
    order = [*_ORDER, "ord"]
    first = rows.agg(F.min(F.struct(*order)).alias("m")).first()["m"]
    fields = [c for c in tracked.columns if c != "ord"]
    is_first = (F.col("ord") == first["ord"]) if first is not None else F.lit(False)
    body = rows.select(
        F.lit(1).alias("_section"),
        *order,
        F.concat(F.when(is_first, F.lit("")).otherwise(F.lit(",")), F.to_json(F.struct(*fields))).alias("line"),
    )
    spark = tracked.sparkSession
    types = {f.name: f.dataType.simpleString() for f in body.schema.fields}
    frame = spark.createDataFrame(
        [
            (0, '{"metadata":' + json.dumps(metadata, ensure_ascii=False) + ',"merge_requests":['),
            (2, "]}"),
        ],
        "_section int, line string",
    ).select(
        "_section",
        *[F.lit(None).cast(types[c]).alias(c) for c in order],
        "line",
    )
    body.unionByName(frame).orderBy("_section", *order).select("line").write.text(path)
