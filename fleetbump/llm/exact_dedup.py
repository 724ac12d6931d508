"""Exact deduplication by a content sort (operator 4), in DataFrame operations only.

Texts are equal when identical after A-Z are lower-cased. Rows are ordered by their normalised bytes: by the first 32
characters, then the SHA-256 digest, then the text itself and the id, so equal texts are neighbours and splitters stay
short however long a shared beginning is.

1. Splitters are taken at even steps from a sorted sample of ``(beginning, digest, id)``. As the id is part of the key,
   a text that fills a third of the table is cut over as many ranges as its rows need.
2. The text crosses one shuffle, by range. Each range is sorted (spilling as needed) and every row is compared in full
   with the one before it: equal neighbours are one run.
3. A run may go on in the next range. First and last texts of the ranges, two for each range, are compared in full; the
   result is a table with at most two rows for each range.

Edge cases: null text counts as empty, and empty texts are equal; rows that repeat text and id are one group like others,
exactly one of them stays; null ids sort lowest; an empty table gives an empty result; other columns are carried as they
are, whatever their names.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetbump.llm.tables import written

BEGINNING = 32
# Ranges for each shuffle partition, and sampled keys for each range.
RANGES, SAMPLED = 4, 20


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; text that is ASCII throughout takes the faster built-in."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def _splitters(keyed: DataFrame, ranges: int) -> list:
    rows = keyed.count()
    share = min(1.0, SAMPLED * ranges / max(rows, 1))
    sample = keyed.sample(share, seed=4) if share < 1 else keyed
    # About RANGES * SAMPLED short keys for each shuffle partition, whatever the size of the table.
    keys = sample.select("begins", F.hex("digest").alias("digest"), "id").orderBy("begins", "digest", "id").collect()
    step = max(1.0, len(keys) / ranges)
    cuts = [keys[int(i * step)] for i in range(1, ranges) if int(i * step) < len(keys)]
    return [{"begins": k.begins, "digest": k.digest, "id": k.id} for k in cuts]


def _range_of(key: Column, cuts: list) -> Column:
    """How many of the sorted splitters are not above the key, by binary search."""
    if not cuts:
        return F.lit(0)
    bounds = F.from_json(F.lit(json.dumps(cuts)), "array<struct<begins:string,digest:string,id:long>>")
    steps = [F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))]

    def narrow(low: Column, step: Column) -> Column:
        to = low + step
        return F.when((to <= len(cuts)) & (F.get(bounds, to - 1) <= key), to).otherwise(low)

    return F.aggregate(F.array(*steps), F.lit(0), narrow)


def runs(docs: DataFrame, whole: bool) -> DataFrame:
    """Each row of ``docs``: id, digest, range, run within the range, whether it starts and ends the run.

    Written once, with the ``whole`` row as a struct if asked for; the digest is the SHA-256 of the normalised text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        ascii_lower(text).alias("norm"),
    )
    keyed = keyed.select(
        "row", "id", F.substring("norm", 1, BEGINNING).alias("begins"), F.unhex(F.sha2("norm", 256)).alias("digest")
    )
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _splitters(keyed, ranges)
    key = F.struct("begins", F.hex("digest").alias("digest"), "id")
    dealt = keyed.withColumn("range", _range_of(key, cuts)).repartition("range")
    dealt = dealt.withColumn("norm", ascii_lower(F.coalesce(F.col("row.text"), F.lit(""))))
    order = Window.partitionBy("range").orderBy("begins", "digest", "norm", "id")
    before, after = F.lag("norm").over(order), F.lead("norm").over(order)
    told = dealt.select(
        "*", before.alias("before"), after.alias("after"), F.row_number().over(order).alias("place")
    ).select(
        "row",
        "id",
        "digest",
        "range",
        "place",
        F.coalesce(F.col("before") != F.col("norm"), F.lit(True)).alias("starts"),
        F.coalesce(F.col("after") != F.col("norm"), F.lit(True)).alias("ends"),
        F.when(F.col("place") == 1, F.col("norm")).alias("first_text"),
        F.when(F.col("after").isNull(), F.col("norm")).alias("last_text"),
    )
    counted = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("run", F.sum(F.col("starts").cast("long")).over(counted))
    return written(told.drop("place") if whole else told.drop("place", "row"), "runs")


def bridges(found: DataFrame) -> DataFrame:
    """First and last runs of the ranges: ``range, run``, the run they belong to, and whether they go on across edges."""
    edges = found.where("first_text is not null or last_text is not null").groupBy("range").agg(
        F.max("first_text").alias("first_text"), F.max("last_text").alias("last_text"), F.max("run").alias("last_run")
    )
    # One row for each range: their number is set by the shuffle partitions, not by the table.
    order = Window.orderBy("range")
    edges = edges.select(
        "range",
        "last_run",
        F.coalesce(F.lag("last_text").over(order) == F.col("first_text"), F.lit(False)).alias("joined"),
        F.coalesce(F.lead("first_text").over(order) == F.col("last_text"), F.lit(False)).alias("goes_on"),
    )
    anchor = F.when((F.col("last_run") > 1) | ~F.col("joined"), F.struct("range", F.col("last_run").alias("run")))
    earlier = F.last(anchor, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.withColumn("root", F.when(F.col("joined"), earlier))
    own = F.struct("range", F.col("run").alias("run"))
    both = edges.select(
        "range",
        F.explode(F.array_distinct(F.array(F.lit(1).cast("long"), F.col("last_run")))).alias("run"),
        "last_run",
        "joined",
        "goes_on",
        "root",
    )
    return both.select(
        "range",
        "run",
        F.when((F.col("run") == 1) & F.col("joined"), F.col("root")).otherwise(own).alias("root"),
        ((F.col("run") == 1) & F.col("joined")).alias("joined"),
        ((F.col("run") == F.col("last_run")) & F.col("goes_on")).alias("goes_on"),
    )


def _decided(docs: DataFrame, keep: str, whole: bool) -> DataFrame:
    """``runs`` with the run across ranges (``root``) and whether the row stays."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is largest or smallest, not {keep!r}")
    found = runs(docs, whole)
    linked = found.join(F.broadcast(written(bridges(found), "bridges")), ["range", "run"], "left")
    stays = F.col("ends") & ~F.coalesce("goes_on", F.lit(False))
    if keep == "smallest":
        stays = F.col("starts") & ~F.coalesce("joined", F.lit(False))
    return linked.select(
        *(["row"] if whole else []), "id", "digest", F.coalesce("root", F.struct("range", "run")).alias("root"), stays.alias("kept")
    )


def groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    decided = _decided(docs.select("doc_id", "text"), keep, whole=False)
    best = F.max("id") if keep == "largest" else F.min("id")
    totals = decided.groupBy("root").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    return decided.join(totals, "root").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_one(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, one for each different text, with all their columns."""
    return _decided(docs, keep, whole=True).where("kept").select("row.*")
