"""Numbering rows inside groups without sorting a whole group in one task.

A plain ``row_number`` over a hot key sorts that key's rows in a single task. Here the group is cut
into chunks along its order columns, rows are numbered inside (key, chunk), and the sizes of the
earlier chunks, a far smaller table, are added. Numbers are the same as over the whole group.

``range_chunks`` cuts by a sample, so chunks hold about equally many rows however the order columns are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

SAMPLED = 64  # rows looked at for each chunk


def range_chunks(df: DataFrame, keys: list[str], by: list[str], like: DataFrame | None = None, out: str = "_range") -> DataFrame:
    """Add a number that does not fall along ``by`` inside a group and splits large groups into chunks.

    As a range shuffle does, it sorts a sample (``SAMPLED`` rows for each shuffle partition) and takes every
    ``SAMPLED``-th row as a splitter, so there are at most as many splitters as shuffle partitions, and a group gets its
    share of them. ``like`` is a cheaper table with about the same groups to sample from.
    """
    source = (df if like is None else like).select(*keys, *by)
    chunks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SAMPLED * chunks / max(1, source.count()))
    # The sample is small by its share, so one task may sort it.
    sample = source.sample(share, seed=1).repartition(1).sortWithinPartitions(*keys, *by).collect()
    own: dict[tuple, list] = {}
    for row in sample[SAMPLED::SAMPLED]:
        group = own.setdefault(tuple(row)[: len(keys)], [])
        if not group or group[-1] != tuple(row)[len(keys) :]:
            group.append(tuple(row)[len(keys) :])
    names = [f"_k{i}" for i in range(len(keys))]
    bound = StructType([StructField(c, source.schema[c].dataType) for c in by])
    schema = StructType([*[StructField(n, source.schema[k].dataType) for n, k in zip(names, keys)], StructField("_bounds", ArrayType(bound))])
    splitters = df.sparkSession.createDataFrame([(*key, group) for key, group in own.items()], schema)
    same = F.lit(True)
    for name, key in zip(names, keys):
        same = same & df[key].eqNullSafe(F.col(name))
    here = F.struct(*[F.col(c) for c in by])
    # Splitters at or before the row, found by steps of falling powers of two.
    widest = max(map(len, own.values()), default=0)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(widest.bit_length()))]).cast("array<int>")

    def step(at: Column, more: Column) -> Column:
        on = (at + more <= F.size("_bounds")) & (F.get(F.col("_bounds"), at + more - 1) <= here)
        return F.when(on, at + more).otherwise(at)

    found = F.aggregate(steps, F.lit(0), step)
    joined = df.join(F.broadcast(splitters), same, "left")
    return joined.withColumn(out, F.when(F.col("_bounds").isNull(), 0).otherwise(found)).drop(*names, "_bounds")



def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    chunk: Column,
    out: str = "position",
    chunk_descending: bool = False,
    total: str | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group, and the group size as ``total`` if named.

    ``chunk`` must not decrease along ``order`` (or not increase, with ``chunk_descending``), for
    instance the column of ``range_chunks``.
    """
    chunked = df.withColumn("_chunk", chunk)
    sizes = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    by_chunk = F.col("_chunk").desc() if chunk_descending else F.col("_chunk").asc()
    earlier = Window.partitionBy(*keys).orderBy(by_chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    if total:
        starts = starts.withColumn(total, F.sum("_size").over(Window.partitionBy(*keys)))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    numbered = chunked.withColumn("_local", F.row_number().over(local))
    joined = numbered.join(starts.drop("_size"), [*keys, "_chunk"])
    return joined.withColumn(out, F.col("_start") + F.col("_local")).drop("_chunk", "_local", "_start")
