"""Whitening of embeddings by the leading eigenpairs of their covariance (operator 12).

An entry ``c`` becomes the whole number ``x = floor(scale * c) + offset``. Passes over the table, none of which shuffles a
row: counts and sums of each dimension; sums of products of ``x`` less the whole part of its mean; the covariance of the
whitened values; the values themselves. Tasks hand on one row for each dimension or pair of dimensions, which Spark adds
up, so the driver gets d * (d + 1) / 2 numbers however many rows there are. Products of whole numbers are exact in doubles
up to 2^53, so sums do not depend on how the table is split. The eigenpairs are found on the driver (``spectrum``).

Edge cases: a vector that is null, or holds a null or non-finite entry, is left out; so is one whose length is not the
table's most common length (ties: the longer). Entries of 2^40 or more in size are an error. Repeated rows and null ids
count and are returned like others; equal eigenvalues get any one orthogonal pair of vectors; components without variance
cannot be whitened and are left out, so equal vectors, or an empty table, give no rows. A deviation that no long holds is
null. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbump.llm.spectrum import Pair, leading

LARGEST = 2.0**40
BLOCK = 1 << 14  # vectors multiplied at once


@dataclass(frozen=True)
class Settings:
    components: int = 8
    scale: float = 1024.0
    offset: int = 100_000


@dataclass
class Moments:
    """Number of vectors, their sums S by dimension, the whole part of S / n, the rest of S, and the covariance."""

    n: int
    sums: list[int]
    middle: np.ndarray
    rest: np.ndarray
    covariance: np.ndarray


def usable(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id") -> tuple[DataFrame, int]:
    """(vec_id and v of each row that can be used, length of v)."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(v.isNotNull() & finite)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    d = lengths[0]["d"] if lengths else 0
    return rows.where(F.size("v") == d), d


def _whole(batch: pa.RecordBatch, d: int, settings: Settings) -> np.ndarray:
    """The x of a batch, a row for each vector."""
    c = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    if c.size and np.abs(c).max() >= LARGEST:
        raise ValueError("an entry is 2^40 or more in size")
    return np.floor(settings.scale * c).astype(np.int64) + settings.offset


def _blocks(batch: pa.RecordBatch, d: int, settings: Settings, middle: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, batch.num_rows, BLOCK):
        yield _whole(batch.slice(at, BLOCK), d, settings) - middle


def moments(rows: DataFrame, d: int, settings: Settings = Settings()) -> Moments:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d, dtype=np.int64), 0
        for batch in batches:
            total += _whole(batch, d, settings).sum(axis=0)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([np.arange(d), total, np.full(d, n)], ["i", "s", "n"])

    added = rows.mapInArrow(sums, "i long, s long, n long").groupBy("i")
    by_dimension = added.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    n, s = by_dimension[0]["n"], [int(r["s"]) for r in by_dimension]
    middle, rest = (np.array(x, dtype=np.int64) for x in zip(*(divmod(v, n) for v in s)))
    delta = rest / n
    upper = np.triu_indices(d)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((d, d)), False
        for batch in batches:
            for block in _blocks(batch, d, settings, middle):
                y = block.astype(np.float64)
                total += y.T @ y
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([upper[0], upper[1], total[upper]], ["i", "j", "p"])

    added = rows.mapInArrow(products, "i long, j long, p double").groupBy("i", "j").agg(F.sum("p").alias("p"))
    found = added.toPandas()
    covariance = np.zeros((d, d))
    covariance[found["i"], found["j"]] = found["p"] / n
    covariance = np.triu(covariance) + np.triu(covariance, 1).T - np.outer(delta, delta)
    return Moments(n, s, middle, rest, covariance)


def _projector(m: Moments, pairs: list[Pair]) -> np.ndarray:
    return np.array([p.vector / np.sqrt(p.value) for p in pairs]).T


def _deviations(y: np.ndarray, m: Moments) -> pa.Array:
    """Sums of (n x - S)^2, exact; null where no long holds them."""
    apart = m.n * y.astype(np.float64) - m.rest
    fits = (apart * apart).sum(axis=1) < 2.0**63 * (1 - 1e-9)
    exact = m.n * y[fits] - m.rest
    out = np.zeros(len(y), dtype=np.int64)
    out[fits] = (exact * exact).sum(axis=1)
    return pa.array(out, mask=~fits)


def identity_error(rows: DataFrame, d: int, m: Moments, pairs: list[Pair], settings: Settings = Settings()) -> float:
    """Largest absolute entry of the whitened values' covariance less the identity, measured on all rows."""
    w, delta, k = _projector(m, pairs), m.rest / m.n, len(pairs)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for y in _blocks(batch, d, settings, m.middle):
                z = (y - delta) @ w
                total += z.T @ z
                mean += z.sum(axis=0)
        i, j = np.indices((k, k + 1)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([i, j, np.column_stack([total, mean]).ravel()], ["i", "j", "p"])

    added = rows.mapInArrow(products, "i long, j long, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).toPandas()
    both = np.zeros((k, k + 1))
    both[added["i"], added["j"]] = added["p"] / m.n
    mean = both[:, k]
    return float(np.abs(both[:, :k] - np.outer(mean, mean) - np.eye(k)).max())


SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, eigenvalue double, explained double, "
    "identity_error double"
)


def whiten(
    vectors: DataFrame, settings: Settings = Settings(), column: str = "embedding", id_column: str = "vec_id"
) -> DataFrame:
    """One row for each vector that can be used and each component (``SCHEMA``)."""
    nothing = vectors.sparkSession.createDataFrame([], SCHEMA)
    rows, d = usable(vectors, column, id_column)
    if not d:
        return nothing
    m = moments(rows, d, settings)
    pairs = leading(m.covariance, settings.components)
    if not pairs:
        return nothing
    error = identity_error(rows, d, m, pairs, settings)
    w, delta, k = _projector(m, pairs), m.rest / m.n, len(pairs)
    values = np.array([p.value for p in pairs])
    explained = values / np.trace(m.covariance)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                y = _whole(part, d, settings) - m.middle
                each, size = np.repeat(np.arange(len(y)), k), len(y) * k
                columns = [
                    part.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                    pa.array(np.full(size, m.n)),
                    _deviations(y, m).take(pa.array(each)),
                    pa.array(((y - delta) @ w).ravel()),
                    pa.array(np.tile(values, len(y))),
                    pa.array(np.tile(explained, len(y))),
                    pa.array(np.full(size, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(projected, SCHEMA)
