"""Best-fit packing of documents into training sequences of several permitted lengths (operator 3).

A document of ``n`` words has ``n + 1`` tokens, the last its end; a column of token counts may be given instead. Documents
longer than the longest sequence are cut into pieces of that length. Pieces are dealt by hash into shards of about
``shard`` pieces, which are packed side by side; only ids and lengths cross the shuffle, and a shard has the same size at
any size of table.

Within a shard, pieces go longest first into the open bin that they leave fullest. Where none has room, the bin size of
the least cost for each token it can still be filled with is opened: a sequence of ``c`` tokens costs
``fixed + c + c * c / slope`` (start-up, linear and attention work). At the end every bin is downsized to the shortest
permitted length that holds its contents.

Edge cases: null text counts as empty and packs as one end token; repeated rows are packed once each; null ids are
packed like others; an empty table gives no bins.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    lengths: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    fixed: float = 64.0
    slope: float = 65536.0
    shard: int = 4096


SCHEMA = (
    "doc_id long, piece long, piece_start long, n_tokens long, bin_id long, bin_start long, bin_length long, "
    "bin_tokens long"
)


def pieces(docs: DataFrame, settings: Settings = Settings(), tokens: str | None = None) -> DataFrame:
    """doc_id, piece, piece_start, n_tokens of every piece; ``tokens`` names a column of token counts."""
    longest = max(settings.lengths)
    count = F.col(tokens) if tokens else F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)) + 1
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), count.cast("long").alias("tokens"))
    counted = counted.withColumn("last", F.floor((F.greatest("tokens", F.lit(1)) - 1) / longest).cast("long"))
    cut = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    start = F.col("piece") * longest
    return cut.select(
        "doc_id",
        "piece",
        start.alias("piece_start"),
        F.least(F.greatest("tokens", F.lit(1)) - start, F.lit(longest)).alias("n_tokens"),
    )


def best_fit(sizes: list[int], settings: Settings) -> list[tuple[int, int, int, int]]:
    """(bin, start in the bin, bin length, tokens in the bin) of each size; ``sizes`` is longest first."""
    lengths = sorted(settings.lengths)
    cost = {c: settings.fixed + c + c * c / settings.slope for c in lengths}
    room: list[tuple[int, int]] = []  # (tokens free, bin), sorted
    filled: list[int] = []
    placed = []
    left = sum(sizes)
    for size in sizes:
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            free, own = room.pop(at)
        else:
            own = len(filled)
            filled.append(0)
            free = min((c for c in lengths if c >= size), key=lambda c: (cost[c] / min(c, left), c))
        placed.append((own, filled[own]))
        filled[own] += size
        left -= size
        if free > size:
            bisect.insort(room, (free - size, own))
    shortest = [lengths[bisect.bisect_left(lengths, n)] for n in filled]
    return [(own, start, shortest[own], filled[own]) for own, start in placed]


def pack(docs: DataFrame, settings: Settings = Settings(), tokens: str | None = None) -> DataFrame:
    """One row per piece: its document, span and place in a bin (``SCHEMA``)."""
    cut = pieces(docs, settings, tokens)
    shards = max(1, -(-docs.count() // settings.shard))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        places = np.array(best_fit(rows.column("n_tokens").to_pylist(), settings), dtype=np.int64).reshape(-1, 4)
        own = [rows.column(c) for c in ("doc_id", "piece", "piece_start", "n_tokens")]
        bins = [(key[0].as_py() << 32) + places[:, 0], places[:, 1], places[:, 2], places[:, 3]]
        return pa.Table.from_arrays([*own, *map(pa.array, bins)], [x.split()[0] for x in SCHEMA.split(", ")])

    return dealt.groupBy("shard").applyInArrow(packed, SCHEMA)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per bin: its length, tokens and the spans it is made of, in order."""
    span = F.struct("bin_start", "doc_id", "piece_start", "n_tokens")
    return packed.groupBy("bin_id", "bin_length", "bin_tokens").agg(F.sort_array(F.collect_list(span)).alias("spans"))
