"""Cross-tokenizer alignment: groups and links of the tokens that two tokenizers make of each text (operator 13).

A is a byte-level BPE file of the ``tokenizers`` library and encodes a space and the text; B is a sentencepiece model, which
adds that space itself. Both give the same bytes, so byte offsets where tokens of both end cut them into groups, and all
A-B pairs of a group are its links.

Neither tokenizer makes a token over the border of a character that is no white space and a space that such a one follows,
so texts are cut there, and each distinct stretch of a batch is encoded once. (For A that is its pre-tokenizer's pattern;
for B no piece has U+2581 after another character. Where a file is not so, texts are encoded uncut.)

Alignment of a batch goes in lockstep: a state vector holds a pointer into A's and one into B's tokens for every document.
Each step compares the ends of the tokens pointed at, moves the pointer behind (both where they end together, which is a
cut) and emits the groups and links that were cut; documents that are through leave the vectors. A long document goes as
several lanes that start at common ends about ``LANE`` tokens apart, so a step always has many lanes to move. A group of
more than ``WIDE`` links hands on its distinct pairs with their numbers instead of each link.

Counts over the corpus: a document hands on its distinct pairs, which a task adds up before the shuffle. The pairs of the
highest counts, at most ``TABLE`` of them, are looked up in a table of that size, sent to all tasks; so no pair that
half of all documents hold meets in one task. The others, whose counts are small, are joined by pair.

Edge cases: a null or empty text has no tokens, nor one whose joined A or B bytes differ from a space and the text (for
instance a text that holds U+2581); its numbers are 0 and its digest ''. Special tokens' strings are plain text. Ties for an
A id's highest count all count as best. Repeated rows and null ids are documents of their own. An empty table gives no rows.
Texts of any length are encoded whole, one at a time where they are longer than a chunk. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbump.llm.ragged import Runs, decimals, gather, offsets
from fleetbump.llm.tables import written
from fleetbump.llm.words import chunks

LANE = 256
WIDE = 1 << 16
TABLE = 500_000
# Stretches whose ids a task keeps for its next batches, and their characters together.
KEPT = 400_000
KEPT_CHARS = 1 << 25
BORDER = re.compile(r"(?<=\S) (?=\S)")
# An id pair is one number: A's id times PAIR plus B's id.
PAIR = 1 << 20


def byte_level() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: visible Latin-1 stands for itself, the rest in order from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Tokenizers:
    """The two files' contents, as they are sent to the tasks."""

    a: str
    b: bytes

    @staticmethod
    def read(a_path: str, b_path: str) -> Tokenizers:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            return Tokenizers(a.read(), b.read())


class Encoders:
    """Both tokenizers in a task; ``tokens`` gives the ids of texts whose bytes both keep."""

    def __init__(self, files: Tokenizers):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=files.b)
        given = json.loads(files.a)
        entries = given["model"]["vocab"]
        of = byte_level()
        strings = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            strings[i] = bytes(of[c] for c in entry)
        self.a_runs = Runs(strings)
        self.b_runs = Runs([self._piece(i) for i in range(self.b.get_piece_size())])
        self.a_numbers = decimals(len(strings), ",")
        self.b_numbers = decimals(self.b.get_piece_size(), ",")
        cutter = given["pre_tokenizer"] or {}
        plain = given["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex")
        crossing = any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        self.cuts = plain and not crossing
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2  # ids of all stretches, and how many each has

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @staticmethod
    def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        first = offsets(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))
        return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(first[-1])), first

    def _stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the stretches of all texts, first of each text); new ones are encoded."""
        if len(self.number) > KEPT or self.chars > KEPT_CHARS:
            self._forget()
        cut = [(BORDER.split(t) if self.cuts else [t]) if t else [] for t in texts]
        new = [x for x in dict.fromkeys(chain.from_iterable(cut)) if x not in self.number]
        a = [e.ids for e in self.a.encode_batch_fast([" " + x for x in new], add_special_tokens=False)]
        b = self.b.encode(new, num_threads=1)
        for i, lists in enumerate((a, b)):
            ids, first = self._flat(lists)
            self.kept[i] = tuple(np.concatenate(x) for x in zip(self.kept[i], (ids, np.diff(first))))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.chars += sum(map(len, new))
        first = offsets(np.fromiter(map(len, cut), dtype=np.int64, count=len(cut)))
        of = self.number.__getitem__
        return np.fromiter(map(of, chain.from_iterable(cut)), dtype=np.int64, count=int(first[-1])), first

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, first of each text, B ids, first of each text); a text that cannot be aligned has none."""
        spaced = [" " + t for t in texts]
        numbers, cut_first = self._stretches(texts)
        (a, a_first), (b, b_first) = (
            (gather(ids, offsets(sizes)[numbers], sizes[numbers]), offsets(sizes[numbers])[cut_first])
            for ids, sizes in self.kept
        )
        raw = [s.encode() for s in spaced]
        whole = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = offsets(np.array([len(r) for r in raw], dtype=np.int64))
        good = np.array([bool(t) for t in texts])
        for runs, ids, first in ((self.a_runs, a, a_first), (self.b_runs, b, b_first)):
            made = runs.joined(ids)
            at = offsets(runs.lengths[ids])[first]
            if len(made) == len(whole) and (at == ends).all() and (made == whole).all():
                continue
            data = made.tobytes()
            good &= [data[x:y] == r for x, y, r in zip(at.tolist(), at[1:].tolist(), raw)]
        if not good.all():
            a, a_first = self._without(a, a_first, good)
            b, b_first = self._without(b, b_first, good)
        return a, a_first, b, b_first

    @staticmethod
    def _without(ids: np.ndarray, first: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(first)
        return ids[np.repeat(good, sizes)], offsets(np.where(good, sizes, 0))


def _lanes(a_ends: np.ndarray, a_first: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First A token, first B token and last A token (exclusive) of each lane."""
    starts = a_first[:-1][np.diff(a_first) > 0]
    for back in range(4):  # a lane may start after the LANE-th token of a document, or one of the few before it
        at = np.concatenate([np.arange(x + LANE - back, y, LANE) for x, y in zip(a_first, a_first[1:]) if y - x > LANE] or [[]])
        at = at.astype(np.int64)
        before = a_ends[at - 1]
        shared = b_ends[np.minimum(np.searchsorted(b_ends, before), len(b_ends) - 1)] == before
        starts = np.concatenate([starts, at[shared]])
    starts = np.unique(starts)
    # Lanes that start within a few tokens of each other are one.
    keep = np.ones(len(starts), dtype=bool)
    keep[1:] = (np.diff(starts) > 4) | np.isin(starts[1:], a_first)
    starts = starts[keep]
    b_starts = np.searchsorted(b_ends, np.where(starts > 0, a_ends[starts - 1], 0), side="right")
    return starts, b_starts, np.append(starts[1:], len(a_ends))


@dataclass
class Aligned:
    """Groups of a batch (first A and B token, in order) and its links as (document, A id, B id, how many)."""

    a_start: np.ndarray
    b_start: np.ndarray
    doc: np.ndarray
    a: np.ndarray
    b: np.ndarray
    links: np.ndarray


def lockstep(
    a_ids: np.ndarray, a_sizes: np.ndarray, a_first: np.ndarray, b_ids: np.ndarray, b_sizes: np.ndarray
) -> Aligned:
    """Align all documents of a batch at once. Both tokenizers' sizes in bytes add up to the same for each document."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    none = np.zeros(0, dtype=np.int64)
    groups, links, wide = [(none, none)], [(none, none)], []
    if len(a_ends):
        a, b, stop = _lanes(a_ends, a_first, b_ends)
        a_open, b_open = a.copy(), b.copy()
        while len(a):
            ends_a, ends_b = a_ends[a], b_ends[b]
            cut = np.flatnonzero(ends_a == ends_b)
            a, b = a + (ends_a <= ends_b), b + (ends_b <= ends_a)
            if not len(cut):
                continue
            a_from, a_to, b_from, b_to = a_open[cut], a[cut], b_open[cut], b[cut]
            groups.append((a_from, b_from))
            across, down = a_to - a_from, b_to - b_from
            size = across * down
            if size.max() == 1:
                links.append((a_from, b_from))
            else:
                for g in np.flatnonzero(size > WIDE):
                    wide.append((a_from[g], a_to[g], b_from[g], b_to[g]))
                size[size > WIDE] = 0
                of = np.repeat(np.arange(len(cut)), size)
                nth = np.arange(len(of)) - np.repeat(offsets(size)[:-1], size)
                links.append((a_from[of] + nth // down[of], b_from[of] + nth % down[of]))
            a_open[cut], b_open[cut] = a_to, b_to
            on = a < stop
            if not on.all():
                a, b, stop, a_open, b_open = a[on], b[on], stop[on], a_open[on], b_open[on]
    a_start, b_start = (np.concatenate(x) for x in zip(*groups))
    order = np.argsort(a_start)
    a_link, b_link = (np.concatenate(x) for x in zip(*links))
    doc = np.searchsorted(a_first, a_link, side="right") - 1
    pieces = [(doc, a_ids[a_link], b_ids[b_link], np.ones(len(doc), dtype=np.int64))]
    for a_from, a_to, b_from, b_to in wide:
        a_own, a_times = np.unique(a_ids[a_from:a_to], return_counts=True)
        b_own, b_times = np.unique(b_ids[b_from:b_to], return_counts=True)
        size = len(a_own) * len(b_own)
        pieces.append((
            np.full(size, np.searchsorted(a_first, a_from, side="right") - 1),
            np.repeat(a_own, len(b_own)),
            np.tile(b_own, len(a_own)),
            np.outer(a_times, b_times).ravel(),
        ))
    doc, a_link, b_link, times = (np.concatenate(x) for x in zip(*pieces))
    return Aligned(a_start[order], b_start[order], doc, a_link, b_link, times)


def _listed(
    e: Encoders, found: Aligned, a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray
) -> list[bytes]:
    """The text ``a1,a2|b1;a3|b2,b3`` of each document."""
    n = len(a) + len(b)
    sizes, is_a, ids = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
    a_sizes = np.diff(np.append(found.a_start, len(a)))
    b_sizes = np.diff(np.append(found.b_start, len(b)))
    a_at = np.arange(len(a)) + np.repeat(found.b_start, a_sizes)
    b_at = np.arange(len(b)) + np.repeat(found.a_start + a_sizes, b_sizes)
    ids[a_at], ids[b_at], is_a[a_at] = a, b, True
    starts = np.where(is_a, e.a_numbers.starts[:-1][np.where(is_a, ids, 0)], e.b_numbers.starts[:-1][np.where(is_a, 0, ids)])
    starts += np.where(is_a, 0, len(e.a_numbers.data))
    sizes[a_at], sizes[b_at] = e.a_numbers.lengths[a], e.b_numbers.lengths[b]
    text = gather(np.concatenate([e.a_numbers.data, e.b_numbers.data]), starts, sizes)
    ends = offsets(sizes)
    if len(a):
        text[ends[a_at[np.cumsum(a_sizes) - 1] + 1] - 1] = ord("|")
        text[ends[b_at[np.cumsum(b_sizes) - 1] + 1] - 1] = ord(";")
    data, at = text.tobytes(), ends[a_first + b_first].tolist()
    return [data[x : max(x, y - 1)] for x, y in zip(at, at[1:])]


ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, "
    "times array<long>"
)


def align(docs: DataFrame, files: Tokenizers, digest: bool = False) -> DataFrame:
    """One row per document (``ALIGNED``): its groups as text, or that text's digest, and its distinct pairs with the
    number of links of each. ``row`` tells documents of equal or null ids apart."""
    sent = docs.sparkSession.sparkContext.broadcast(files)
    names = [x.split()[0] for x in ALIGNED.split(", ")]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoders(sent.value)
        for batch in batches:
            for part in chunks(batch):
                texts = pc.fill_null(part.column("text"), "").to_pylist()
                a, a_first, b, b_first = e.tokens(texts)
                found = lockstep(a, e.a_runs.lengths[a], a_first, b, e.b_runs.lengths[b])
                lists = _listed(e, found, a, b, a_first, b_first)
                if digest:
                    lists = [hashlib.sha256(x).hexdigest() if x else "" for x in lists]
                n_groups = np.diff(np.searchsorted(found.a_start, a_first))
                n_links = np.zeros(len(texts), dtype=np.int64)
                np.add.at(n_links, found.doc, found.links)
                # Links in the order of document and pair; equal ones are added up.
                pair = found.a * PAIR + found.b
                order = np.lexsort((pair, found.doc))
                doc, pair, times = found.doc[order], pair[order], found.links[order]
                new = np.ones(len(pair), dtype=bool)
                new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
                head = np.flatnonzero(new)
                times = np.add.reduceat(times, head) if len(head) else times
                ends = pa.array(offsets(np.bincount(doc[head], minlength=len(texts))), pa.int32())
                columns = [
                    part.column("row"),
                    part.column("doc_id"),
                    pa.array(np.diff(a_first)),
                    pa.array(np.diff(b_first)),
                    pa.array(n_groups),
                    pa.array(n_links),
                    pa.array(lists if digest else [x.decode() for x in lists], pa.string()),
                    pa.ListArray.from_arrays(ends, pa.array(pair[head])),
                    pa.ListArray.from_arrays(ends, pa.array(times)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(aligned, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how many documents hold an id pair, and whether that is its A id's highest count."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = written(counts, "pair-counts")
    a = F.floor(F.col("pair") / PAIR)
    # A row for each id of A at most: bounded by the vocabulary.
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("highest"))
    joined = counts.withColumn("a", a).join(F.broadcast(highest), "a")
    return joined.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _cut(counts: DataFrame) -> int:
    """The least count of pairs that go into the table: at most TABLE pairs have it or a higher one."""
    # Counts fall into steps of an eighth of a power of two: a few hundred rows however many counts there are.
    step = F.floor(F.log2("count") * 8)
    taken = 0
    cut = None
    for r in counts.groupBy(step.alias("s")).agg(F.min("count").alias("least"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("s")).collect():
        taken += r["n"]
        if taken > TABLE:
            break
        cut = r["least"]
    return cut if cut is not None else 2**62


def scored(aligned: DataFrame) -> DataFrame:
    """Per document: doc_id, its numbers, n_best and count_sum over its links, and ``groups``; ``aligned`` is a written table."""
    counts = written(pair_counts(aligned), "pair-best")
    cut = _cut(counts)
    hot = counts.where(F.col("count") >= cut).toPandas().sort_values("pair")
    table = tuple(hot[c].to_numpy(dtype=t) for c, t in (("pair", np.int64), ("count", np.int64), ("best", np.int64)))
    sent = aligned.sparkSession.sparkContext.broadcast(table)
    partly = "row long, best_hot long, sum_hot long, cold array<struct<pair:long,times:long>>"

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counted, best = sent.value
        for batch in batches:
            sizes = pc.list_value_length(batch.column("pairs")).to_numpy(zero_copy_only=False)
            own = batch.column("pairs").flatten().to_numpy(zero_copy_only=False)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
            hit = pairs[at] == own if len(pairs) else np.zeros(len(own), dtype=bool)
            sums = []
            for value in (best, counted):
                total = np.zeros(len(sizes), dtype=np.int64)
                np.add.at(total, doc[hit], times[hit] * value[at[hit]])
                sums.append(pa.array(total))
            ends = pa.array(offsets(np.bincount(doc[~hit], minlength=len(sizes))), pa.int32())
            rest = pa.StructArray.from_arrays([pa.array(own[~hit]), pa.array(times[~hit])], ["pair", "times"])
            columns = [batch.column("row"), *sums, pa.ListArray.from_arrays(ends, rest)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "best_hot", "sum_hot", "cold"])

    part = written(aligned.select("row", "pairs", "times").mapInArrow(looked_up, partly), "pair-sums")
    cold = part.select("row", F.explode("cold").alias("p")).select("row", "p.pair", "p.times")
    rare = counts.where(F.col("count") < cut)
    sums = (
        cold.join(rare, "pair")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("best_cold"), F.sum(F.col("times") * F.col("count")).alias("sum_cold"))
    )
    whole = aligned.drop("pairs", "times").join(part.drop("cold"), "row").join(sums, "row", "left")
    return whole.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("best_hot") + F.coalesce("best_cold", F.lit(0))).alias("n_best"),
        (F.col("sum_hot") + F.coalesce("sum_cold", F.lit(0))).alias("count_sum"),
        "groups",
    )


def alignments(docs: DataFrame, files: Tokenizers) -> DataFrame:
    """Numbers of every document and the digest of its groups."""
    return scored(written(align(docs, files, digest=True), "aligned")).withColumnRenamed("groups", "groups_sha256")
