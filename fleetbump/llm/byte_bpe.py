"""Byte-level BPE encoding and decoding of whole texts by a given vocabulary of ranks (operator 11).

A text is cut into pre-tokens by the pattern; each is encoded by itself, in two tiers:

- a minimal perfect hash resolves pre-tokens that are vocabulary entries: ``n`` entries fill ``n`` slots without a gap,
  by one displacement for each small bucket of entries. A whole batch of pre-tokens is hashed, placed and compared with
  the bytes of its slots at once, so an answer is exact;
- a pre-token that is no entry starts as its bytes, and of the joins of neighbours that are entries the lowest, by rank and
  then by place, is made until none is left. Up to ``SHORT`` bytes the ranks stand in a list whose least is looked for;
  beyond that in a heap over a linked list. An entry of the heap whose neighbours have changed since is passed over, so a
  pre-token of n bytes takes O(n log n) however long it is.

Decoding gathers the entries' bytes. Both work inside the tasks that scan the texts: nothing is shuffled. What is sent to
the executors is the vocabulary alone (its file's size); results of the second tier for short pre-tokens are
kept in a table for each task, which is emptied once it holds ``KEPT``; the ids of a batch are gathered from it at once.

Edge cases: a null text counts as empty; an empty text has no tokens and decodes to no bytes; texts of any length are cut
and encoded in runs of ``RUN`` pre-tokens; equal ranks of joins go leftmost first; repeated rows and null ids give a row
each; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbump.llm.ragged import Runs, decimals, gather, offsets
from fleetbump.llm.words import chunks, hash_bytes, mix

RUN = 1 << 17
KEPT = 400_000
KEPT_BYTES = 64
SHORT = 48
# Texts longer than this are cut lazily, so their pre-tokens never stand in memory together.
LONG_CHARS = 1 << 20
BUCKET = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)

# Code points that the installed ``regex`` takes for letters and numbers, and that Unicode 16, which the
# vocabularies' library follows, does not.
LATER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD "
    "323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _class(ranges: str) -> str:
    return "".join("-".join(rf"\U{int(x, 16):08X}" for x in r.split("-")) for r in ranges.split())


def _members(ranges: str) -> np.ndarray:
    """For every code point whether it is in the ranges."""
    held = np.zeros(0x110000, dtype=bool)
    for r in ranges.split():
        ends = [int(x, 16) for x in r.split("-")]
        held[ends[0] : ends[-1] + 1] = True
    return held


def read_ranks(path: str) -> dict[bytes, int]:
    """Entries of a rank file: on each line an entry in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Cutter:
    """Pre-tokens of a text; letters and numbers are those of Unicode 16."""

    def __init__(self, pattern: str):
        self.plain = regex.compile(pattern)
        self.later = _members(f"{LATER_LETTERS} {LATER_NUMBERS}")
        older = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|LATER)")
        letter, number = rf"[\p{{L}}--[{_class(LATER_LETTERS)}]]", rf"[\p{{N}}--[{_class(LATER_NUMBERS)}]]"
        older = older.replace(r"?\p{L}+", f"?{letter}+").replace(r"?\p{N}+", f"?{number}+")
        self.older = regex.compile("(?V1)" + older.replace("LATER", f"[{_class(LATER_LETTERS)}{_class(LATER_NUMBERS)}]"))

    def _is_older(self, text: str) -> bool:
        """Whether no character of the text is one that later versions class otherwise."""
        if text.isascii():
            return True
        parts = (text[at : at + LONG_CHARS] for at in range(0, len(text), LONG_CHARS))
        return not any(self.later[np.frombuffer(x.encode("utf-32-le"), dtype="<u4")].any() for x in parts)

    def runs(self, text: str) -> Iterator[list[str]]:
        found = self.plain if self._is_older(text) else self.older
        if len(text) <= LONG_CHARS:
            yield found.findall(text)
            return
        matches = (m.group() for m in found.finditer(text))
        while run := list(islice(matches, RUN)):
            yield run


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit numbers: each gets a slot of its own below their count."""

    def __init__(self, numbers: np.ndarray):
        self.slots = max(1, len(numbers))
        self.buckets = max(1, -(-len(numbers) // BUCKET))
        self.moves = np.zeros(self.buckets, dtype=np.int64)
        bucket = self._bucket(numbers)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        first = offsets(sizes)
        free = np.ones(self.slots, dtype=bool)
        tries = np.arange(64, dtype=np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            own = numbers[order[first[b] : first[b + 1]]]
            if len(own) < 2:
                break
            move = 1
            while True:
                places = np.sort(self._place(own[None, :], (tries + move)[:, None]), axis=1)
                fits = free[places].all(axis=1) & (places[:, 1:] != places[:, :-1]).all(axis=1)
                if fits.any():
                    at = int(fits.argmax())
                    break
                move += len(tries)
            self.moves[b] = move + at
            free[places[at]] = False
        # A bucket of one entry takes a slot that is left, written as a number below zero.
        alone = np.flatnonzero(sizes == 1)
        self.moves[alone] = -1 - np.flatnonzero(free)[: len(alone)]

    def _bucket(self, numbers: np.ndarray) -> np.ndarray:
        return (mix(numbers) % np.uint64(self.buckets)).astype(np.int64)

    def _place(self, numbers: np.ndarray, moves: np.ndarray) -> np.ndarray:
        return (mix(numbers ^ (moves.astype(np.uint64) * _ODD)) % np.uint64(self.slots)).astype(np.int64)

    def slot(self, numbers: np.ndarray) -> np.ndarray:
        moves = self.moves[self._bucket(numbers)]
        return np.where(moves < 0, -1 - moves, self._place(numbers, moves))


class Vocabulary:
    """Entries in the order of a minimal perfect hash, with their ids and bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        entries = list(ranks)
        runs = Runs(entries)
        hashes = hash_bytes(runs.data, runs.starts[:-1], runs.lengths)
        if len(np.unique(hashes)) < len(entries):
            raise ValueError("two entries have one hash")
        self.pattern = pattern
        self.hash = PerfectHash(hashes)
        order = np.empty(len(entries), dtype=np.int64)
        order[self.hash.slot(hashes)] = np.arange(len(entries))
        self.hashes = hashes[order]
        self.entries = Runs([entries[i] for i in order])
        self.ids = np.array([ranks[entries[i]] for i in order], dtype=np.int64)

    def strings(self) -> list[bytes]:
        """Entries by id; an id that is not given has none."""
        out = [b""] * (int(self.ids.max(initial=-1)) + 1)
        data, starts = self.entries.data.tobytes(), self.entries.starts
        for slot, number in enumerate(self.ids.tolist()):
            out[number] = data[starts[slot] : starts[slot + 1]]
        return out


class Encoder:
    """Encodes batches of texts; one for each task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.cutter = Cutter(vocabulary.pattern)
        self.ranks = {s: i for i, s in enumerate(vocabulary.strings()) if s}
        # Rank of each two bytes; ``none``, above all ranks, where they are no entry.
        self.none = max(self.ranks.values(), default=0) + 1
        self.pairs = [self.ranks.get(bytes([x, y]), self.none) for x in range(256) for y in range(256)]
        self._empty()

    def _empty(self) -> None:
        # Numbers of pre-tokens met before, the ids of all in one row, and where those of each number begin. The first
        # id is no pre-token's, so the row is never empty.
        self.kept: dict[str, int] = {}
        self.kept_ids, self.kept_first = array("i", [0]), array("q", [1])

    def known(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Id of each run of bytes that is an entry, else -1."""
        hashes = hash_bytes(data, starts, lengths)
        slots = self.v.hash.slot(hashes)
        hit = np.flatnonzero((self.v.hashes[slots] == hashes) & (self.v.entries.lengths[slots] == lengths))
        sizes = lengths[hit]
        same = gather(data, starts[hit], sizes) == self.v.entries.joined(slots[hit])
        wrong = np.repeat(np.arange(len(hit)), sizes)[~same]
        ids = np.full(len(starts), -1, dtype=np.int64)
        ids[hit] = self.v.ids[slots[hit]]
        ids[hit[wrong]] = -1
        return ids

    def joined(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no entry: joins of the lowest rank first."""
        return self._joined_short(piece) if len(piece) <= SHORT else self._joined_long(piece)

    def _joined_short(self, piece: bytes) -> list[int]:
        ranks, pairs, none = self.ranks, self.pairs, self.none
        # Where each part begins, with the end of all, and the rank of each part's join with the next one.
        begins = list(range(len(piece) + 1))
        joins = [pairs[x << 8 | y] for x, y in zip(piece, piece[1:])]
        while joins and (low := min(joins)) < none:
            at = joins.index(low)
            del begins[at + 1], joins[at]
            if at < len(joins):
                joins[at] = ranks.get(piece[begins[at] : begins[at + 2]], none)
            if at:
                joins[at - 1] = ranks.get(piece[begins[at - 1] : begins[at + 1]], none)
        return [ranks[piece[x:y]] for x, y in zip(begins, begins[1:])]

    def _joined_long(self, piece: bytes) -> list[int]:
        n, ranks, pairs, none = len(piece), self.ranks, self.pairs, self.none
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # A join is one number, rank first, then start, then end: numbers compare faster than tuples.
        one = n + 1
        high = one * one
        heap = [
            r * high + i * one + i + 2 for i, (x, y) in enumerate(zip(piece, piece[1:])) if (r := pairs[x << 8 | y]) < none
        ]
        heapify(heap)
        while heap:
            start, end = divmod(heappop(heap) % high, one)
            middle = after[start]
            if middle < 0 or middle >= n or after[middle] != end:
                continue
            after[start], after[middle] = end, -1
            left = before[start]
            if left >= 0 and (r := ranks.get(piece[left:end])) is not None:
                heappush(heap, r * high + left * one + end)
            if end < n:
                before[end] = start
                if (r := ranks.get(piece[start : after[end]])) is not None:
                    heappush(heap, r * high + start * one + after[end])
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def missed(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of ids of each) of pre-tokens that are no entries."""
        if len(self.kept) >= KEPT or len(self.kept_ids) >= KEPT * KEPT_BYTES:
            self._empty()
        kept, ids, first = self.kept, self.kept_ids, self.kept_first
        numbers = np.fromiter(map(kept.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        for i in np.flatnonzero(numbers < 0).tolist():
            number = kept.get(pieces[i])
            if number is None:
                number, raw = len(first) - 1, pieces[i].encode()
                ids.extend(self.joined(raw))
                first.append(len(ids))
                if len(raw) <= KEPT_BYTES:
                    kept[pieces[i]] = number
            numbers[i] = number
        # Views of the rows end with this call: while there is one they could not grow.
        begins = np.frombuffer(first, dtype=np.int64)
        starts, sizes = begins[numbers], begins[numbers + 1] - begins[numbers]
        return gather(np.frombuffer(ids, dtype=np.int32), starts, sizes), sizes

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens, number of ids of each)."""
        raw = "".join(pieces).encode()
        data = np.frombuffer(raw, dtype=np.uint8)
        ends = offsets(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        if ends[-1] < len(raw):
            ends = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(raw))[ends]
        starts, lengths = ends[:-1], np.diff(ends)
        ids = self.known(data, starts, lengths)
        miss = np.flatnonzero(ids < 0)
        counts = np.ones(len(pieces), dtype=np.int64)
        if not len(miss):
            return ids, counts
        found, counts[miss] = self.missed([pieces[i] for i in miss.tolist()])
        out = np.repeat(ids, counts)
        out[out < 0] = found
        return out, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offset of each text's first id, one entry more)."""
        totals = np.zeros(len(texts), dtype=np.int64)
        parts, pieces, owners = [], [], []

        def flush() -> None:
            ids, counts = self.encode_pieces(pieces)
            parts.append(ids.astype(np.int32))
            ends = offsets(counts)
            rows, sizes = np.array([o[0] for o in owners]), np.array([o[1] for o in owners])
            np.add.at(totals, rows, np.diff(ends[offsets(sizes)]))
            pieces.clear()
            owners.clear()

        for row, text in enumerate(texts):
            for run in self.cutter.runs(text):
                pieces.extend(run)
                owners.append((row, len(run)))
                if len(pieces) >= RUN:
                    flush()
        if owners:
            flush()
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), offsets(totals)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for part in chunks(batch):
            yield part.column("doc_id"), pc.fill_null(part.column("text"), "").to_pylist()


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ids (an array of int) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for ids, texts in _batches(batches):
            tokens, first = encoder.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(tokens, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, lists], ["doc_id", "ids"])

    return _ids_and_texts(docs).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and bytes (binary: tokens may end inside a character) of every row of doc_id, ids; null ids count as none."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = Runs(sent.value.strings())
        for batch in batches:
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            data = strings.joined(ids).tobytes()
            ends = offsets(strings.lengths[ids])[offsets(sizes)].tolist()
            out = pa.array([data[a:b] for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(
        decoded, "doc_id long, bytes binary"
    )


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Number of tokens of every row, with digests of its ids (in decimal, joined by commas) and of their decoded bytes.

    Encoding and decoding happen in one task, so the ids of long texts need not pass through the JVM.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        strings = Runs(sent.value.strings())
        numbers = decimals(len(strings.lengths), ",")
        for doc_ids, texts in _batches(batches):
            tokens, first = encoder.encode(texts)
            listed, decoded = [], []
            for a, b in zip(first.tolist(), first[1:].tolist()):
                sha, plain = hashlib.sha256(), hashlib.sha256()
                for at in range(a, b, RUN):
                    part = tokens[at : min(b, at + RUN)]
                    plain.update(strings.joined(part))
                    text = numbers.joined(part)
                    sha.update(text if at + RUN < b else text[:-1])
                listed.append(sha.hexdigest())
                decoded.append(plain.hexdigest())
            columns = [doc_ids, pa.array(np.diff(first)), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in DIGESTS.split(", ")])

    return _ids_and_texts(docs).mapInArrow(digested, DIGESTS)
