"""Quality filter: an interpolated modified Kneser-Ney trigram model of trusted text (operator 2).

The model is trained on every document labelled as good, but for the fifth that is kept to measure by. A text is two start marks, its lower-cased words and an end. Probabilities are interpolated over three orders with
three discounts each (Chen and Goodman 1999).

In back-off form the log probability of a text is a plain sum over its n-grams: with ``bo(h) = log lambda(h)``,

- a word adds ``log P(w) + bo(w)``, an unknown one ``log(lambda / (V + 1))``;
- a known bigram adds ``log P(w|v) - bo(v) - log P(w) + bo(vw)``;
- a known trigram adds ``log P(w|uv) - bo(uv) - log P(w|v)``.

So an n-gram's value needs nothing but counts of n-grams that have its middle word, and the value of its last word. No table of
all n-grams is kept. Texts are read again for each part of the work, and their words, as places in a short list of hashes,
go to shards of a bounded number of words:

- A first reading counts words by slots of their hashes. Slots are dealt into shards; one that is too large for a shard is
  split by the other word of the pair.
- Trusted texts go to shards of their last words, where each trigram, bigram and word is counted whole: discounts, values of
  words, and bigrams of those middle words that are split later.
- All texts go to shards of their middle words. There the values of a shard's n-grams are found from its trusted texts and
  looked up for all, and sums per text return. Of words, at most ``table`` frequent ones are known to every task; others that
  a bitmap of the model may hold are joined once and sent along.

Each step is done in ``rounds`` over disjoint shards, and Spark is told to remove a round's shuffle files when it ends: so
disk is bounded by the largest round, and the number of readings is a constant. The driver gets counts of slots, frequent
words and a bitmap, all of fixed size, and eight bytes for each trusted id. A text is known by a 64-bit hash while its sums
are under way, so rows of equal text have equal values.

A document stays if its perplexity is at most the ``quantile`` of trusted documents of its language; languages without
such take the quantile of all of them. Quantiles cover every trusted document of the fifth that is kept from training.

Edge cases: null text counts as empty (its end is scored); a null language is a language of its own; without trusted text
every document stays with a null threshold; repeated rows and null ids keep their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbump.llm.tables import written
from fleetbump.llm.words import chunks, mix, words_of
from fleetbump.session import shuffles_removed

_U = np.uint64
_START, _END = _U(0x5354415254), _U(0x454E44)

# Slots that words are counted by, as leading bits of their hashes.
_SLOT_BITS = 16
# Words that a task gathers for a round before it sends them, and texts whose sums meet in a task.
_GATHERED, _TEXTS = 1 << 19, 1 << 15
# Words up to which one round is enough, and the least that make a shard.
_ROUND, _LEAST = 1 << 21, 1 << 12


@dataclass(frozen=True)
class Settings:
    table: int = 400_000
    quantile: float = 0.97
    bitmap_bits: int = 26
    shard: int = 1 << 20
    rounds: int = 4


def _places(part: pa.Array):
    """(row, word two before, word before, word) of every word and end, words as hashes."""
    words = words_of(part)
    n = len(words.first) - 1
    rows = words.rows()
    sizes = np.diff(words.first) + 3
    begins = np.append(0, np.cumsum(sizes))
    padded = np.full(begins[-1], _START, dtype=_U)
    padded[np.arange(len(rows)) + 3 * rows + 2] = words.hashes
    padded[begins[1:] - 1] = _END
    at = np.flatnonzero(np.arange(len(padded)) - np.repeat(begins[:-1], sizes) >= 2)
    return np.repeat(np.arange(n), sizes - 2), padded[at - 2], padded[at - 1], padded[at]


def _word(w: np.ndarray) -> np.ndarray:
    return mix(w ^ _U(1))


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v) + w * _U(3))


def _triple(uv: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(uv) + w * _U(5))


def _slot(words: np.ndarray) -> np.ndarray:
    return (words >> _U(64 - _SLOT_BITS)).astype(np.int64)


def _held(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked key stands among sorted ``keys``, and whether it does."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), dtype=bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _value(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each asked key, 0 where sorted ``keys`` lack it."""
    at, held = _held(keys, asked)
    return np.where(held, values[at], 0.0) if len(keys) else np.zeros(len(asked))


def _packed(values: np.ndarray) -> bytes:
    """An array of one to eight bytes a value: size and length, then the first bytes of all, the second ones and so on."""
    if values.dtype == np.int64:
        values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T)
    return bytes([size]) + len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The arrays of a column of ``_packed`` ones, as unsigned numbers."""
    out = []
    for blob in column:
        data = blob.as_buffer()
        size, n = data[0], int.from_bytes(data[1:9].to_pybytes(), "little")
        planes = np.frombuffer(pa.decompress(data[9:], size * n, codec="zstd"), np.uint8).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(n))
    return out


def _joined(arrays: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(a.view(kind) if a.itemsize == 8 else a.astype(kind) for a in arrays)])


_SHARED = ["common", "words", "u", "v", "w"]


def _unmixed(x: np.ndarray) -> np.ndarray:
    """What ``mix`` made ``x`` of."""
    x = (x ^ (x >> _U(31)) ^ (x >> _U(62))) * _U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = (x ^ (x >> _U(27)) ^ (x >> _U(54))) * _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> _U(30)) ^ (x >> _U(60))


def _sent(common: np.ndarray, *places: np.ndarray) -> list[bytes]:
    """Words as places in a list of different ones: steps in sorted ``common`` words, then hashes of others."""
    coded = pa.array(np.concatenate(places)).dictionary_encode()
    words = coded.dictionary.to_numpy()
    at, held = _held(common, words)
    order = np.argsort(np.where(held, at, len(common)), kind="stable")
    n = np.count_nonzero(held)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    codes = place[coded.indices.to_numpy()]
    return [_packed(np.diff(at[order[:n]], prepend=0)), _packed(words[order[n:]]), *map(_packed, np.split(codes, len(places)))]


def _received(rows: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray], list[list[np.ndarray]]]:
    """Lists of each row made by ``_sent``: numbers of common words, hashes of others, and places of ``u, v, w`` in both."""
    steps, words, *places = (_unpacked(rows.column(c)) for c in _SHARED)
    return [np.cumsum(x, dtype=np.int64) for x in steps], words, places


def _placed(lists: list[np.ndarray], places: list[np.ndarray], kind: type = _U) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(x[at] for x, at in zip(lists, places, strict=True))])


def _read(rows: pa.RecordBatch, common: np.ndarray) -> list[np.ndarray]:
    """``u, v, w`` of rows made by ``_sent``."""
    numbers, others, places = _received(rows)
    lists = [np.concatenate([common[x], y]) for x, y in zip(numbers, others, strict=True)]
    return [_placed(lists, at) for at in places]


def _some(rows: pa.Table, column: str) -> list[pa.RecordBatch]:
    """The rows that have ``column``, a few words' worth at once."""
    rows = rows.filter(rows.column(column).is_valid())
    return [part for batch in rows.to_batches() for part in chunks(batch, *_SHARED)]


def _merged(met: Iterator[list[np.ndarray]]) -> list[np.ndarray]:
    """``u, v, w`` of different trigrams and how often they were met in all of ``met``, in the order of their hashes."""

    def merged():
        u, v, w, n = map(np.concatenate, zip(*held, strict=True))
        _, first, at = np.unique(_triple(_pair(u, v), w), return_index=True, return_inverse=True)
        return [u[first], v[first], w[first], np.bincount(at, n, len(first)).astype(np.int64)]

    held, size = [[np.zeros(0, _U)] * 3 + [np.zeros(0, np.int64)]], 0
    for one in met:
        held.append(one)
        size += len(one[0])
        if size >= _GATHERED:
            held, size = [merged()], 0
    return merged()


def _borders(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def _runs(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each different key with the places where it stands, in order."""
    order = np.argsort(keys.astype(np.uint16) if len(keys) and keys.max() < 1 << 16 else keys, kind="stable")
    borders = _borders(keys[order])
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        yield int(keys[order[a]]), order[a:b]


@dataclass(frozen=True)
class Plan:
    """Shards of slots. Slot ``s`` has ``parts[s]`` shards from ``first[s]`` on; small slots share one."""

    first: np.ndarray
    parts: np.ndarray
    rounds: int

    @classmethod
    def of(cls, counts: np.ndarray, size: int, rounds: int) -> Plan:
        parts = np.maximum(-(-counts // size), 1)
        small = np.where(parts == 1, counts, 0)
        shared = (np.cumsum(small) - small) // size
        own = np.where(parts == 1, 0, parts)
        return cls(np.where(parts == 1, shared, shared[-1] + 1 + np.cumsum(own) - own), parts, rounds)

    def shard(self, words: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The shard of each word; that of a split slot goes by the other word too."""
        slot = _slot(words)
        out, parts = self.first[slot], self.parts[slot]
        split = np.flatnonzero(parts > 1)
        out[split] += (mix(others[split]) % parts[split].astype(_U)).astype(np.int64)
        return out


def _chosen(part: pa.RecordBatch, ids: np.ndarray) -> np.ndarray:
    """Whether each row is one of the documents to train on."""
    own = part.column("doc_id")
    valid = own.is_valid().to_numpy(zero_copy_only=False)
    return valid & _held(ids, own.fill_null(0).to_numpy())[1]


def _slots(ids: np.ndarray):
    """Words before a word in all texts, and words in trusted ones, by slot; at slot -1 numbers of texts."""

    def count(batches):
        seen, texts = np.zeros((2, 1 << _SLOT_BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for part in chunks(batch):
                row, _, v, w = _places(part.column("text"))
                chosen = _chosen(part, ids)
                seen[0] += np.bincount(_slot(v), minlength=1 << _SLOT_BITS)
                seen[1] += np.bincount(_slot(w[chosen[row]]), minlength=1 << _SLOT_BITS)
                texts += part.num_rows, chosen.sum()
        at = np.flatnonzero(seen.any(axis=0))
        columns = [np.append(at, -1), *(np.append(n[at], t) for n, t in zip(seen, texts, strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "middle", "last"])

    return count


def _trusted_words(plan: Plan, turn: int, ids: np.ndarray):
    """Trigrams of trusted texts and how often they were met, for the shards of a round, by last word."""

    def rows(u, v, w):
        _, first, n = np.unique(_triple(_pair(u, v), w), return_index=True, return_counts=True)
        first, n = (x[np.argsort(first)] for x in (first, n))
        none = np.zeros(0, _U)
        u, v, w = u[first], v[first], w[first]
        found = [(shard, *_sent(none, u[at], v[at], w[at]), _packed(n[at])) for shard, at in _runs(plan.shard(w, v))]
        return pa.RecordBatch.from_pylist([dict(zip(["shard", *_SHARED, "n"], row, strict=True)) for row in found], _COUNTED)

    def deal(batches):
        held, size = [], 0
        for batch in batches:
            for part in chunks(batch):
                part = part.filter(pa.array(_chosen(part, ids)))
                _, u, v, w = _places(part.column("text"))
                mine = plan.shard(w, v) % plan.rounds == turn
                held.append((u[mine], v[mine], w[mine]))
                size += len(held[-1][0])
                if size >= _GATHERED:
                    yield rows(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield rows(*map(np.concatenate, zip(*held, strict=True)))

    return deal


_COUNTED = pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in [*_SHARED, "n"])])
_COUNTED_SQL = "shard long, common binary, words binary, u binary, v binary, w binary, n binary"
_COUNTS = "slot long, v binary, w binary, n binary, seen binary, pairs array<long>, triples array<long>"


def _counted(middle: Plan):
    """Counts of a shard: its words, how many n-grams have one to four, and the pairs of slots that ``middle`` splits."""

    def count(rows: pa.Table) -> pa.Table:
        none = np.zeros(0, _U)
        _, v, w, triples = _merged([*_read(part, none), _joined(_unpacked(part.column("n")))] for part in _some(rows, "w"))
        _, first, at, pairs = np.unique(_pair(v, w), return_index=True, return_inverse=True, return_counts=True)
        seen = np.bincount(at, triples).astype(np.int64)
        v, w = v[first], w[first]
        words, at, before = np.unique(w, return_inverse=True, return_counts=True)
        numbers = [np.bincount(np.minimum(x, 5), minlength=6)[1:5].tolist() for x in (pairs, triples)]
        seen = np.bincount(at, seen).astype(np.int64)
        found = [(-1, None, _packed(words), _packed(before), _packed(seen), *numbers)]
        split = np.flatnonzero(middle.parts[_slot(v)] > 1)
        for slot, at in _runs(_slot(v[split])):
            found.append((slot, *(_packed(x[split[at]]) for x in (v, w, pairs)), None, None, None))
        kinds = [pa.int64(), *[pa.binary()] * 4, *[pa.list_(pa.int64())] * 2]
        names = [x.split()[0] for x in _COUNTS.split(", ")]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return count


def _unigrams(batches):
    for batch in batches:
        columns = [_unpacked(batch.column(c)) for c in ("w", "n", "seen")]
        for words, *counts in zip(*columns, strict=True):
            arrays = [pa.array(_word(words).view(np.int64)), *(pa.array(x.astype(np.int64)) for x in counts)]
            yield pa.RecordBatch.from_arrays(arrays, ["ngram", "n", "seen"])


def _discounts(found) -> list[float]:
    """D1, D2 and D3+ of an order, from how many n-grams have counts of one to four."""
    n1, n2, n3, n4 = (float(x or 0) for x in found)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    ratios = (2 * y * n2 / n1 if n1 else 0.5, 3 * y * n3 / n2 if n2 else 0.5, 4 * y * n4 / n3 if n3 else 0.5)
    # Small samples can leave the range in which all discounts are positive and below their counts.
    return [min(max(i - r, 0.1), i - 0.1) for i, r in zip((1, 2, 3), ratios, strict=True)]


def _discount(n: str, d: list[float]):
    return F.when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])


def measured(doc_id: Column) -> Column:
    """Whether a trusted document is kept from training, to measure perplexities by: one in five."""
    return F.pmod(F.xxhash64(doc_id), F.lit(5)) == 0


def _trusted(labels: DataFrame) -> DataFrame:
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
    return good.select(F.col("doc_id").cast("long").alias("id")).distinct()


@dataclass(frozen=True)
class Model:
    """What all shards need: the plan by middle words, ids, frequent words, discounts; and tables of which each gets its own."""

    plan: Plan
    ids: np.ndarray
    common: np.ndarray
    values: np.ndarray
    pairs: list[float]
    triples: list[float]
    unknown: float
    texts: int
    words: DataFrame
    split: DataFrame
    rare: DataFrame | None


def _in_rounds(rounds: int, made: Callable[[int], DataFrame], name: str) -> DataFrame:
    """The tables of all rounds in one; each is written before the next is begun."""
    return reduce(DataFrame.unionByName, [written(made(turn), name) for turn in range(rounds)])


def _rare_words(plan: Plan, common: np.ndarray, bits: np.ndarray, shift: int):
    """Words that are not among the frequent ones but may be in the model, and the shards that meet them."""

    def scan(batches):
        for batch in batches:
            for part in chunks(batch):
                _, u, v, w = _places(part.column("text"))
                word = _word(w)
                slot = (word >> _U(shift)).astype(np.int64)
                maybe = np.flatnonzero((bits[slot >> 6] >> (slot & 63).astype(_U)) & _U(1))
                maybe = maybe[~_held(common, w[maybe])[1]]
                word, shard = word[maybe], plan.shard(v[maybe], u[maybe])
                _, first = np.unique(mix(word + shard.astype(_U)), return_index=True)
                arrays = [pa.array(word[first].view(np.int64)), pa.array(shard[first])]
                yield pa.RecordBatch.from_arrays(arrays, ["ngram", "shard"])

    return scan


def _slim(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64(text).alias("key"), "text")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """What is known of the trusted texts before the n-grams of a shard are valued; None without text."""
    s, spark = settings, docs.sparkSession
    texts = _slim(docs).select("doc_id", "text")
    ids = np.sort(_trusted(labels).where(~measured(F.col("id"))).toArrow().column("id").to_numpy())
    slots = texts.mapInArrow(_slots(ids), "slot long, middle long, last long").groupBy("slot")
    slots = slots.agg(F.sum("middle").alias("middle"), F.sum("last").alias("last")).toArrow()
    slot, *counts = (slots.column(c).to_numpy() for c in ("slot", "middle", "last"))
    if not sum(counts[1]):
        return None
    texts_met = int(counts[0][slot < 0].sum())
    middle, last = (np.bincount(slot[slot >= 0], n[slot >= 0], 1 << _SLOT_BITS).astype(np.int64) for n in counts)
    total = int(middle.sum())
    rounds = s.rounds if total > _ROUND else 1
    tasks = 2 * spark.sparkContext.defaultParallelism

    def planned(counts: np.ndarray, rounds: int) -> Plan:
        size = min(s.shard, max(_LEAST, int(counts.sum()) // (rounds * tasks) + 1))
        return Plan.of(counts, size, rounds)

    plan = planned(middle, rounds)
    by_last = planned(last, -(-rounds * int(last.sum()) // total))

    def counted(turn: int) -> DataFrame:
        dealt = texts.mapInArrow(_trusted_words(by_last, turn, ids), _COUNTED_SQL)
        return dealt.groupBy("shard").applyInArrow(_counted(plan), _COUNTS)

    found = _in_rounds(by_last.rounds, counted, "counts")
    whole = found.where("slot < 0")
    uni = whole.select("w", "n", "seen").mapInArrow(_unigrams, "ngram long, n long, seen long")
    uni = written(uni.groupBy("ngram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "unigrams")
    one_to_four = [F.sum(F.col(c)[i]) for c in ("pairs", "triples") for i in range(4)]
    numbers = whole.agg(*one_to_four).first()
    size = uni.agg(F.count("*"), F.sum("n")).first()
    d1 = _discounts(uni.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in range(1, 5)]).first())
    left = uni.agg(F.sum(_discount("n", d1))).first()[0] / size[1]
    unknown = left / (size[0] + 1)
    value = F.log10((F.col("n") - _discount("n", d1)) / size[1] + unknown) - float(np.log10(unknown))
    words = uni.select("ngram", value.alias("value"), "seen")
    known, values = _frequent(words, s.table)
    common = _unmixed(known) ^ _U(1)
    order = np.argsort(common)
    common, values = common[order], values[order]
    rare = None
    if len(common) < size[0]:
        scan = _rare_words(plan, common, _bitmap(words, s.bitmap_bits), 64 - s.bitmap_bits)
        rare = texts.mapInArrow(scan, "ngram long, shard long").join(words.select("ngram", "value"), "ngram")
        rare = written(rare, "rare")
    split = found.where("slot >= 0").select("slot", "v", "w", "n")
    discounts = _discounts(numbers[:4]), _discounts(numbers[4:])
    return Model(plan, ids, common, values, *discounts, float(np.log10(unknown)), texts_met, words, split, rare)


_BLOBS = [*_SHARED, "text", "chosen", "keys", "n"]
_SHARD = pa.schema(
    [("shard", pa.int64()), ("batch", pa.int64()), *((c, pa.binary()) for c in _BLOBS), ("ngram", pa.int64()), ("value", pa.float64())]
)
_SHARD_SQL = f"shard long, batch long, {', '.join(f'{c} binary' for c in _BLOBS)}, ngram long, value double"


def _all_words(plan: Plan, turn: int, ids: np.ndarray, common: np.ndarray):
    """Every word of all texts with the two before it and its text, for the shards of a round, by middle word.

    A text is its place in a batch; the keys of a batch's texts go with one of its rows. Batches are known by their keys.
    """

    def rows(held):
        u, v, w, text, chosen, keys = map(np.concatenate, zip(*held, strict=True))
        batch = int(np.bitwise_xor.reduce(mix(keys + mix(np.arange(len(keys), dtype=_U)))).view(np.int64))
        found = []
        for shard, at in _runs(plan.shard(v, u)):
            found.append({"shard": shard, "batch": batch, **dict(zip(_SHARED, _sent(common, u[at], v[at], w[at]), strict=True))})
            found[-1] |= {"text": _packed(np.diff(text[at], prepend=0)), "chosen": _packed(chosen[at])}
        found[0]["keys"] = _packed(keys)
        return pa.RecordBatch.from_pylist(found, _SHARD)

    def deal(batches):
        held, size, texts = [], 0, 0
        for batch in batches:
            for part in chunks(batch):
                row, u, v, w = _places(part.column("text"))
                mine = np.flatnonzero(plan.shard(v, u) % plan.rounds == turn)
                text, keys = row[mine], part.column("key").to_numpy().view(_U)
                held.append((u[mine], v[mine], w[mine], text + texts, _chosen(part, ids)[text].view(np.uint8), keys))
                size, texts = size + len(mine), texts + part.num_rows
                if max(size, texts) >= _GATHERED:
                    if size:
                        yield rows(held)
                    held, size, texts = [], 0, 0
        if size:
            yield rows(held)

    return deal


def _split_pairs(plan: Plan, turn: int):
    """Pairs of split slots, once for each of the slot's shards of a round."""

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                first, parts = (int(x[row["slot"]]) for x in (plan.first, plan.parts))
                for shard in range(first, first + parts):
                    if shard % plan.rounds == turn:
                        yield pa.RecordBatch.from_pylist([{"shard": shard, "v": row["v"], "w": row["w"], "n": row["n"]}], _SHARD)

    return deal


def _dealt(docs: DataFrame, model: Model, turn: int) -> DataFrame:
    """All that the shards of a round are valued by."""
    texts = _slim(docs).select("doc_id", "key", "text").mapInArrow(
        _all_words(model.plan, turn, model.ids, model.common), _SHARD_SQL
    )
    dealt = texts.unionByName(model.split.mapInArrow(_split_pairs(model.plan, turn), _SHARD_SQL))
    if model.rare is not None:
        own = model.rare.where(F.col("shard") % model.plan.rounds == turn)
        dealt = dealt.unionByName(own.select("shard", "ngram", "value"), allowMissingColumns=True)
    return dealt


class _Shard:
    """Words of a shard and the values of its n-grams, from those of its words that stand in trusted texts."""

    def __init__(self, rows: pa.Table, common: np.ndarray, values: np.ndarray, pairs: list[float], triples: list[float], unknown: float):
        self.common, self.values, self.unknown = common, values, unknown
        rare = rows.filter(rows.column("ngram").is_valid())
        self.rare, first = np.unique(_unmixed(rare.column("ngram").to_numpy().view(_U)) ^ _U(1), return_index=True)
        self.rare_values = rare.column("value").to_numpy()[first]
        split = rows.filter(rows.column("n").is_valid())
        self.parts = _some(rows, "text")
        self._train(*_merged(map(self._trusted, self.parts)), split, pairs, triples)

    def _trusted(self, part: pa.RecordBatch) -> list[np.ndarray]:
        chosen = np.flatnonzero(_joined(_unpacked(part.column("chosen"))))
        return [*(x[chosen] for x in _read(part, self.common)), np.ones(len(chosen), np.int64)]

    def word(self, w: np.ndarray) -> np.ndarray:
        """log10 P(w) over that of an unknown word."""
        return _value(self.common, self.values, w) + _value(self.rare, self.rare_values, w)

    def _train(self, u, v, w, n3, split: pa.Table, d2: list[float], d3: list[float]) -> None:
        uv, vw = _pair(u, v), _pair(v, w)
        self.triples, self.triples_seen = _triple(uv, w), n3
        self.pairs, first, n2 = np.unique(vw, return_index=True, return_counts=True)
        v, w = v[first], w[first]
        if split.num_rows:
            # Other shards have texts of these pairs too: here are all pairs of the slot, counted over all shards.
            v, w, n2 = (_joined(_unpacked(split.column(c)), kind) for c, kind in (("v", _U), ("w", _U), ("n", np.int64)))
            self.pairs, first = np.unique(_pair(v, w), return_index=True)
            v, w, n2 = v[first], w[first], n2[first]
        pair = np.searchsorted(self.pairs, vw)
        self.pairs_seen = np.bincount(pair, n3, len(self.pairs)).astype(np.int64)
        self.words, at = np.unique(v, return_inverse=True)
        self.off_word, p2 = _spread(at, n2, d2)
        word = self.word(w)
        p2 += np.power(10.0, self.off_word[at] + word + self.unknown)
        self.contexts, before = np.unique(uv, return_inverse=True)
        self.off_context, p3 = _spread(before, n3, d3)
        p3 += np.power(10.0, self.off_context[before]) * p2[pair]
        self.pair_values = np.log10(p2) - self.off_word[at] - word - self.unknown
        self.triple_values = np.log10(p3) - self.off_context[before] - np.log10(p2)[pair]

    def scores(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of each word after the two before it, over that of an unknown word; and whether it is an end."""
        numbers, others, places = _received(part)
        known = [np.concatenate([self.values[x], _value(self.rare, self.rare_values, y)]) for x, y in zip(numbers, others, strict=True)]
        out = _placed(known, places[2], np.float64)
        u, v, w = _read(part, self.common)
        uv = _pair(u, v)
        out += _value(self.words, self.off_word, v) + _value(self.pairs, self.pair_values, _pair(v, w))
        out += _value(self.contexts, self.off_context, uv) + _value(self.triples, self.triple_values, _triple(uv, w))
        return out, w == _END


def _spread(context: np.ndarray, n: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the left-over weight of each context, and the discounted share of each n-gram in its context."""
    off = np.array(d)[np.minimum(n, 3) - 1]
    total = np.bincount(context, n)
    return np.log10(np.bincount(context, off) / total), (n - off) / total[context]


def _shard_maker(model: Model):
    fixed = model.common, model.values, model.pairs, model.triples, model.unknown
    return lambda rows: _Shard(rows, *fixed)


_SUMS = "part long, batch long, text binary, sums binary, n binary, ends binary, keys binary"


def _judged(model: Model):
    """Sums of a shard's words by text, for each batch of texts, in parts of batches."""
    make, parts = _shard_maker(model), -(-model.texts // _TEXTS)

    def judge(rows: pa.Table) -> pa.Table:
        shard, found = make(rows), []
        for part in shard.parts:
            scores, ends = shard.scores(part)
            begin = 0
            for steps, batch, keys in zip(_unpacked(part.column("text")), *map(part.column, ("batch", "keys")), strict=True):
                texts, at = np.unique(np.cumsum(steps, dtype=np.int64), return_inverse=True)
                own, batch = slice(begin, begin + len(at)), batch.as_py()
                begin += len(at)
                sums = [np.bincount(at, scores[own]), np.bincount(at), np.bincount(at, ends[own]).astype(np.int64)]
                found.append((batch % parts, batch, _packed(np.diff(texts, prepend=0)), *map(_packed, sums), keys.as_py()))
        kinds, names = [pa.int64(), pa.int64(), *[pa.binary()] * 5], [x.split()[0] for x in _SUMS.split(", ")]
        columns = zip(*found, strict=True) if found else [[]] * 7
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    return judge


def _added(rows: pa.Table) -> pa.Table:
    """Sums of the texts of some batches. Batches of the same keys hold the same texts, and are summed up together."""
    listed = rows.filter(rows.column("keys").is_valid())
    keys = dict(zip(listed.column("batch").to_pylist(), _unpacked(listed.column("keys")), strict=True))
    sums = {batch: np.zeros((3, len(own))) for batch, own in keys.items()}
    columns = [_unpacked(rows.column(c)) for c in ("text", "sums", "n", "ends")]
    for batch, steps, value, *counts in zip(rows.column("batch").to_pylist(), *columns, strict=True):
        sums[batch][:, np.cumsum(steps, dtype=np.int64)] += [value.view(np.float64), *counts]
    value, n, ends = np.concatenate([np.zeros((3, 0)), *sums.values()], axis=1)
    arrays = [_joined(list(keys.values()), _U).view(np.int64), value, n.astype(np.int64), ends.astype(np.int64)]
    return pa.Table.from_arrays([pa.array(x) for x in arrays], ["key", "value", "n", "ends"])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, float, float] | None:
    """(table of n-gram, value, n; value of an unknown word; sum that every text begins with); None without text.

    The whole model as one table, which takes far more disk than ``perplexities``, where its shards are used and dropped.
    """
    with shuffles_removed(docs.sparkSession):
        model = fit(docs, labels, settings)
        if model is None:
            return None
        make = _shard_maker(model)

        def rows(rows: pa.Table) -> pa.Table:
            s = make(rows)
            # All shards of a split slot know its pairs: one row comes from each that has the pair in its texts.
            own = s.pairs_seen > 0
            tables = [
                (s.triples, s.triple_values, None, s.triples_seen),
                (s.pairs[own], s.pair_values[own], None, s.pairs_seen[own]),
                (s.contexts, None, s.off_context, None),
                (_word(s.words), None, s.off_word, None),
            ]
            kinds = {"ngram": pa.int64(), "own": pa.float64(), "off": pa.float64(), "seen": pa.int64()}

            def column(x, n, kind):
                return pa.nulls(n, kind) if x is None else pa.array(x.view(np.int64) if x.dtype == _U else x, kind)

            return pa.concat_tables(
                pa.table({c: column(x, len(t[0]), k) for x, (c, k) in zip(t, kinds.items(), strict=True)}) for t in tables
            )

        found = model.words.select("ngram", F.col("value").alias("own"), F.lit(None).cast("double").alias("off"), "seen")
        for turn in range(model.plan.rounds):
            dealt = _dealt(docs, model, turn).groupBy("shard")
            found = found.unionByName(dealt.applyInArrow(rows, "ngram long, own double, off double, seen long"))
        sums = found.groupBy("ngram").agg(F.max("own").alias("own"), F.max("off").alias("off"), F.sum("seen").alias("seen"))
        sums = written(sums, "model")
        # What precedes the first word is the same in every text.
        start = np.array([_START])
        before = [int(x[0].astype(np.int64)) for x in (_word(start), _pair(start, start))]
        begin = sums.where(F.col("ngram").isin(before)).agg(F.sum("off")).first()[0]
        value = F.col("own") + F.coalesce("off", F.lit(0.0))
        return sums.where("own IS NOT NULL").select("ngram", value.alias("value"), "seen"), model.unknown, float(begin or 0)


def _frequent(model: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams and their values of those seen most often: all down to the count at which they are still ``most``."""
    # There are far fewer different counts than n-grams: their sum is at most three times the words.
    sizes = model.groupBy("seen").agg(F.count("*").alias("size")).toArrow()
    seen, size = (sizes.column(c).to_numpy() for c in ("seen", "size"))
    order = np.argsort(-seen)
    fit = np.flatnonzero(np.cumsum(size[order]) <= most)
    if not len(fit):
        return np.zeros(0, _U), np.zeros(0)
    top = model.where(F.col("seen") >= int(seen[order[fit[-1]]])).select("ngram", "value").toArrow()
    keys, values = top.column("ngram").to_numpy().view(_U), top.column("value").to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def _bitmap(model: DataFrame, bits: int) -> np.ndarray:
    """Bits of the model's n-grams by their leading ``bits`` bits, in words of 64 made by an aggregate."""
    slot = F.shiftrightunsigned("ngram", 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    words = model.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(max(1 << bits >> 6, 1), dtype=_U)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(_U)
    return out


def perplexities(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, n_tokens, log10_prob, perplexity (null without trusted text)."""
    slim = _slim(docs).drop("text")
    with shuffles_removed(docs.sparkSession):
        model = fit(docs, labels, settings)
        if model is None:
            none = F.lit(None).cast("double")
            return slim.select("doc_id", "lang", F.lit(None).cast("long").alias("n_tokens"), none.alias("log10_prob"), none.alias("perplexity"))

        def summed(turn: int) -> DataFrame:
            judged = _dealt(docs, model, turn).groupBy("shard").applyInArrow(_judged(model), _SUMS)
            return judged.groupBy("part").applyInArrow(_added, "key long, value double, n long, ends long")

        sums = _in_rounds(model.plan.rounds, summed, "sums")
    sums = sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("value", "n", "ends")])
    # Every text has one end: equal texts were summed up together.
    n_tokens = (F.col("n") / F.col("ends")).cast("long")
    found = slim.join(sums, "key", "left").withColumn("n_tokens", n_tokens)
    log = F.col("value") / F.col("ends") + F.col("n_tokens") * model.unknown
    return found.select("doc_id", "lang", "n_tokens", log.alias("log10_prob")).withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens"))
    )


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``perplexities`` with the threshold of the document's language and whether it stays."""
    told = perplexities(docs, labels, settings)
    with shuffles_removed(docs.sparkSession):
        told = written(told, "perplexities")
    good = _trusted(labels).where(measured(F.col("id")))
    trusted = told.join(good, F.col("doc_id") == F.col("id"), "left_semi")
    quantile = F.percentile_approx("perplexity", settings.quantile, 10_000)
    by_language = trusted.groupBy("lang").agg(quantile.alias("threshold")).withColumnRenamed("lang", "of")
    overall = F.lit(trusted.agg(quantile).first()[0]).cast("double")
    found = told.join(by_language, F.col("lang").eqNullSafe(F.col("of")), "left")
    found = found.withColumn("threshold", F.coalesce("threshold", overall)).drop("of")
    return found.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
