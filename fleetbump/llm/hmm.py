"""Hidden Markov language model of whole texts (operator 8).

Tokens are the lower-cased words of a text and one end. The model emits word classes: the ``own`` most frequent training
words have a class each, the end has one, all other words share ``shapes`` classes by a hash of their last two bytes and
length. Within a class a word has the probability ``(c + 0.5) / (C + 0.5 * (V + 1))`` of its training count, so the
probability of a text is that of its class sequence times that of its words given their classes.

1. Training words are counted: partial counts for each block of words, one aggregate; the table grows with the corpus and
   is only ever joined. The ``table`` most frequent words, a fixed number, are sent to the executors.
2. One scan turns every text into its class sequence, its sums over frequent words, and the list of its other words.
3. Baum-Welch: each task adds up the expected counts of its training sequences by scaled forward and backward recursion;
   states times classes counts, a fixed number, are summed over tasks. The first values come from some rounds on at most
   ``warm`` sequences; the rounds after that run over all of them.
4. Every text's sequence likelihood is computed exactly by the scaled forward recursion; the counts of rare words reach
   their texts by an equi-join on the word.

Words are known by 64-bit hashes. Edge cases: null text counts as empty, so it is one end token; without training texts
every class is equally likely and no token is known; null ids are never held out; repeated rows keep their rows, and a
row that repeats counts as often in training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbump.llm.tables import written
from fleetbump.llm.words import Words, chunks, mix, words_of

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    states: int = 8
    own: int = 4000
    shapes: int = 1024
    table: int = 200_000
    warm: int = 1000
    warm_rounds: int = 8
    rounds: int = 2
    prior: float = 50.0
    seed: int = 8
    # Tokens of the sequences that are worked on side by side.
    tokens: int = 1_500_000


END = 0
BLOCK_WORDS = 2_000_000


@dataclass
class Model:
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # states x classes


@dataclass
class Vocabulary:
    """Bounded tables: the most frequent words, and the denominators of the shared classes."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray  # of each word; 0 where it has none of its own
    shape_counts: np.ndarray
    shape_sizes: np.ndarray
    ends: int
    total: int
    distinct: int


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def shapes_of(words: Words, n: int) -> np.ndarray:
    """The shared class of each word, from 0."""
    size = np.minimum(words.ends - words.starts, 12)
    last = words.data[words.ends - 1].astype(_U)
    before = np.where(size > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(_U)
    return (mix(last | before << _U(8) | size.astype(_U) << _U(16)) % _U(n)).astype(np.int64)


def _counter(s: Settings):
    def count(batches):
        """Partial (word, shape, n) of blocks; the word -1, shape -1 counts ends."""
        held, kinds, size, ends = [], [], 0, 0

        def block():
            hashes, first, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(np.concatenate(kinds)[first].astype(np.int64)), pa.array(n)],
                ["word", "shape", "n"],
            )

        for batch in batches:
            for part in chunks(batch):
                words = words_of(part.column("text"))
                held.append(words.hashes)
                kinds.append(shapes_of(words, s.shapes).astype(np.int16))
                size += len(words.hashes)
                ends += part.num_rows
                if size >= BLOCK_WORDS:
                    yield block()
                    held, kinds, size = [], [], 0
        if held:
            yield block()
        one = [pa.array([x], pa.int64()) for x in (-1, -1, ends)]
        yield pa.RecordBatch.from_arrays(one, ["word", "shape", "n"])

    return count


def count_words(docs: DataFrame, s: Settings) -> DataFrame:
    """Training counts: word, shape, n; ends have the shape -1."""
    counts = docs.where(~held_out(F.col("doc_id"))).select("text")
    counts = counts.mapInArrow(_counter(s), "word long, shape long, n long")
    return written(counts.groupBy("word", "shape").agg(F.sum("n").alias("n")).where("n > 0"), "counts")


def vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    words = counts.where("shape >= 0")
    top = words.orderBy(F.desc("n"), "word").limit(s.table).toPandas()
    # At most `shapes` + 1 rows.
    sums = counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    shape_counts, shape_sizes = np.zeros(s.shapes), np.zeros(s.shapes)
    for r in sums:
        if r["shape"] >= 0:
            shape_counts[r["shape"]], shape_sizes[r["shape"]] = r["n"], r["v"]
    mine = top[: s.own]
    np.subtract.at(shape_counts, mine["shape"].to_numpy(dtype=np.int64), mine["n"].to_numpy(dtype=np.float64))
    np.subtract.at(shape_sizes, mine["shape"].to_numpy(dtype=np.int64), 1)
    top["class"] = np.where(np.arange(len(top)) < s.own, np.arange(len(top)) + 1, 0)
    top["hash"] = top["word"].to_numpy(dtype=np.int64).view(_U)
    top = top.sort_values("hash")
    return Vocabulary(
        words=top["hash"].to_numpy(dtype=_U),
        counts=top["n"].to_numpy(dtype=np.float64),
        classes=top["class"].to_numpy(dtype=np.int64),
        shape_counts=shape_counts,
        shape_sizes=shape_sizes,
        ends=sum(r["n"] for r in sums if r["shape"] < 0),
        total=sum(r["n"] for r in sums),
        distinct=sum(r["v"] for r in sums),
    )


def class_weights(v: Vocabulary, s: Settings) -> np.ndarray:
    """Share of each class among training tokens, each counted half a time more."""
    own = np.zeros(s.own)
    own[v.classes[v.classes > 0] - 1] = v.counts[v.classes > 0]
    all_ = np.concatenate([[v.ends], own, v.shape_counts]) + 0.5
    return all_ / all_.sum()


def _encoder(v: Vocabulary, s: Settings):
    inner = np.log10(v.shape_counts + 0.5 * (v.shape_sizes + 1))
    known_end = v.ends > 0

    def encode(batches):
        for batch in batches:
            for part in chunks(batch):
                words = words_of(part.column("text"))
                rows, n = words.rows(), part.num_rows
                count, kind = np.zeros(len(rows)), np.zeros(len(rows), dtype=np.int64)
                listed = np.zeros(len(rows), dtype=bool)
                if len(v.words):
                    at = np.minimum(np.searchsorted(v.words, words.hashes), len(v.words) - 1)
                    listed = v.words[at] == words.hashes
                    count[listed], kind[listed] = v.counts[at[listed]], v.classes[at[listed]]
                shared = kind == 0
                shape = shapes_of(words, s.shapes)
                kind[shared] = s.own + 1 + shape[shared]
                logs = np.log10(count + 0.5)
                base = np.bincount(rows[listed], logs[listed], n) + np.log10(v.ends + 0.5)
                mixed = np.zeros(n)
                np.add.at(mixed, rows[shared & listed], logs[shared & listed])
                np.subtract.at(mixed, rows[shared], inner[shape[shared]])
                known = np.bincount(rows[listed], minlength=n) + known_end
                # Each row's classes, then its end.
                ends = words.first[1:] + np.arange(n)
                sequence = np.full(len(rows) + n, END, dtype="<u2")
                sequence[np.arange(len(rows)) + rows] = kind
                raw = sequence.tobytes()
                begins = np.append(0, ends + 1)
                rare = ~listed
                offsets = np.append(0, np.cumsum(np.bincount(rows[rare], minlength=n)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(np.diff(words.first) + 1),
                        pa.array(known),
                        pa.array(base),
                        pa.array(mixed),
                        pa.array([raw[2 * a : 2 * b] for a, b in zip(begins[:-1], begins[1:], strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(offsets.astype(np.int32)), pa.array(words.hashes[rare].view(np.int64))
                        ),
                    ],
                    ["doc_id", "held_out", "n_tokens", "known", "base", "mixed", "classes", "rare"],
                )

    return encode


ENCODED = (
    "doc_id long, held_out boolean, n_tokens long, known long, base double, mixed double, classes binary, "
    "rare array<long>"
)


class Together:
    """Sequences side by side, longest first, their tokens ordered by time."""

    def __init__(self, sequences: list[bytes]):
        lengths = np.array([len(x) // 2 for x in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        seen = np.frombuffer(b"".join(sequences[i] for i in self.order), dtype="<u2")
        # Sequences still going at each time; the first ones, as they are ordered.
        self.active = len(lengths) - np.cumsum(np.bincount(lengths))[:-1]
        self.steps = np.append(0, np.cumsum(self.active))
        own = np.repeat(np.arange(len(lengths)), lengths)
        time = np.arange(len(seen)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.seen = np.empty(len(seen), dtype=np.int64)
        self.owner = np.empty(len(seen), dtype=np.int64)
        at = self.steps[time] + own
        self.seen[at], self.owner[at] = seen, own

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward values, scales and emission values of all tokens."""
        emitted = np.ascontiguousarray(model.emits.T, dtype=np.float32)[self.seen]
        moves = model.moves.astype(np.float32)
        ahead, scale = np.empty_like(emitted), np.empty(len(emitted), dtype=np.float32)
        now = None
        for t, n in enumerate(self.active):
            a, b = self.steps[t], self.steps[t + 1]
            now = ahead[a:b]
            if t:
                np.matmul(ahead[self.steps[t - 1] : self.steps[t - 1] + n], moves, out=now)
                now *= emitted[a:b]
            else:
                np.multiply(model.start.astype(np.float32), emitted[a:b], out=now)
            own = now.sum(axis=1)
            scale[a:b] = own
            now /= own[:, None]
        return ahead, scale, emitted

    def log10(self, model: Model) -> np.ndarray:
        _, scale, _ = self.forward(model)
        sums = np.bincount(self.owner, np.log10(scale.astype(np.float64)), len(self.order))
        out = np.empty(len(self.order))
        out[self.order] = sums
        return out

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions."""
        ahead, scale, emitted = self.forward(model)
        back = model.moves.T.astype(np.float32)
        emitted /= scale[:, None]
        moves = np.zeros(model.moves.shape)
        behind = None
        for t in range(len(self.active) - 1, -1, -1):
            a, n = self.steps[t], self.active[t]
            own = np.ones((n, len(model.start)), dtype=np.float32)
            if behind is not None:
                b, m = self.steps[t + 1], self.active[t + 1]
                reached = emitted[b : b + m] * behind
                moves += ahead[a : a + m].T @ reached
                np.matmul(reached, back, out=own[:m])
                ahead[b : b + m] *= behind
            behind = own
        ahead[: self.active[0]] *= behind
        emits = np.stack([np.bincount(self.seen, x, model.emits.shape[1]) for x in ahead.T])
        return ahead[: self.active[0]].sum(axis=0, dtype=np.float64), moves * model.moves, emits


def _grouped(batches, tokens: int, columns: tuple[str, ...] = ()):
    """Sequences, and other columns, of rows of about so many tokens."""
    held, rest, size = [], [[] for _ in columns], 0
    for batch in batches:
        values = batch.column("classes").to_pylist()
        others = [batch.column(c).to_pylist() for c in columns]
        for i, value in enumerate(values):
            held.append(value)
            for out, own in zip(rest, others, strict=True):
                out.append(own[i])
            size += len(value) // 2
            if size >= tokens:
                yield held, rest
                held, rest, size = [], [[] for _ in columns], 0
    if held:
        yield held, rest


def _first(weights: np.ndarray, s: Settings) -> Model:
    rng = np.random.default_rng(s.seed)
    emits = weights * rng.gamma(1.0, 1.0, (s.states, len(weights)))
    moves = np.full((s.states, s.states), 0.1 / s.states) + 0.9 * np.eye(s.states)
    return Model(np.full(s.states, 1 / s.states), moves, emits / emits.sum(axis=1, keepdims=True))


def _improved(starts, moves, emits, weights: np.ndarray, s: Settings) -> Model:
    """The model of expected counts, with pseudo-counts: emissions as all tokens have them, moves and starts even."""
    emits = emits + s.prior * weights
    moves, starts = moves + 1.0, starts + 1.0
    return Model(
        starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True)
    )


def _warmed(weights: np.ndarray, s: Settings):
    def warm(batches):
        sequences = [x for batch in batches for x in batch.column("classes").to_pylist()]
        model = _first(weights, s)
        if sequences:
            together = Together(sequences)
            for _ in range(s.warm_rounds):
                model = _improved(*together.expected(model), weights, s)
        flat = np.concatenate([model.start, model.moves.reshape(-1), model.emits.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "value"])

    return warm


def _expecter(model: Model, s: Settings):
    def expect(batches):
        total = None
        for sequences, _ in _grouped(batches, s.tokens):
            own = Together(sequences).expected(model)
            total = own if total is None else tuple(x + y for x, y in zip(total, own, strict=True))
        if total is not None:
            flat = np.concatenate([x.reshape(-1) for x in total])
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["place", "value"])

    return expect


def _placed(rows: DataFrame, s: Settings, classes: int):
    """(starts, moves, emits) from rows ``place, value``; their number is set by states and classes."""
    k = s.states
    got = rows.toPandas()
    flat = np.zeros(k + k * k + k * classes)
    flat[got["place"].to_numpy(dtype=np.int64)] = got["value"].to_numpy()
    return flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :].reshape(k, classes)


def train(encoded: DataFrame, v: Vocabulary, s: Settings) -> Model:
    weights = class_weights(v, s)
    training = encoded.where(~F.col("held_out")).select("classes")
    sample = written(
        encoded.where(~F.col("held_out"))
        .orderBy(F.xxhash64("doc_id"), "n_tokens")
        .select("classes", F.xxhash64("doc_id").alias("h"), "n_tokens")
        .limit(s.warm)
        .select("classes")
        .coalesce(1),
        "warm",
    )
    first = sample.coalesce(1).mapInArrow(_warmed(weights, s), "place long, value double")
    model = Model(*_placed(first, s, len(weights)))
    if not model.start.any():
        model = _first(weights, s)
    for _ in range(s.rounds):
        expected = training.mapInArrow(_expecter(model, s), "place long, value double")
        expected = expected.groupBy("place").agg(F.sum("value").alias("value"))
        model = _improved(*_placed(expected, s, len(weights)), weights, s)
    return model


def _scorer(model: Model, s: Settings):
    def score(batches):
        for sequences, (rows,) in _grouped(batches, s.tokens, ("row",)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(Together(sequences).log10(model))], ["row", "sequence"]
            )

    return score


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    s = settings
    counts = count_words(docs, s)
    v = vocabulary(counts, s)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    encoded = rows.mapInArrow(_encoder(v, s), ENCODED)
    encoded = written(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = train(encoded, v, s)
    likely = encoded.select("row", "classes").mapInArrow(_scorer(model, s), "row long, sequence double")
    rare = encoded.select("row", F.explode("rare").alias("word"))
    words = counts.where("shape >= 0").select("word", "n")
    rare = rare.join(words, "word", "left").groupBy("row")
    rare = rare.agg(F.count("n").alias("rare_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"))
    told = encoded.drop("classes", "rare").join(likely, "row").join(rare, "row", "left")
    log = F.coalesce("rare_log", F.lit(0.0))
    divisor = float(np.log10(v.total + 0.5 * (v.distinct + 1)))
    return told.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(v.total)).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * divisor).alias("base_score"),
        (F.col("sequence") + F.col("mixed") + log).alias("score"),
    )
