"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks (operator 5).

The kernel of two strings sums ``decay ** (spans)`` over their common subsequences of ``order`` letters (Lodhi et al.
2002), normalised to 1 for equal strings, so a gapped, spelled-out or misspelled insult is still close to the insult. A
sentence is a set of units: its words' letters, and the letters of three or more words of one or two characters in a row
("i d i o t"). Units of over 24 letters are taken in overlapping windows. Kernels under ``floor``, and of units that lack more
than one of a landmark's letters, count as 0. Where clean words are near a landmark too, its kernel is raised to ``power``,
which is a kernel again and tells insults better from words that share their stem; a document's kernel with such a landmark is the sum over the ``units``
of its different units that are nearest to any, so several weak signs add up. With other landmarks, called plain, it is
the highest of its units.

Training, on at most ``sample`` labelled rows of each class (a documented bound; the choice is by hash of the id):

1. Landmarks are units that stand in some toxic documents (1 in 100, at least 3) and in at least ``lift`` times the share
   of the clean ones. They are taken greedily: each next one adds most to the toxic documents that hold fewest so far, so
   each language and kind of insult gets its own. With them go the clean units that are closest to them and frequent. A
   landmark is plain if of the units near it, weighed by nearness and by the classes' true shares, ``alone`` are toxic.
2. A document's features are its kernels with the landmarks times the inverse root of the landmarks' own kernel matrix.
3. A linear machine (squared hinge) is fitted on the documents' features, and on made-up toxic documents that hold one
   plain landmark, as it is or with a letter put into it, and nothing else (together ``made_up`` of the toxic ones' weight): one such insult is enough.
4. A sigmoid fitted on the same, weighed to the classes' true shares, makes its margin a probability.

Scoring reads every whole text in one narrow pass. Each worker keeps the kernels of words it has met, up to a bound.

Edge cases: null text counts as empty and scores as a document without units; labels that are null are left out; of equal
labelled texts the label of the smallest id counts; without labels of both classes, or without landmarks, every score is
the share of toxic labels (0 if there are none); repeated rows and null ids keep their rows; very long texts are read
whole, a text at a time; units that are equally near are taken in their alphabetical order; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbump.llm.tables import written
from fleetbump.llm.words import Words, chunks, words_of


@dataclass(frozen=True)
class Settings:
    order: int = 3
    decay: float = 0.75
    floor: float = 0.5
    power: int = 3
    lift: float = 20.0
    alone: float = 0.9
    made_up: float = 1.0
    candidates: int = 1000
    landmarks: int = 48
    background: int = 12
    sample: int = 3000
    units: int = 8
    cost: float = 1.0
    reject: float = 0.7


@dataclass
class Model:
    landmarks: list[str]
    powers: np.ndarray
    # One weight for each landmark's kernel: the machine's weights times the inverse root of the kernel matrix.
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


LONGEST, STEP = 24, 8
SHORT = re.compile(r"(?<![^ \t-\r])[^ \t-\r]{1,2}(?:[ \t-\r]+[^ \t-\r]{1,2}){2,}(?![^ \t-\r])")
SPELLED = re.compile(r"(?<![^ \t-\r])[^ \t-\r](?:[ \t-\r]+[^ \t-\r]){2,}(?![^ \t-\r])")
SENTENCE = re.compile(r"[.!?]+\s|\n")
WORD = re.compile(r"[^ \t-\r]+")
SPACES = re.compile(r"[ \t-\r]+")
NOT_LETTERS = re.compile(r"[\W\d_]+")
CACHED = 1_000_000
# Words whose kernels are computed at once: their arrays hold some hundred numbers a word.
LEARNT = 16_384
# A letter put into made-up insults; which one it is makes no difference to the kernel as long as no insult has it.
FOREIGN = "\u0250"


def letters(word: str) -> list[str]:
    if not word.isalpha():
        word = NOT_LETTERS.sub("", word)
    if len(word) <= LONGEST:
        return [word] if len(word) >= 3 else []
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST + STEP, STEP)]


def runs_in(text: str) -> set[str]:
    """Runs of very short words, and of words of one character within them, put together."""
    found = SHORT.findall(text)
    return {SPACES.sub("", run) for run in found + [own for run in found for own in SPELLED.findall(run)]}


def words_and_runs(text: str) -> set[str]:
    """Raw units of lower-cased text."""
    return {*WORD.findall(text), *runs_in(text)}


def _points(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all units, and their lengths."""
    return np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32), np.array([*map(len, units)], dtype=int)


def _codes(units: list[str]) -> np.ndarray:
    """Code points by position and unit, 0 past the end."""
    points, sizes = _points(units)
    codes = np.zeros((sizes.max(initial=0), len(units)), dtype=np.uint32)
    owner = np.repeat(np.arange(len(units)), sizes)
    codes[np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner] = points
    return codes


def _letter_bits(units: list[str], alphabet: str) -> np.ndarray:
    """For each (not empty) unit, which of the alphabet's first 64 letters it holds."""
    points, sizes = _points(units)
    table = np.zeros(max(map(ord, alphabet)) + 2, dtype=np.uint64)
    for i, c in enumerate(alphabet[:64]):
        table[ord(c)] = 1 << i
    return np.bitwise_or.reduceat(table[np.minimum(points, len(table) - 1)], np.cumsum(sizes) - sizes)


def kernel(units: list[str], marks: list[str], order: int, decay: float) -> np.ndarray:
    """Gap-weighted subsequence kernel, not normalised, of each unit with the one mark, or with its own mark."""
    codes, marks = _codes(units), _codes(marks)
    n, m = codes.shape[1], len(marks)
    # held[i][j]: weight of subsequences of i letters of what was read and of the mark's first j letters.
    held = [[np.ones(n) for _ in range(m + 1)]] + [[np.zeros(n) for _ in range(m + 1)] for _ in range(order - 1)]
    total = np.zeros(n)
    for letter in codes:
        alive = letter > 0
        same = [decay * decay * ((letter == mark) & alive) for mark in marks]
        for j in range(m):
            total += same[j] * held[order - 1][j]
        for i in range(order - 1, 0, -1):
            run = np.zeros(n)
            for j in range(1, m + 1):
                run = decay * run + same[j - 1] * held[i - 1][j - 1]
                held[i][j] = np.where(alive, decay * held[i][j] + run, held[i][j])
    return total


def similarities(units: list[str], landmarks: list[str], s: Settings) -> np.ndarray:
    """Normalised kernels (units x landmarks), with the floor and the test on letters applied."""
    out = np.zeros((len(units), len(landmarks)))
    if not units or not landmarks:
        return out
    alphabet = "".join(sorted(set("".join(landmarks))))
    bits = _letter_bits(units, alphabet)
    for k, landmark in enumerate(landmarks):
        known = [c for c in landmark if alphabet.index(c) < 64]
        once = np.uint64(sum(1 << alphabet.index(c) for c in set(known)))
        twice = np.uint64(sum(1 << alphabet.index(c) for c in set(known) if known.count(c) > 1))
        lacking = ~bits & once
        near = np.flatnonzero(((lacking & (lacking - np.uint64(1))) == 0) & ((lacking & twice) == 0))
        if len(near):
            out[near, k] = kernel([units[i] for i in near], [landmark], s.order, s.decay)
    # A unit's own kernel is at least that of its plain runs; only what may pass the floor is computed in full.
    own = kernel(landmarks, landmarks, s.order, s.decay)
    rows = np.flatnonzero(out.any(axis=1))
    least = np.array([max(len(units[i]) - s.order + 1, 0) for i in rows]) * s.decay ** (2 * s.order)
    out[rows] *= out[rows] >= s.floor * np.sqrt(own * least[:, None])
    rows = rows[out[rows].any(axis=1)]
    if len(rows):
        mine = [units[i] for i in rows]
        out[rows] /= np.sqrt(kernel(mine, mine, s.order, s.decay)[:, None] * own)
    out[out < s.floor] = 0
    return out


def _letters_only(words: Words, at: np.ndarray) -> np.ndarray:
    """Whether each word and the two after it are at most two characters long (UTF-8 continuation bytes not counted)."""
    characters = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    size = characters[words.ends] - characters[words.starts]
    return (size[at] <= 2) & (size[at + 1] <= 2) & (size[at + 2] <= 2)


class Scorer:
    """Sentence features and document margins, with the kernels of the words met so far."""

    def __init__(self, landmarks: list[str], powers: np.ndarray, s: Settings):
        self.landmarks, self.powers, self.s = landmarks, powers, s
        # Sorted hashes, eight bytes a word: as many Python numbers would take a tenth of a gigabyte.
        self.known = np.zeros(0, dtype=np.uint64)
        self.runs: set[str] = set()
        self.near: dict[str, list[str]] = {}
        self.kernels: dict[str, np.ndarray] = {}
        self.near_hashes: set[int] = set()

    def _learn(self, raw: list[str]) -> list[bool]:
        """Keeps the kernels of raw units that are near a landmark; tells which are."""
        return [told for at in range(0, len(raw), LEARNT) for told in self._learn_some(raw[at : at + LEARNT])]

    def _learn_some(self, raw: list[str]) -> list[bool]:
        parts = [letters(w) for w in raw]
        units = sorted({u for p in parts for u in p})
        place = {u: i for i, u in enumerate(units)}
        found = similarities(units, self.landmarks, self.s) ** self.powers
        close = found.any(axis=1)
        told = []
        for word, part in zip(raw, parts, strict=True):
            own = [u for u in part if close[place[u]]]
            if own:
                self.near[word] = own
                self.kernels.update((u, found[place[u]]) for u in own)
            told.append(bool(own))
        return told

    def rows_near(self, column: pa.Array) -> np.ndarray:
        """Which rows hold a word, or run of very short words, that is near a landmark."""
        if len(self.known) + len(self.runs) > CACHED:
            self.known = np.zeros(0, dtype=np.uint64)
            self.runs, self.near, self.kernels, self.near_hashes = set(), {}, {}, set()
        words = words_of(column)
        data, rows = words.data.tobytes(), words.rows()
        hashes, first = np.unique(words.hashes, return_index=True)
        at = np.searchsorted(self.known, hashes)
        met = np.append(self.known, np.uint64(0))[at] == hashes
        met &= at < len(self.known)
        new, places = hashes[~met], first[~met].tolist()
        raw = [data[words.starts[i] : words.ends[i]].decode("utf-8", "replace").lower() for i in places]
        self.near_hashes.update(new[np.array(self._learn(raw), dtype=bool)].tolist())
        self.known = np.insert(self.known, at[~met], new)
        out = np.zeros(len(column), dtype=bool)
        out[rows[np.isin(words.hashes, np.array(sorted(self.near_hashes), dtype=np.uint64))]] = True
        short = np.flatnonzero(words.ends - words.starts <= 4)
        # Candidate runs: three neighbours of at most four bytes in a row; their characters are counted on the text.
        three = short[:-2][(short[2:] - short[:-2] == 2) & (rows[short[2:]] == rows[short[:-2]])]
        runs = {}
        for row in np.unique(rows[three[_letters_only(words, three)]]).tolist():
            runs[row] = runs_in((column[row].as_py() or "").lower())
        unmet = sorted(set().union(*runs.values()) - self.runs)
        self._learn(unmet)
        self.runs.update(unmet)
        for row, own in runs.items():
            out[row] |= not own.isdisjoint(self.near)
        return out

    def document(self, text: str) -> np.ndarray:
        """Kernels of a document: the sum over its units that are nearest to landmarks, runs over sentences' ends too."""
        held = words_and_runs(text).union(*map(words_and_runs, SENTENCE.split(text)))
        units = sorted({u for w in held if w in self.near for u in self.near[w]})
        if not units:
            return np.zeros(len(self.landmarks))
        found = np.stack([self.kernels[u] for u in units])
        most = found[np.argsort(-found.max(axis=1), kind="stable")[: self.s.units]].sum(axis=0)
        return np.where(self.powers == 1, found.max(axis=0), most)

    def features(self, column: pa.Array) -> np.ndarray:
        """Kernels, rows x landmarks."""
        near = self.rows_near(column)
        out = np.zeros((len(column), len(self.landmarks)))
        for i in np.flatnonzero(near).tolist():
            out[i] = self.document((column[i].as_py() or "").lower())
        return out

    def margins(self, column: pa.Array, model: Model) -> np.ndarray:
        if not model.landmarks:
            return np.full(len(column), model.bias)
        return self.features(column) @ model.weights + model.bias


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """Texts of at most ``sample`` labelled documents of each class that are not held out."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = None
    for value in (0, 1):
        own = usable.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
        chosen = own if chosen is None else chosen.unionByName(own)
    # At most 2 * sample ids.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    first = texts.groupBy("text").agg(F.min(F.struct("doc_id", "toxic")).alias("first"))
    return written(first.select("text", "first.*"), "labelled")


def _units(batches):
    for batch in batches:
        units, toxic = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            own = {u for w in words_and_runs((text or "").lower()) for u in letters(w)}
            units.extend(own)
            toxic.extend([label] * len(own))
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(toxic, pa.int64())], ["unit", "toxic"])


def _cover(sample: DataFrame, candidates: list[str], s: Settings) -> list[str]:
    """At most ``landmarks`` candidates, so that toxic documents hold as many of them as may be, as evenly as may be.

    What a candidate adds to a document halves with each one chosen before it that stands there.
    """
    place = {u: i for i, u in enumerate(candidates)}

    def held(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                own = {u for w in words_and_runs((text or "").lower()) for u in letters(w)}
                rows.append(sorted(place[u] for u in own if u in place))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], ["held"])

    # At most ``sample`` documents by ``candidates``.
    found = sample.where("toxic = 1").select("text").mapInArrow(held, "held array<int>").collect()
    stands = np.zeros((len(found), len(candidates)), dtype=bool)
    for row, r in enumerate(found):
        stands[row, r.held] = True
    worth, chosen = np.ones(len(found)), []
    while len(chosen) < min(s.landmarks, len(candidates)):
        adds = worth @ stands
        best = int(adds.argmax())  # of equal ones the first: the more frequent, then by the alphabet
        chosen.append(candidates[best])
        worth[stands[:, best]] /= 2
        stands[:, best] = False
    return chosen


def _landmarks(sample: DataFrame, classes: tuple[int, int], prior: float, s: Settings) -> tuple[list[str], np.ndarray]:
    """Landmarks, the plain ones and the background included, and the power of each one's kernel."""
    clean, toxic = classes
    counts = sample.select("text", "toxic").mapInArrow(_units, "unit string, toxic long").groupBy("unit")
    counts = counts.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    counts = written(counts, "units")
    lift = (F.col("a") / toxic) / ((F.col("b") + 0.5) / clean)
    strong = counts.where((F.col("a") >= max(3, toxic // 100)) & (lift >= s.lift) & (F.length("unit") > s.order))
    candidates = [r.unit for r in strong.orderBy(F.desc("a"), "unit").limit(s.candidates).collect()]
    strong = _cover(sample, candidates, s)
    if not strong:
        return [], np.zeros(0)

    def closest(batches):
        for batch in batches:
            near = similarities(batch.column("unit").to_pylist(), strong, s)
            rows = np.flatnonzero(near.any(axis=1))
            part = batch.take(pa.array(rows))
            columns = [*(part.column(c) for c in ("unit", "a", "b")), pa.array(list(near[rows]), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["unit", "a", "b", "near"])

    # The sample's units that are near a landmark at all.
    others = written(counts.mapInArrow(closest, "unit string, a long, b long, near array<double>"), "near-units")
    sums = others.select("a", "b", F.posexplode("near").alias("k", "near")).withColumn("near", F.pow("near", F.lit(s.power))).groupBy("k")
    sums = sums.agg(F.sum(F.col("near") * F.col("a")).alias("a"), F.sum(F.col("near") * F.col("b")).alias("b"))
    plain = {
        r.k for r in sums.collect() if prior * r.a / toxic >= s.alone * (prior * r.a / toxic + (1 - prior) * r.b / clean)
    }
    # Of the clean units that stand near a landmark, those that are nearest and stand in several documents.
    weight = F.array_max("near") * F.least("b", F.lit(5))
    background = others.where("b >= 2 and a <= b").orderBy(weight.desc(), "unit").limit(s.background)
    background = [r.unit for r in background.collect()]
    powers = [1 if k in plain else s.power for k in range(len(strong))] + [s.power] * len(background)
    return strong + background, np.array(powers, dtype=float)


def _documents(landmarks: list[str], powers: np.ndarray, s: Settings):
    """Features of each labelled document."""

    def described(batches):
        scorer = Scorer(landmarks, powers, s)
        for batch in batches:
            for part in chunks(batch):
                near = pa.array(list(scorer.features(part.column("text"))), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), near], ["doc", "toxic", "near"])

    return described


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Weights, the bias last, of the squared-hinge machine, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        inside = y * (x @ w) < 1
        own, c = x[inside], cost * weight[inside]
        new = np.linalg.solve(ridge + (own * c[:, None]).T @ own, own.T @ (c * y[inside]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _sigmoid(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability 1 / (1 + exp(-(slope * margin + offset))), by Newton steps."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-3 * (w - [1.0, 0.0]))
        w = w + np.clip(step, -2, 2)
    return float(max(w[0], 0.0)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    s = settings
    sample = _sample(docs, labels, s)
    shares = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    clean, toxic = shares.get(0, 0), shares.get(1, 0)
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    prior = usable.agg(F.avg("toxic")).first()[0] or 0.0
    landmarks, powers = _landmarks(sample, (clean, toxic), prior, s) if clean and toxic else ([], None)
    if not landmarks:
        base = min(max(prior, 1e-9), 1 - 1e-9)
        return Model([], np.zeros(0), np.zeros(0), 0.0, 0.0, float(np.log(base / (1 - base))))
    # At most 2 * sample rows of as many numbers as there are landmarks.
    got = sample.mapInArrow(_documents(landmarks, powers, s), "doc long, toxic int, near array<double>")
    got = got.toPandas().sort_values(["doc"], kind="stable", ignore_index=True)
    # Landmarks of different powers belong to different kernels, whose sum is the machine's.
    square = similarities(landmarks, landmarks, Settings(**{**s.__dict__, "floor": 0.0}))
    square = ((square + square.T) / 2) ** powers * (powers[:, None] == powers)
    values, vectors = np.linalg.eigh(square)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    near, label = np.stack(got["near"].to_numpy()), got["toxic"].to_numpy()
    x = near @ root
    weight = np.where(label == 1, prior / toxic, (1 - prior) / clean) * len(label)
    plain = [landmarks[k] for k in np.flatnonzero(powers == 1)]
    plain += [w[: len(w) // 2] + FOREIGN + w[len(w) // 2 :] for w in plain]
    single = similarities(plain, landmarks, s) ** powers @ root
    fitted = np.vstack([x, single]), np.append(np.where(label == 1, 1.0, -1.0), np.ones(len(plain)))
    own = s.made_up * prior * len(label) / max(1, len(plain))
    weight = np.append(weight, np.full(len(plain), own))
    w = _machine(*fitted, weight, s.cost)
    slope, offset = _sigmoid(fitted[0] @ w[:-1] + w[-1], fitted[1] > 0, weight)
    return Model(landmarks, powers, root @ w[:-1], float(w[-1]), slope, offset)


def _probability(margin: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -500, 500)))


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""

    def scored(batches):
        scorer = Scorer(model.landmarks, model.powers, settings)
        for batch in batches:
            for part in chunks(batch):
                found = _probability(scorer.margins(part.column("text"), model), model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = slim.mapInArrow(scored, "doc_id long, score double")
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= settings.reject).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score below ``reject``, with all their columns; no row moves."""

    def clean(batches):
        scorer = Scorer(model.landmarks, model.powers, settings)
        for batch in batches:
            for part in chunks(batch):
                found = _probability(scorer.margins(part.column("text"), model), model)
                yield part.filter(pa.array(found < settings.reject))

    return docs.mapInArrow(clean, docs.schema)
