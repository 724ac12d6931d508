"""Benchmark decontamination: a BM25 index of test items, searched by every training passage (operator 9).

Index: a test item is cut into segments of at most ``segment`` words; a segment's words carry their BM25 impact, over all
segments of all items, divided by the sum of the segment's impacts. So a passage that holds a whole segment scores 1,
and ``threshold`` means the same for every segment. The index is made in shards of bounded size; each is sent to the
executors and searched by all documents, one scan for each shard.

Search: passages are windows of ``3 * stride`` words, one every ``stride`` words, over the whole text; any run of up to
``2 * stride`` words lies in one of them. Pruning is that of block-max WAND and loses nothing:

- the lightest words of a segment, together below a share of the threshold, cannot reach it alone; a segment becomes a
  candidate only through its other, essential, words (the pivot);
- segments stand in blocks; per word and block the largest impact is kept, and a (passage, block) pair is opened only if
  these maxima and the block's largest inessential rest reach the threshold;
- then essential impacts are summed per segment, and what may still reach the threshold is scored in full.

Verification: of the item's five-word shingles, the question's and the answer's together, ``overlap`` must stand in the
document. The answer is what follows the last "Answer:", or else the last sentence; both shares are reported.

Edge cases: null text counts as empty; an item without words, or a document without words, matches nothing; repeated
rows, ids and items each give their rows; null ids are kept; without items no document is contaminated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbump.llm.tables import written
from fleetbump.llm.words import Words, chunks, shingles, words_of

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    segment: int = 48
    stride: int = 32
    threshold: float = 0.6
    overlap: float = 0.8
    words: int = 5
    k1: float = 1.2
    b: float = 0.75
    block: int = 16
    # Share of the threshold that a segment's inessential words may make up. Any share gives the same result.
    light: float = 0.3
    # Postings of one shard of the index, on average.
    shard_postings: int = 1_000_000


@dataclass
class Index:
    """One shard. Postings of essential words by word; blocks by word; whole segments; item texts by item."""

    words: np.ndarray
    wanted: np.ndarray
    posting_from: np.ndarray
    posting_segment: np.ndarray
    posting_impact: np.ndarray
    block_from: np.ndarray
    block_id: np.ndarray
    block_max: np.ndarray
    rest: np.ndarray
    block_rest: np.ndarray
    segment_words: list
    segment_impacts: list
    segment_item: np.ndarray
    item_ids: list
    item_shingles: list


def _segments(segment: int):
    def cut(batches):
        for batch in batches:
            for part in chunks(batch):
                words = words_of(part.column("text"))
                rows = words.rows()
                number = (np.arange(len(rows)) - words.first[rows]) // segment if len(rows) else rows
                key = np.stack([rows, number, words.hashes.view(np.int64)])
                (rows, number, hashes), tf = np.unique(key, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("item").take(pa.array(rows)),
                        pa.array(number.astype(np.int64)),
                        pa.array(hashes),
                        pa.array(tf.astype(np.int64)),
                    ],
                    ["item", "segment", "word", "tf"],
                )

    return cut


def split_answer(text: str) -> tuple[str, str]:
    """Question and answer: at the last "Answer:", or else before the last sentence (an only sentence is the question)."""
    at = text.lower().rfind("answer:")
    if at >= 0:
        return text[:at], text[at + len("answer:") :]
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", text.strip())]
    return (text.strip()[: ends[-1]], text.strip()[ends[-1] :]) if ends else (text, "")


def indexes(items: DataFrame, settings: Settings = Settings()):
    """The shards of the index, one after the other."""
    s = settings
    # Equal items are one entry with all their ids.
    listed = items.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("item_id").cast("long").alias("item_id"))
    listed = listed.groupBy("text").agg(F.collect_list("item_id").alias("ids"), F.count("*").alias("n"))
    listed = written(listed.withColumn("item", F.md5("text")), "items")
    postings = written(
        listed.select("item", "text").mapInArrow(_segments(s.segment), "item string, segment long, word long, tf long"),
        "postings",
    )
    sizes = postings.groupBy("item", "segment").agg(F.sum("tf").alias("length"))
    n, mean, total = sizes.agg(F.count("*"), F.avg("length"), F.lit(postings.count())).first()
    if not n:
        return
    df = postings.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = s.k1 * (1 - s.b + s.b * F.col("length") / mean)
    weighed = postings.join(df, "word").join(sizes, ["item", "segment"])
    weighed = weighed.withColumn("impact", idf * F.col("tf") * (s.k1 + 1) / (F.col("tf") + norm))
    shards = -(-total // s.shard_postings)
    for shard in range(shards):
        own = F.pmod(F.xxhash64("item"), F.lit(shards)) == shard
        got = weighed.where(own).select("item", "segment", "word", "impact").toPandas()
        texts = listed.where(own).select("item", "text", "ids", "n").toPandas()
        if len(got):
            yield _shard(got, texts, s)


def _shard(got, texts, s: Settings) -> Index:
    got = got.sort_values(["item", "segment", "word"], ignore_index=True)
    first = ~got.duplicated(["item", "segment"])
    segment = first.cumsum().to_numpy() - 1
    word = got["word"].to_numpy().view(_U)
    impact = got["impact"].to_numpy()
    impact = impact / np.bincount(segment, impact)[segment]
    texts = texts.set_index("item")
    items = list(texts.index)
    place = {item: i for i, item in enumerate(items)}
    begins = np.append(np.flatnonzero(first), len(got))
    count = len(begins) - 1
    essential = np.zeros(len(got), dtype=bool)
    rest = np.zeros(count)
    for i in range(count):
        a, b = begins[i], begins[i + 1]
        order = np.argsort(impact[a:b], kind="stable")
        light = np.cumsum(impact[a:b][order]) < s.light * s.threshold - 1e-9
        essential[a + order[~light]] = True
        rest[i] = impact[a + order[light]].sum()
    order = np.lexsort((segment[essential], word[essential]))
    words, seg, imp = word[essential][order], segment[essential][order], impact[essential][order]
    unique, at = np.unique(words, return_index=True)
    block = seg // s.block
    new = np.append(True, (words[1:] != words[:-1]) | (block[1:] != block[:-1]))
    block_at = np.flatnonzero(new)
    wanted = np.zeros(1 << 20, dtype=bool)
    wanted[(unique >> _U(44)).astype(np.int64)] = True
    shingle_sets = []
    for item in items:
        parts = [words_of(pa.array([x])) for x in split_answer(texts.loc[item, "text"])]
        whole = words_of(pa.array([texts.loc[item, "text"]]))
        shingle_sets.append(tuple(np.unique(shingles(x, s.words)[1]) for x in (whole, *parts)))
    return Index(
        words=unique,
        wanted=wanted,
        posting_from=np.append(at, len(words)),
        posting_segment=seg,
        posting_impact=imp,
        block_from=np.append(np.searchsorted(words[block_at], unique), len(block_at)),
        block_id=block[block_at],
        block_max=np.maximum.reduceat(imp, block_at),
        rest=rest,
        block_rest=np.maximum.reduceat(rest, np.arange(0, count, s.block)),
        segment_words=[word[begins[i] : begins[i + 1]] for i in range(count)],
        segment_impacts=[impact[begins[i] : begins[i + 1]] for i in range(count)],
        segment_item=np.array([place[x] for x in got["item"].to_numpy()[begins[:-1]]]),
        item_ids=[
            [int(x) for x in ids] + [None] * (int(n) - len(ids))
            for ids, n in zip(texts["ids"], texts["n"], strict=True)
        ],
        item_shingles=shingle_sets,
    )


def _expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position) of all positions in the ranges."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(key, return_inverse=True)
    return keys, np.bincount(at, value, len(keys))


def retrieved(words: Words, index: Index, s: Settings) -> dict[tuple[int, int], float]:
    """(row, item) pairs of which a passage and a segment reach the threshold, and the best score."""
    hit = np.flatnonzero(index.wanted[(words.hashes >> _U(44)).astype(np.int64)])
    term = np.minimum(np.searchsorted(index.words, words.hashes[hit]), len(index.words) - 1)
    same = index.words[term] == words.hashes[hit]
    hit, term = hit[same], term[same]
    if not len(hit):
        return {}
    row = np.searchsorted(words.first, hit, side="right") - 1
    # Windows are numbered through all rows; a row has one for each stride that begins in it, and two before.
    base = np.concatenate([[0], np.cumsum(np.diff(words.first) // s.stride + 3)])
    window = base[row] + (hit - words.first[row]) // s.stride + 2
    pair = np.unique(np.concatenate([(window - i) * len(index.words) + term for i in range(3)]))
    window, term = np.divmod(pair, len(index.words))
    least = s.threshold - 1e-9
    blocks = len(index.block_rest)
    owner, at = _expand(index.block_from[term], index.block_from[term + 1])
    bound_of, bound = _sums(window[owner] * blocks + index.block_id[at], index.block_max[at])
    opened = bound_of[bound + index.block_rest[bound_of % blocks] >= least]
    owner, at = _expand(index.posting_from[term], index.posting_from[term + 1])
    inside = np.isin(window[owner] * blocks + index.posting_segment[at] // s.block, opened)
    owner, at = owner[inside], at[inside]
    segments = len(index.rest)
    of, score = _sums(window[owner] * segments + index.posting_segment[at], index.posting_impact[at])
    best: dict[tuple[int, int], float] = {}
    for key in of[score + index.rest[of % segments] >= least]:
        w, segment = divmod(int(key), segments)
        r = int(np.searchsorted(base, w, side="right")) - 1
        start = words.first[r] + max(0, (w - base[r] - 2) * s.stride)
        end = min(words.first[r + 1], words.first[r] + (w - base[r] + 1) * s.stride)
        held = np.isin(index.segment_words[segment], words.hashes[start:end])
        full = float(index.segment_impacts[segment][held].sum())
        if full >= least:
            found = (r, int(index.segment_item[segment]))
            best[found] = max(full, best.get(found, 0.0))
    return best


def verified(words: Words, index: Index, s: Settings) -> list[tuple[int, int, float, float, float, float]]:
    """(row, item, score, overlap, question overlap, answer overlap) of the documents that hold an item."""
    out, seen = [], {}
    for (row, item), score in sorted(retrieved(words, index, s).items()):
        if row not in seen:
            a, b = words.first[row], words.first[row + 1]
            own = Words(words.hashes[a:b], words.starts[a:b], words.ends[a:b], np.array([0, b - a]), words.data)
            seen[row] = shingles(own, s.words)[1]
            if b - a >= s.words:
                # Questions and answers of fewer words than a shingle are looked up as shorter runs.
                seen[row] = np.concatenate([seen[row], *(_runs(own.hashes, n) for n in range(1, s.words))])
            seen[row] = np.sort(seen[row])
        shares = [_share(x, seen[row]) for x in index.item_shingles[item]]
        if shares[0] >= s.overlap:
            out.append((row, item, score, *shares))
    return out


def _share(wanted: np.ndarray, held: np.ndarray) -> float:
    """Share of the wanted hashes among the (sorted) held ones."""
    if not len(wanted):
        return 1.0
    at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    return float((held[at] == wanted).mean())


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, as a text of just these words has them."""
    starts = np.arange(len(hashes) - n + 1)
    runs = hashes[(starts[:, None] + np.arange(n)).reshape(-1)]
    first = np.arange(0, len(runs) + 1, n)
    return shingles(Words(runs, runs, runs, first, runs), n + 1)[1]


def contaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, score, overlap, question_overlap, answer_overlap."""
    schema = (
        "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    )
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def searcher(index: Index):
        def search(batches):
            for batch in batches:
                for part in chunks(batch):
                    ids = part.column("doc_id")
                    rows = [
                        (ids[row].as_py(), item_id, *shares)
                        for row, item, *shares in verified(words_of(part.column("text")), index, settings)
                        for item_id in index.item_ids[item]
                    ]
                    names = [x.split()[0] for x in schema.split(", ")]
                    types = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
                    columns = list(zip(*rows, strict=True)) or [()] * 6
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
                    )

        return search

    found = None
    for index in indexes(items, settings):
        part = slim.mapInArrow(searcher(index), schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def keep_clean(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; no row moves."""

    def cleaner(index: Index):
        def clean(batches):
            for batch in batches:
                for part in chunks(batch):
                    keep = np.ones(part.num_rows, dtype=bool)
                    keep[[row for row, *_ in verified(words_of(part.column("text")), index, settings)]] = False
                    yield part.filter(pa.array(keep))

        return clean

    for index in indexes(items, settings):
        docs = docs.mapInArrow(cleaner(index), docs.schema)
    return docs
