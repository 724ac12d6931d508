"""MinHash near-deduplication by improved consistent weighted sampling over TF-IDF shingles (operator 1).

Every document is a weighted set of five-word shingles. A shingle weighs ``(1 + ln tf) * mean idf of its words``, rounded
to an eighth of an octave; ``idf = ln(1 + N / df) / ln(1 + 1 / rare)`` with ``df`` no less than ``rare * N``, so at most
``mean distinct words of a document / rare`` words have an idf of their own, whatever N is, and only those are sent to
the executors.

1. One scan counts in how many documents each word stands (partial counts per block of words, then one aggregate).
2. One scan draws ``bands * rows`` consistent weighted samples (Ioffe 2010) of each document; a sample is the shingle and
   the quantised weight it was drawn at, so two documents agree on one with probability equal to their weighted Jaccard
   similarity. Texts that are equal byte for byte are one node from here on.
3. Nodes that agree on all samples of a band share a bucket. Every node is first compared with the smallest node of each
   of its buckets, which costs one comparison a node however large a bucket of similar texts is.
4. In buckets that still hold several components, a bound tells which pairs can reach the similarity: what two texts
   share is at most the smaller of their common weights, that of the shingles which any other node of such buckets has.
   Nodes outside the largest component meet the node of the greatest common share; then, with the bound of the buckets
   that are left, all pairs of different components that it allows are compared, each once, in bounded goes. The bound
   is exact, so no link between candidates is lost.
5. Comparisons compute the weighted Jaccard similarity of the whole texts; the links of 0.8 or more give the classes.

Edge cases: null text counts as empty; a text without words is alone unless the same bytes occur again; one to four
words make one shingle; repeated rows and ids share the class of their text; null ids keep their row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbump.llm.tables import components, written
from fleetbump.llm.words import chunks, mix, shingles, words_of

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 12
    rows: int = 4
    rare: float = 0.001
    seed: int = 20
    # Candidate pairs made in one go, for each node of the table.
    pairs_per_node: int = 64


# Weights are 2 ** (level / 8), for levels of this range: mean idf is at least 0.1 and tf at most e ** 31.
LOWEST, HIGHEST = -32, 40
DRAWS = 1 << 14
# Distinct (document, word) pairs counted in memory before a block of partial counts is handed on.
BLOCK_WORDS = 500_000


@lru_cache(maxsize=2)
def _draws(seed: int) -> np.ndarray:
    """Rank of ln a for every weight level and draw of (r, c, beta): lower ranks are sampled first.

    ln a = ln c - r * (t - beta) - r with t = floor(ln S / r + beta); equal t gives equal ln a and so equal ranks.
    """
    rng = np.random.default_rng(seed)
    r, c = rng.gamma(2.0, 1.0, DRAWS), rng.gamma(2.0, 1.0, DRAWS)
    beta = rng.random(DRAWS)
    level = np.arange(LOWEST, HIGHEST + 1)[:, None] / 8 * math.log(2)
    t = np.floor(level / r + beta)
    ln_a = np.log(c) - r * (t - beta) - r
    return np.unique(ln_a, return_inverse=True)[1].reshape(-1).astype(_U) << _U(32)


def _word_counts(batches):
    """Partial (word, documents) counts of blocks of whole documents."""
    held, size = [], 0

    def block():
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "docs"])

    for batch in batches:
        for part in chunks(batch):
            words = words_of(part.column("text"))
            # Within a chunk the row takes the place of the low bits, so one sort finds distinct words of each row.
            ids = np.unique((words.rows().astype(_U) << _U(48)) | (words.hashes >> _U(16)))
            held.append(ids & _U((1 << 48) - 1))
            size += len(ids)
            if size >= BLOCK_WORDS:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def idf_table(docs: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes (sorted) and idf of the words in at least ``rare`` of all documents, and the idf of all other words."""
    n = docs.count()
    counts = (
        docs.select("text")
        .mapInArrow(_word_counts, "word long, docs long")
        .groupBy("word")
        .agg(F.sum("docs").alias("docs"))
        .where(F.col("docs") >= settings.rare * n)
        .orderBy("word")
    )
    # Bounded by the mean number of distinct words of a document over `rare`, at any number of documents.
    got = counts.toArrow()
    words = got.column("word").to_numpy().view(_U) if got.num_rows else np.zeros(0, _U)
    df = got.column("docs").to_numpy() if got.num_rows else np.zeros(0)
    top = math.log(1 + 1 / settings.rare)
    return words, (np.log1p(n / np.maximum(df, 1)) / top).astype(np.float32), 1.0


def weighted_shingles(part: pa.Array, idf, k: int):
    """Distinct shingles of each row: ``row << 48 | shingle`` ascending, and the weight level of each."""
    known, values, other = idf
    words = words_of(part)
    value = np.full(len(words.hashes), other, dtype=np.float32)
    if len(known):
        short = words.hashes >> _U(16)
        at = np.minimum(np.searchsorted(known, short), len(known) - 1)
        hit = known[at] == short
        value[hit] = values[at[hit]]
    at, hashes = shingles(words, k)
    rows = words.rows()
    until = np.minimum(at + k, words.first[1:][rows[at]] if len(at) else at)
    total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    mean = (total[until] - total[at]) / np.maximum(until - at, 1)
    ids, first, tf = np.unique((rows[at].astype(_U) << _U(48)) | hashes, return_index=True, return_counts=True)
    weight = mean[first] * (1 + np.log(tf))
    level = np.rint(8 * np.log2(np.maximum(weight, 1e-9))).astype(np.int64)
    return ids, np.clip(level, LOWEST, HIGHEST)


def _signer(idf, s: Settings):
    def sign(batches):
        ranks = _draws(s.seed)
        odd = mix(np.arange(1, s.bands * s.rows + 1, dtype=_U) + _U(s.seed << 20)) | _U(1)
        for batch in batches:
            for part in chunks(batch):
                ids, level = weighted_shingles(part.column("text"), idf, s.words)
                rows = (ids >> _U(48)).astype(np.int64)
                begins = np.flatnonzero(np.diff(rows, prepend=-1))
                some = rows[begins]
                base = mix(ids & _U((1 << 48) - 1))
                offset = (level - LOWEST) * DRAWS
                drawn = np.empty((len(odd), len(some)), dtype=_U)
                for i, factor in enumerate(odd):
                    x = base * factor
                    key = ranks[(x >> _U(50)).astype(np.int64) + offset] | ((x >> _U(18)) & _U(0xFFFFFFFF))
                    drawn[i] = np.minimum.reduceat(key, begins) if len(begins) else 0
                bands = np.zeros((s.bands, len(some)), dtype=_U)
                for i in range(len(odd)):
                    bands[i // s.rows] = mix(bands[i // s.rows] ^ drawn[i] + odd[i])
                n = part.num_rows
                total = np.zeros(n)
                np.add.at(total, rows, np.exp2(level / 8))
                has = np.zeros(n, dtype=np.int64)
                has[some] = s.bands
                offsets = np.concatenate([[0], np.cumsum(has)]).astype(np.int32)
                values = pa.array(np.ascontiguousarray(bands.T).reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("node"),
                        pa.array(total),
                        pa.ListArray.from_arrays(pa.array(offsets), values),
                    ],
                    ["doc_id", "node", "weight", "bands"],
                )

    return sign


def _comparer(idf, s: Settings):
    def compare(batches):
        for batch in batches:
            for rows in chunks(batch, "left_text", "right_text"):
                x, lx = weighted_shingles(rows.column("left_text"), idf, s.words)
                y, ly = weighted_shingles(rows.column("right_text"), idf, s.words)
                wx, wy = np.exp2(lx / 8), np.exp2(ly / 8)
                n = rows.num_rows
                sums = np.bincount((x >> _U(48)).astype(np.int64), wx, n) + np.bincount(
                    (y >> _U(48)).astype(np.int64), wy, n
                )
                both, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                shared = np.bincount((both >> _U(48)).astype(np.int64), np.minimum(wx[ix], wy[iy]), n)
                found = np.divide(shared, sums - shared, out=np.zeros(n), where=sums > 0)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("a"), rows.column("b"), pa.array(found)], ["a", "b", "similarity"]
                )

    return compare


def with_node(docs: DataFrame) -> DataFrame:
    """``docs`` with ``node``: a digest of the text's bytes, so that equal texts are one node."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("node"),
    )


def _spelt(idf, s: Settings):
    def spell(batches):
        for batch in batches:
            for part in chunks(batch):
                ids, level = weighted_shingles(part.column("text"), idf, s.words)
                numbers = part.column("no").to_numpy()[(ids >> _U(48)).astype(np.int64)]
                short = (ids & _U((1 << 48) - 1)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(short), pa.array(numbers), pa.array(np.exp2(level / 8))], ["shingle", "no", "weight"]
                )

    return spell


def texts_of(docs: DataFrame, nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """``node, text`` of the given nodes, read from one document for each."""
    chosen = reps.join(nodes, "node", "left_semi").select("node", F.col("rep").alias("doc_id"))
    texts = with_node(docs).alias("d").join(
        chosen.alias("c"),
        (F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))) & (F.col("d.node") == F.col("c.node")),
        "left_semi",
    )
    return texts.select("node", "text").dropDuplicates(["node"])


def similar_links(docs: DataFrame, pairs: DataFrame, reps: DataFrame, idf, settings: Settings) -> DataFrame:
    """The pairs ``a, b`` of nodes whose texts have the weighted Jaccard similarity asked for.

    Only the texts of nodes in a pair are read again, one document for each node, and joined side by side.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = texts_of(docs, wanted, reps)
    joined = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left_text")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("right_text")), "b")
        .select("a", "b", "left_text", "right_text")
    )
    found = joined.mapInArrow(_comparer(idf, settings), "a binary, b binary, similarity double")
    return found.where(F.col("similarity") >= settings.similarity)


def near_classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: ``doc_id, node, class_node, class_id, class_size, class_nodes``.

    ``class_id`` is the smallest doc_id of the class (null if it has no id), ``class_nodes`` counts its different texts,
    ``class_node`` is the smallest digest of them.
    """
    s = settings
    idf = idf_table(docs, s)
    signed = written(
        with_node(docs).mapInArrow(
            _signer(idf, s), "doc_id long, node binary, weight double, bands array<long>"
        ),
        "signatures",
    )
    reps = written(
        signed.groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.first("weight").alias("weight"), F.first("bands").alias("bands")
        ),
        "nodes",
    )
    # A band's value is drawn with the band's own constants, so values of different bands do not meet.
    members = reps.select("node", "weight", F.explode("bands").alias("value"))
    buckets = members.groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct("node", "weight")).alias("lead"))
    members = written(members.join(buckets.where("n > 1"), "value"), "buckets")
    led = members.where("node <> lead.node").select(
        F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.weight").alias("wa"), F.col("weight").alias("wb")
    )
    done = written(_comparable(led, s), "pairs")
    links = written(similar_links(docs, done, reps, idf, s), "links")
    roots = components(links)
    held = _eligible(docs, members.select("value", "node", "weight"), roots, reps, idf, s)
    if not held.isEmpty():
        met = written(_central_pairs(held, s).join(done, ["a", "b"], "left_anti"), "pairs")
        more = written(similar_links(docs, met, reps, idf, s), "links")
        if not more.isEmpty():
            roots = components(_with_links(roots, more))
        held = _eligible(docs, held.select("value", "node", "weight"), roots, reps, idf, s)
        more = _remaining(docs, held, done.unionByName(met), reps, idf, s)
        if more is not None and not more.isEmpty():
            roots = components(_with_links(roots, more))
    placed = reps.select("node", "rep").join(roots, "node", "left")
    placed = written(placed.select("node", "rep", F.coalesce("root", "node").alias("root")), "placed")
    sized = signed.groupBy("node").agg(F.count("*").alias("rows")).join(placed, "node")
    classes = sized.groupBy("root").agg(
        F.min("rep").alias("class_id"), F.sum("rows").alias("class_size"), F.count("*").alias("class_nodes")
    )
    by_node = placed.join(classes, "root").select(
        "node", F.col("root").alias("class_node"), "class_id", "class_size", "class_nodes"
    )
    return signed.select("doc_id", "node").join(by_node, "node")


def _comparable(pairs: DataFrame, s: Settings) -> DataFrame:
    """Distinct pairs whose weights allow the similarity: it is at most the smaller total weight over the larger one."""
    near = F.least("wa", "wb") >= (s.similarity - 1e-9) * F.greatest("wa", "wb")
    return pairs.where(near).select("a", "b").distinct()


def _with_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return known.unionByName(links.select("a", "b"))


def _open(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, each with the largest component and size of its bucket."""
    parts = placed.groupBy("value", "root").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("value").agg(
        F.max_by("root", F.struct("n", "root")).alias("largest"),
        F.count("*").alias("parts"),
        F.sum("n").alias("all"),
    )
    return placed.join(open_.where("parts > 1").drop("parts"), "value")


def _eligible(docs, rows, roots, reps, idf, s: Settings) -> DataFrame:
    """The rows of open buckets whose nodes can be similar to a node of another component, with their common weight.

    Similar texts share ``similarity`` of the weight of either. A shingle that a single node of the open buckets has is
    shared with none, so a node without that much common weight has no link there and is left out.
    """
    placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(_open(placed).drop("largest", "all"), "open")
    nodes = placed.select("node").distinct().withColumn("no", F.monotonically_increasing_id())
    # Written, so that the numbers stay as they are.
    nodes = written(nodes, "numbered")
    texts = nodes.join(texts_of(docs, nodes, reps), "node").select("no", "text")
    spelt = texts.mapInArrow(_spelt(idf, s), "shingle long, no long, weight double")
    single = spelt.groupBy("shingle").agg(
        F.count("*").alias("n"), F.max("no").alias("no"), F.max("weight").alias("weight")
    )
    single = single.where("n = 1").groupBy("no").agg(F.sum("weight").alias("own"))
    owned = nodes.join(single, "no").select("node", "own")
    placed = placed.join(owned, "node", "left")
    placed = placed.withColumn("common", F.col("weight") - F.coalesce("own", F.lit(0.0))).drop("own")
    placed = placed.where(F.col("common") >= (s.similarity - 1e-9) * F.col("weight"))
    return written(_open(written(placed, "eligible")), "open")


def _possible(s: Settings):
    """Whether common weights ``ca, cb`` allow texts of weights ``wa, wb`` the similarity.

    It is what they share over the rest of both weights, so they share ``similarity / (1 + similarity)`` of their sum.
    """
    share = s.similarity / (1 + s.similarity) - 1e-9
    return F.least("ca", "cb") >= share * (F.col("wa") + F.col("wb"))


def _central_pairs(held: DataFrame, s: Settings) -> DataFrame:
    """Pairs of the node with the greatest common share of each open bucket and the nodes outside the largest component."""
    lead = held.groupBy("value").agg(
        F.max_by(F.struct("node", "root", "weight", "common"), F.struct(F.col("common") / F.col("weight"), "node")).alias("lead")
    )
    pairs = held.where("root <> largest").join(lead, "value").where("root <> lead.root")
    pairs = pairs.select(
        F.least("node", "lead.node").alias("a"),
        F.greatest("node", "lead.node").alias("b"),
        F.col("weight").alias("wa"),
        F.col("common").alias("ca"),
        F.col("lead.weight").alias("wb"),
        F.col("lead.common").alias("cb"),
    )
    return pairs.where(_possible(s)).select("a", "b").distinct()


def _remaining(docs, held, done, reps, idf, s: Settings) -> DataFrame | None:
    """Links between components that share a bucket; None if no bucket holds several.

    In each such bucket, all nodes outside the largest component are paired with all nodes of other components that
    their common weights allow; a pair is made in the smallest bucket it shares. The pairs are made in as many goes as
    keep one go within ``pairs_per_node`` pairs for each node of the table.
    """
    size = held.where("root <> largest").agg(F.sum("all")).first()[0]
    if not size:
        return None
    goes = -(-size // (s.pairs_per_node * reps.count()))
    held = written(held.join(reps.select("node", "bands"), "node"), "open").withColumnsRenamed(
        {"weight": "wa", "common": "ca"}
    )
    links = None
    for go in range(goes):
        lead = held.where((F.col("root") != F.col("largest")) & (F.pmod(F.xxhash64("node"), F.lit(goes)) == go))
        lead = lead.select(
            "value",
            F.col("node").alias("x"),
            F.col("root").alias("xr"),
            F.col("wa").alias("wb"),
            F.col("ca").alias("cb"),
            F.col("bands").alias("xb"),
        )
        pairs = held.join(lead, "value").where("root <> xr and (root = largest or node < x)").where(_possible(s))
        pairs = pairs.where(F.array_min(F.array_intersect("bands", "xb")) == F.col("value"))
        pairs = pairs.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b"))
        pairs = written(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        found = written(similar_links(docs, pairs, reps, idf, s), "links")
        links = found if links is None else links.unionByName(found)
    return links


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without near-duplicates: of each class the row with the smallest doc_id stays.

    Rows that repeat both id and text of the one that stays are dropped with the others.
    """
    found = near_classes(docs, settings)
    best = found.groupBy("class_node").agg(
        F.min_by(F.struct("doc_id", "node"), F.struct(F.isnull("doc_id"), "doc_id", "node")).alias("best")
    )
    best = best.select("best.doc_id", "best.node")
    keyed = docs.withColumn("_node", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))))
    kept = keyed.alias("d").join(
        best.alias("k"),
        F.col("d._node").eqNullSafe(F.col("k.node")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")),
        "left_semi",
    )
    return kept.dropDuplicates(["doc_id", "_node"]).select(*[F.col(c) for c in docs.columns])
