import hashlib
import math
from collections import Counter, defaultdict

import pytest
from fleetbump.llm import exact_dedup, near_dedup
from pyspark.sql import functions as F


def normal(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def groups_of(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normal(text)].append(doc_id)
    return groups


def test_exact_groups_equal_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    groups = groups_of(rows)
    found = exact_dedup.groups(documents).collect()
    assert len(found) == len(rows)
    digests = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in found:
        ids = digests[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter(list(digests))
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_runs_over_many_ranges(spark, keep):
    """A text that fills most of the table is cut over ranges; its runs are joined again."""
    docs = spark.range(0, 3000, 1, 4).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "Same text").otherwise(F.col("id").cast("string")).alias("text")
    )
    found = exact_dedup.groups(docs, keep)
    assert found.where("kept").count() == 901
    best = found.where("group_size = 2100")
    assert best.count() == 2100
    assert [r.keep_id for r in best.select("keep_id").distinct().collect()] == [2996 if keep == "largest" else 0]


def test_exact_stage_keeps_columns(clashing, nothing):
    kept = exact_dedup.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == len(groups_of((r.doc_id, r.text) for r in clashing.select("doc_id", "text").collect()))
    assert exact_dedup.groups(nothing).count() == 0
    assert exact_dedup.keep_one(nothing).count() == 0


def weights(text, idf, other, k=5):
    words = [w for w in normal(text).replace("\n", " ").split(" ") if w]
    if not words:
        return {}
    count = Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))
    out = {}
    for shingle, tf in count.items():
        weight = sum(idf.get(w, other) for w in shingle) / len(shingle) * (1 + math.log(tf))
        out[shingle] = 2 ** (round(8 * math.log2(weight)) / 8)
    return out


def brute_classes(rows, s):
    texts = sorted({t or "" for _, t in rows})
    n = len(rows)
    df = Counter(w for _, t in rows for w in {w for w in normal(t).split(" ") if w})
    top = math.log(1 + 1 / s.rare)
    idf = {w: math.log(1 + n / d) / top for w, d in df.items() if d >= s.rare * n}
    held = {t: weights(t, idf, 1.0) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, x in enumerate(texts):
        for y in texts[i + 1 :]:
            a, b = held[x], held[y]
            shared = sum(min(w, b[k]) for k, w in a.items() if k in b)
            total = sum(a.values()) + sum(b.values()) - shared
            if total and shared / total >= s.similarity:
                root[find(y)] = find(x)
    classes = defaultdict(set)
    for doc_id, t in rows:
        classes[find(t or "")].add((doc_id, t or ""))
    return {frozenset(c) for c in classes.values()}


def test_near_classes_equal_brute_force(documents):
    s = near_dedup.Settings()
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    found = near_dedup.near_classes(documents, s).collect()
    assert len(found) == len(rows)
    text_of = {hashlib.md5((t or "").encode()).digest(): t or "" for _, t in rows}
    classes = defaultdict(set)
    for r in found:
        classes[bytes(r.class_node)].add((r.doc_id, text_of[bytes(r.node)]))
    assert {frozenset(c) for c in classes.values()} == brute_classes(rows, s)


def test_near_keeps_links_between_texts_the_smallest_node_is_not_close_to(spark, texts):
    """A chain: each text is close to the next only, so no one text is close to all."""
    words = " ".join(texts).split(" ")[:400]
    rows = []
    for i in range(12):
        own = list(words)
        for j in range(i):
            own[30 * j + 5] = f"changed{j}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_classes(docs).select("class_id").distinct().collect()
    assert [r.class_id for r in found] == [0]


def test_near_compares_few_of_the_pairs_that_cannot_be_similar(spark, texts, monkeypatch):
    """Variants of one text that differ too much from each other: their number, not its square, is compared."""
    words = " ".join(texts).split(" ")[:200]
    rows = [(0, " ".join(words))]
    for i in range(1, 121):
        own = list(words)
        # Variant i changes one word of every 30, or of every 60 and so close to the text, at places of its own.
        for j in range(i % 7, 200, 60 if i % 4 == 0 else 30):
            own[j + i % 17 if j + i % 17 < 200 else j] = f"own{i}of{j}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compared = []

    def counted(docs, pairs, reps, idf, settings):
        compared.append(pairs.count())
        return similar_links(docs, pairs, reps, idf, settings)

    similar_links = near_dedup.similar_links
    monkeypatch.setattr(near_dedup, "similar_links", counted)
    s = near_dedup.Settings()
    found = near_dedup.near_classes(docs, s).collect()
    text_of = dict(rows)
    classes = defaultdict(set)
    for r in found:
        classes[bytes(r.class_node)].add((r.doc_id, text_of[r.doc_id]))
    assert {frozenset(c) for c in classes.values()} == brute_classes(rows, s)
    assert sum(compared) <= 10 * len(rows)


def test_near_stage_keeps_one_row_of_each_class(clashing, nothing):
    found = near_dedup.near_classes(clashing)
    kept = near_dedup.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == found.select("class_node").distinct().count()
    assert near_dedup.near_classes(nothing).count() == 0
    assert near_dedup.keep_one(nothing).count() == 0
