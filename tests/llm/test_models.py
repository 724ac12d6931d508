import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from fleetbump.llm import hmm, packing


def test_forward_and_expected_counts_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    k, classes = 3, 5
    normal = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = hmm.Model(normal(rng.random(k)), normal(rng.random((k, k))), normal(rng.random((k, classes))))
    seen = [[0], [1, 2, 0], [3, 3, 4, 0], [2, 0]]
    together = hmm.Together([np.array(x, dtype="<u2").tobytes() for x in seen])
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes))
    logs = []
    for x in seen:
        total, own = 0.0, []
        for path in product(range(k), repeat=len(x)):
            p = model.start[path[0]] * np.prod([model.moves[a, b] for a, b in zip(path, path[1:], strict=False)])
            p *= np.prod([model.emits[s, c] for s, c in zip(path, x, strict=True)])
            total += p
            own.append((path, p))
        logs.append(math.log10(total))
        for path, p in own:
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                moves[a, b] += p / total
            for s, c in zip(path, x, strict=True):
                emits[s, c] += p / total
    assert np.allclose(together.log10(model), logs, atol=1e-5)
    found = together.expected(model)
    for a, b in zip(found, (starts, moves, emits), strict=True):
        assert np.allclose(a, b, atol=1e-4)


def test_scores(spark, documents, nothing):
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in documents.collect()]
    trains = [i is None or zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    counts = Counter()
    for (_, words), train in zip(rows, trains, strict=True):
        if train:
            counts.update([*words, None])
    n, v = sum(counts.values()), len(counts)
    log = lambda w: math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1)))
    want = Counter()
    for (i, words), train in zip(rows, trains, strict=True):
        tokens = [*words, None]
        base = round(sum(map(log, tokens)), 6)
        want[i, not train, len(tokens), sum(w in counts for w in tokens), n, base] += 1
    # A small table of frequent words, so that most counts come by the join.
    s = hmm.Settings(own=20, table=40, shapes=16, warm=20, warm_rounds=3)
    found = hmm.score(documents, s).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    again = hmm.score(documents, hmm.Settings(own=20, table=10_000, shapes=16, warm=20, warm_rounds=3)).collect()
    one = {(r.doc_id, r.n_tokens): r.score for r in found}
    assert all(math.isclose(one[r.doc_id, r.n_tokens], r.score, rel_tol=1e-5) for r in again)
    assert hmm.score(nothing, s).count() == 0
    untrained = hmm.score(documents.where("doc_id = 300").selectExpr("13 doc_id", "text"), s).collect()
    assert len(untrained) == 1


def test_class_probabilities_sum_to_one():
    """Known words, and one unknown word of each shared class, share out each class' probability."""
    s = hmm.Settings(own=2, shapes=2)
    v = hmm.Vocabulary(np.array([1, 2], np.uint64), np.array([5.0, 3.0]), np.array([1, 2]), np.array([4.0, 0]), np.array([2.0, 0]), 3, 15, 5)
    assert math.isclose(hmm.class_weights(v, s).sum(), 1.0)
    # Two known words of the first shared class with counts 3 and 1, and an unknown one.
    assert math.isclose(sum((c + 0.5) / (4.0 + 0.5 * 3) for c in (3, 1, 0)), 1.0)


def test_packing(documents, clashing, nothing):
    s = packing.Settings(lengths=(64, 128, 256), shard=20)
    found = packing.pack(documents, s).collect()
    want = Counter()
    for r in documents.collect():
        want[r.doc_id] += len((r.text or "").encode().split()) + 1
    got = Counter()
    bins = defaultdict(list)
    for r in found:
        got[r.doc_id] += r.n_tokens
        assert r.bin_length == min(c for c in s.lengths if c >= r.bin_tokens)
        bins[r.bin_id].append((r.bin_start, r.n_tokens, r.bin_tokens))
    assert got == want
    for spans in bins.values():
        at = 0
        for start, n, _ in sorted(spans):
            assert start == at
            at += n
        assert {total for *_, total in spans} == {at}
    assert packing.sequences(packing.pack(documents, s)).count() == len(bins)
    assert packing.pack(nothing, s).count() == 0
    assert packing.pack(clashing, s).count() == len(found)


def test_best_fit_takes_the_fullest_bin_and_the_least_cost():
    s = packing.Settings(lengths=(10, 20), fixed=4.0, slope=1e9)
    # 20 costs less for each token than 10; then 9 leaves the bin of 11 full.
    placed = packing.best_fit([11, 10, 9, 8], s)
    assert placed == [(0, 0, 20, 20), (1, 0, 20, 18), (0, 11, 20, 20), (1, 10, 20, 18)]
    # What is left fits the short sequence, which then costs less.
    assert packing.best_fit([5], s) == [(0, 0, 10, 5)]
