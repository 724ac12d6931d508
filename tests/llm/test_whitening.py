from collections import Counter

import numpy as np
import pytest
from fleetbump.llm import queries, spectrum, whitening
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int"


def test_inertia_counts_equal_eigenvalues():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 20):
        for a in (rng.standard_normal((n, n)), np.diag(np.arange(n) - 1.0), np.ones((n, n)), np.eye(n)[::-1]):
            a = (a + a.T) / 2
            w = np.linalg.eigvalsh(a)
            for s in rng.uniform(-3, 3, 10):
                assert spectrum.below(a, s) == (w < s).sum()


@pytest.mark.parametrize("values", [[9, 5, 3, 1, 0.5], [4, 4, 4, 1, 1], [7, 7 * (1 - 1e-12), 2, 2 * (1 - 1e-9), 1], [5, 2, 0, 0, 0]])
def test_leading_pairs(values):
    rng = np.random.default_rng(4)
    for _ in range(5):
        q, _ = np.linalg.qr(rng.standard_normal((5, 5)))
        a = q @ np.diag(values) @ q.T
        found = spectrum.leading(a, 8)
        assert [p.number for p in found] == list(range(1, 1 + sum(v > 0 for v in values)))
        assert np.allclose([p.value for p in found], [v for v in values if v > 0], rtol=1e-13, atol=1e-13)
        u = np.array([p.vector for p in found])
        assert np.allclose(u @ u.T, np.eye(len(u)), atol=1e-9)
        assert np.allclose(a @ u.T, u.T * [p.value for p in found], atol=1e-10)


def plain(vectors, k=8):
    """By whole numbers and a dense eigensolver."""
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s)) for row in x]
    return n, deviation, centred @ u / np.sqrt(e), e / np.trace(v)


def check(rows, ids, vectors, k=8):
    n, deviation, whitened, explained = plain(vectors, k)
    assert len(rows) == len(vectors) * len(explained)
    at = {}
    for r in rows:
        assert (r.n, r.identity_error) == (n, rows[0].identity_error)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        at[r.vec_id, r.component] = r
    assert rows[0].identity_error < 1e-9
    for c in range(1, len(explained) + 1):
        mine = np.array([at[i, c].whitened for i in ids])
        theirs = whitened[:, c - 1]
        assert np.allclose(mine * np.sign(mine @ theirs), theirs, atol=1e-7)
        assert [at[i, c].deviation for i in ids] == deviation


def test_op12_on_a_table(spark):
    found = queries.QUERIES["op12_whitening"](spark, SMALL)
    given = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    good = [r for r in given if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    check(found.collect(), [r.vec_id for r in good], [r.embedding for r in good])
    parted = whitening.whiten(spark.read.parquet(f"{SMALL}/embeddings.parquet").repartition(5))
    key = lambda r: (r.vec_id, r.component)
    for a, b in zip(sorted(found.collect(), key=key), sorted(parted.collect(), key=key), strict=True):
        # Sums of whole numbers do not depend on the split, so neither do the eigenpairs.
        assert (a.vec_id, a.component, a.deviation, a.explained) == (b.vec_id, b.component, b.deviation, b.explained)
        assert abs(a.whitened - b.whitened) < 1e-12


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(4).tolist(), 1) for i in range(40)]
    odd = [(100, None, 1), (101, [1.0, None, 2.0, 3.0], 1), (102, [1.0, float("nan"), 2.0, 3.0], 1), (103, [float("inf")] * 4, 1)]
    odd += [(104, [], 1), (105, [1.0, 2.0], None)]
    named = spark.createDataFrame(rows + odd, SCHEMA).withColumns({c: F.lit("x") for c in ("n", "v", "i", "component", "whitened")})
    check(whitening.whiten(named).collect(), [r[0] for r in rows], [r[1] for r in rows])
    repeated = whitening.whiten(spark.createDataFrame([*rows, rows[0], (None, rows[1][1], 1)], SCHEMA)).collect()
    assert Counter(r.vec_id for r in repeated)[0] == 8
    assert Counter(r.vec_id for r in repeated)[None] == 4


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None, 1)], [(1, [], 1)], [(1, [1.0, 2.0], 1)], [(i, [0.5, 0.5], 1) for i in range(9)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], 1) for i in range(9)], SCHEMA)).collect()
    assert {r.component for r in line} == {1}


def test_large_deviations_are_exact_or_null(spark):
    rows = [(0, [2.0**20, 0.0], 1), (1, [-(2.0**20), 1.0], 1), (2, [2.0**39, 0.0], 1)]
    found = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[2] is None
    _, want, _, _ = plain([r[1] for r in rows[:2]])
    found = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows[:2], SCHEMA)).collect()}
    assert [found[0], found[1]] == want
    with pytest.raises(Exception, match="2\\^40"):
        whitening.whiten(spark.createDataFrame([(0, [2.0**50], 1)], SCHEMA)).collect()
