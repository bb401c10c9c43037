import random

import numpy as np
import pytest

from tallyforge.llm import whitening as wh


def vectors(rng, n, d, rank=None):
    x = rng.normal(size=(n, rank or d)) * np.linspace(3, 0.2, rank or d)
    return (x if rank is None else x @ rng.normal(size=(rank, d))).astype(np.float32)


def scatter(x):
    c = x - x.mean(0)
    return c.T @ c


@pytest.mark.parametrize("n,d,rank", [(1, 5, None), (3, 8, None), (60, 8, None), (200, 30, None), (50, 12, 4), (40, 1, None)])
def test_rank_one_updates_and_merges(n, d, rank):
    rng = np.random.default_rng(n + d)
    x = np.floor(vectors(rng, n, d, rank).astype(float) * 1024)
    x[n // 2 :: 3] = x[0]
    parts = []
    for part in np.array_split(x, 3):
        s = wh.Spectrum.empty(d)
        for v in part:
            s.add(v)
        parts.append(s)
    whole = wh.Spectrum.empty(d)
    for s in parts:
        whole.merge(s)
    want = scatter(x)
    size = max(np.abs(want).max(), 1)
    assert whole.count == n and np.allclose(whole.mean, x.mean(0))
    assert np.abs(whole.vectors @ np.diag(whole.values) @ whole.vectors.T - want).max() < 1e-9 * size * d
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(d)).max() < 1e-10
    assert np.allclose(whole.values, np.linalg.eigvalsh(want), atol=1e-9 * size * d)


def test_weights_and_hard_updates():
    x = np.array([[1.0, 2, 3], [4, 5, 7], [0, 0, 1]])
    a, b = wh.Spectrum.empty(3), wh.Spectrum.empty(3)
    for v, k in zip(x, (5, 1, 3)):
        a.add(v, k)
        for _ in range(k):
            b.add(v)
    assert np.allclose(a.values, b.values, atol=1e-12) and np.allclose(a.mean, b.mean)
    rng = random.Random(1)
    for _ in range(300):
        d = rng.randrange(1, 9)
        values = np.sort([rng.choice([0, 1, 1, 1 + 1e-13, 2, 1e6, rng.random()]) for _ in range(d)]).astype(float)
        v = np.array([rng.choice([0, 1e-12, 1, rng.random(), 1e3]) for _ in range(d)])
        rho = rng.choice([0, 1e-9, 1, 1e4])
        got, u = wh.rank_one(values, np.eye(d), v, rho)
        want = np.diag(values) + rho * np.outer(v, v)
        size = max(np.abs(want).max(), 1)
        assert np.abs(u @ np.diag(got) @ u.T - want).max() < 1e-12 * size * d, (values, v, rho)
        assert np.abs(u.T @ u - np.eye(d)).max() < 1e-11


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "vec_id as x", "1 as row", "2 as n", "3 as component", "4 as label")


def brute(rows, k):
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in x])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    dev = [sum((n * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    return [i for i, _ in kept], n, dev, e[::-1][:k], u[:, ::-1][:, :k], centred, np.trace(cov)


def test_against_a_plain_decomposition(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(rng, 400, 16))]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(5, rows[5][1]), (None, rows[6][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 15 + [None]), (2003, [float("nan")] * 16), (2004, [float("-inf")] + [0.0] * 15), (2005, [1.0, 2.0])]
    got = wh.whiten(frame(spark, rows).repartition(40), wanted=8).select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    ids, n, dev, e, u, centred, trace = brute([r for r in rows if r[0] != 2005], 8)
    assert len(got) == 8 * n and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), d) for i, d in zip(ids, dev))
    assert got[0].identity_error < 1e-9
    for c in range(8):
        mine = {r.vec_id: r for r in got if r.component == c + 1}
        assert abs(mine[0].explained / (e[c] / trace) - 1) < 1e-9
        want = centred @ u[:, c] / np.sqrt(e[c])
        have = np.array([mine[i].whitened for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9


def test_edges(spark):
    assert wh.whiten(frame(spark, [(1, None)])).count() == 0
    assert wh.whiten(frame(spark, [(1, [0.0])]).limit(0)).count() == 0
    one = wh.whiten(frame(spark, [(1, [0.5, 2.0, -1.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, 1, 0, 0.0, 0.0, 0.0) for c in (1, 2, 3)]
    flat = wh.whiten(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert {r.identity_error < 1e-9 for r in flat} == {True}
    assert all(r.whitened == 0 for r in flat if r.component > 1) and any(abs(r.whitened) > 1 for r in flat)
    huge = wh.whiten(frame(spark, [(1, [3e38, 0.0]), (2, [0.0, 1.0])])).collect()
    assert {r.deviation for r in huge} == {None}
