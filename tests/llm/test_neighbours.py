"""Candidate share and recall of the search at two sizes, hot groups, ties."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.llm import neighbours


def vectors(n, seed=5):
    """Unit vectors of 64 components around ten centres, as far apart as those of the given table."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.125, (n, 64)) + rng.normal(0, 0.02, (10, 64))[rng.integers(0, 10, n)]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n, most", [(2_000, 0.35), (100_000, 0.10)])
def test_share_and_recall(n, most):
    """Of the hashing alone, as the tasks do it: what a query's probes hold, against brute force."""
    cfg = neighbours.CrossPolytopeConfig()
    p = neighbours.plan(n, 64, cfg)
    x = vectors(n)
    q = np.arange(0, n, n // 50)[:50]
    seen = np.zeros((len(q), n), bool)
    for t in range(cfg.tables):
        own = np.concatenate([neighbours.codes(x[i : i + 4096], cfg, p, t) for i in range(0, n, 4096)])
        for k, probes in enumerate(neighbours.probed(x[q], cfg, p, t)):
            hit = np.zeros(p.buckets, bool)
            hit[probes] = True
            seen[k] |= hit[own]
    hits = 0
    for k, i in enumerate(q):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += seen[k][np.argsort(d)[:10]].sum()
    assert seen.mean() < most
    assert hits >= 0.9 * 10 * len(q)


def test_probes_are_the_best_buckets():
    cfg = neighbours.CrossPolytopeConfig(tables=2)
    p = neighbours.Plan((16, 16, 6), 40, 1)
    x = vectors(20)[:, :8]
    for t in range(2):
        a = [neighbours.axes(x, cfg, t, k, m) for k, m in enumerate(p.parts)]
        every = (a[0][:, :, None, None] + a[1][:, None, :, None] + a[2][:, None, None, :]).reshape(20, -1)
        got = neighbours.probed(x, cfg, p, t)
        for row, codes in zip(every, got, strict=True):
            assert len(set(codes)) == 40 and sorted(row[codes]) == sorted(row)[-40:]
        assert (every.argmax(1) == neighbours.codes(x, cfg, p, t)).all()


def test_bounds_hold_the_distance():
    x = vectors(200) * np.random.default_rng(0).lognormal(0, 3, (200, 1))
    packed, step, away = neighbours._bytes(x)
    y = np.frombuffer(b"".join(packed), np.int8).reshape(x.shape) * step[:, None]
    d, e = (np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)) for z in (x, y))
    slack = away[:, None] + away[None]
    assert (e - slack <= d).all() and (d <= e + slack).all()


def test_hot_group_and_ties(spark):
    """Half of the rows are one vector: blocks share them out, and ties go to the smaller ids."""
    x = vectors(300)
    rows = [(i, (x[0] if i % 2 else x[i]).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cfg = neighbours.CrossPolytopeConfig(share=1.0, block_rows=16)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0, cfg).collect()}
    v = np.array([r[1] for r in rows])
    for q in (0, 100, 200):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(300), d))[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, d[i]) for i in want]
    assert neighbours.nearest(df, F.col("vec_id") < 0).count() == 0


def test_probing_ten_million_vectors_is_bounded():
    """What the lists are chosen from stays under a tenth of all sums, a batch under its memory, and the choice is exact."""
    import tracemalloc

    cfg = neighbours.CrossPolytopeConfig()
    p = neighbours.plan(10_000_000, 64, cfg)
    x = np.random.default_rng(0).normal(size=(6, 64))
    tracemalloc.start()
    got = neighbours.probed(x, cfg, p, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.shape == (6, p.probes) and peak < 400_000_000
    code, score = np.zeros((6, 1), np.int64), np.zeros((6, 1))
    for part, most in enumerate(p.parts):
        a = neighbours.axes(x, cfg, 0, part, most)
        score = (score[:, :, None] + a[:, None, :]).reshape(6, -1)
        code = (code[:, :, None] * most + np.arange(most)).reshape(6, -1)
        if score.shape[1] > p.probes:
            best = np.argpartition(-score, p.probes - 1, axis=1)[:, : p.probes]
            code, score = np.take_along_axis(code, best, 1), np.take_along_axis(score, best, 1)
    assert all(set(a) == set(b) for a, b in zip(got.tolist(), code.tolist(), strict=True))
    i, _ = neighbours._near_pairs(p.probes, 128, p.probes)
    assert len(i) < p.probes * 128 / 10
