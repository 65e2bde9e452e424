"""Poisson boosting against a per-row reference, and against squares of the logarithm."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.operators import boosting, metrics, models


def data(rng, n=700):
    a, b = rng.normal(size=n), rng.exponential(size=n).round(1)
    y = rng.poisson(np.exp(0.3 * (a > 0.4) + 0.5 * (b > 1) * (a < 0) - 0.6))
    return [(float(x) if rng.random() > 0.15 else None, float(z), float(k)) for x, z, k in zip(a, b, y, strict=True)]


def reference(rows, cfg):
    """Margins of each row after the rounds, tree by tree and row by row."""
    fields = [[r[0] for r in rows], [r[1] for r in rows]]
    cuts = []
    for v in fields:
        have = sorted(x for x in v if x is not None)
        cuts.append(sorted({have[int(np.floor((len(have) - 1) * (b / cfg.bins)))] for b in range(1, cfg.bins)}))
    bins = [[0 if x is None else 1 + sum(x > c for c in cut) for x in v] for v, cut in zip(fields, cuts, strict=True)]
    y = [r[2] for r in rows]
    margin = [float(np.log(np.mean(y)))] * len(rows)
    for _ in range(cfg.trees):
        mu = [np.exp(m) for m in margin]
        leaf = lambda own: -cfg.rate * sum(mu[i] - y[i] for i in own) / (sum(mu[i] for i in own) + cfg.l2)
        score = lambda own: sum(mu[i] - y[i] for i in own) ** 2 / (sum(mu[i] for i in own) + cfg.l2)
        leaves, level = {0: list(range(len(rows)))}, [0]
        for depth in range(cfg.depth):
            best = {}
            for node in level:
                own = leaves[node]
                for f in range(2):
                    for b in range(cfg.bins + 1):
                        left, right = [i for i in own if bins[f][i] <= b], [i for i in own if bins[f][i] > b]
                        if min(len(left), len(right)) < cfg.least_rows:
                            continue
                        gain = round(score(left) + score(right) - score(own), 9)
                        if gain > 0 and (node not in best or gain > best[node][0]):
                            best[node] = (gain, left, right)
            kept = sorted(best, key=lambda x: (-best[x][0], x))[: cfg.leaves - len(leaves)]
            for node in kept:
                del leaves[node]
                leaves[2 * node + 1], leaves[2 * node + 2] = best[node][1:]
            level = [c for node in kept for c in (2 * node + 1, 2 * node + 2)]
        for own in leaves.values():
            v = leaf(own)
            for i in own:
                margin[i] += v
    return margin


def test_three_rounds_equal_a_row_by_row_reference(spark):
    rows = data(np.random.default_rng(4))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, a double, b double, y double").repartition(4)
    cfg = boosting.BoostConfig(trees=3, rate=0.3, bins=12, least_rows=20, refresh=2)
    model = boosting.fit_counts(df, ["a", "b"], "y", cfg)
    got = {r["i"]: r["mu"] for r in df.select("i", model.mean().alias("mu")).collect()}
    want = np.exp(reference(rows, cfg))
    assert [got[i] for i in range(len(rows))] == pytest.approx(want.tolist(), rel=1e-9)
    assert len(model.trees) == 3 and max(len(t.value) for t in model.trees) <= cfg.leaves and sum(model.gains().values()) > 0


def test_it_beats_squares_of_the_logarithm_and_a_constant(spark):
    rows = data(np.random.default_rng(9), 1_500)
    df = spark.createDataFrame(rows, "a double, b double, y double")
    cfg = boosting.BoostConfig(trees=12, rate=0.2, bins=16, least_rows=40)
    deviance = lambda t: metrics.count_metrics(t, "mu", "y").head()["deviance"]
    ours = deviance(df.withColumn("mu", boosting.fit_counts(df, ["a", "b"], "y", cfg).mean()))
    squares = deviance(models.score_mean(models.fit_trees(df, ["a", "b"], "y", counts=True, trees=12), df, ["a", "b"], log=True))
    constant = deviance(df.withColumn("mu", F.lit(float(np.mean([r[2] for r in rows])))))
    assert ours < squares and ours < constant


def test_no_rows_and_no_counts_give_a_constant(spark):
    kind = "a double, b double, y double"
    for rows in ([], [(1.0, 2.0, 0.0)] * 30, [(1.0, 2.0, None)]):
        model = boosting.fit_counts(spark.createDataFrame(rows, kind), ["a", "b"], "y", boosting.BoostConfig(trees=2))
        assert not model.trees
        assert spark.range(1).select(F.lit(1.0).alias("a"), F.lit(2.0).alias("b")).select(model.mean()).head()[0] == pytest.approx(1e-9)


def test_cells_grow_the_trees_of_their_rows_whatever_the_last_bit(spark):
    """Copies that differ by the order of a sum are one cell, and classifiers and squares come close to Spark's own."""
    base = [(0.1 + 0.2, 1.0, 1.0), (0.3, 1.0, 1.0), (0.7, 2.0, 0.0), (None, 2.0, 0.0)] * 40
    df = spark.createDataFrame(base, "a double, b double, y double")
    assert boosting.quantile_cuts(df, ["a"], 4) == [[pytest.approx(0.3), pytest.approx(0.7)]]
    rows = boosting.cells(df, ["a", "b"], ["y"], boosting.quantile_cuts(df, ["a", "b"], 4))
    assert rows.count() == 3 and sum(r["y_n"] for r in rows.collect()) == 160

    from pyspark.ml.classification import GBTClassifier

    rows = [(*r, float(r[2] > 0)) for r in data(np.random.default_rng(5), 1_200)]
    df = spark.createDataFrame(rows, "a double, b double, k double, y double")
    mine = models.score_probability(models.fit_trees(df, ["a", "b"], "y", trees=5), df, ["a", "b"])
    n, rate, depth, leaf = models.TREES[0]
    own = models._fit(df, ["a", "b"], [], GBTClassifier(labelCol="y", maxIter=5, stepSize=rate, maxDepth=depth, minInstancesPerNode=leaf, seed=1))
    theirs = models.score_probability(own, df, ["a", "b"])
    loss = lambda t: metrics.probability_metrics(t, "p", "y").head()["log_loss"]
    assert loss(mine) == pytest.approx(loss(theirs), rel=0.01)
