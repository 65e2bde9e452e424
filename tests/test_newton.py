"""Many models in one Newton: each equals its own fit, and scans do not grow with the number of models."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.operators import metrics, models, newton

KIND = "g string, season long, cat string, a double, b double, empty double, flat double, y double, n double"


def rows(rng, n=900):
    out = []
    for i in range(n):
        a, b = float(rng.normal(3, 2)), float(rng.exponential())
        cat = ["u", "v", None][int(rng.integers(3))]
        z = 0.6 * (a - 3) - 0.8 * b + (0.7 if cat == "u" else 0.0)
        y, k = float(rng.random() < 1 / (1 + np.exp(-z))), float(rng.poisson(np.exp(min(0.4 * z, 2))))
        out.append((["p", "q", "r", None][int(rng.integers(4))], 2000 + int(rng.integers(4)), cat, a if rng.random() > 0.2 else None, b if rng.random() > 0.1 else None, None, 5.0, y, k))
    return out


def single(part, fields, cats, label, link, ridge):
    """Coefficients by plain Newton steps on one model's rows."""
    at = {"a": 3, "b": 4, "empty": 5, "flat": 6}
    cols, flags = [], []
    for f in fields:
        v = [r[at[f]] for r in part]
        have = [x for x in v if x is not None]
        med = float(np.median(have)) if have else 0.0
        cols.append([med if x is None else x for x in v])
        flags.append([float(x is None) for x in v])
    x = np.array(cols + flags).T
    sd = x.std(0, ddof=1)
    x = np.where(sd > 1e-12, (x - x.mean(0)) / np.where(sd > 1e-12, sd, 1), 0.0)
    hot = np.array([[float((r[2] or "Unknown") == c) for c in cats] for r in part])
    x = np.column_stack([np.ones(len(part)), x, hot]) if cats else np.column_stack([np.ones(len(part)), x])
    y = np.array([r[label] for r in part])
    pen = np.diag([0.0, *[ridge * (1 if link == "logistic" else len(part))] * (x.shape[1] - 1)])
    beta = np.zeros(x.shape[1])
    beta[0] = 0.0 if link == "logistic" else np.log(y.mean())
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta)) if link == "logistic" else np.exp(x @ beta)
        w = p * (1 - p) if link == "logistic" else p
        beta = beta + np.linalg.lstsq(x.T @ (x * w[:, None]) + pen, x.T @ (y - p) - pen @ beta, rcond=None)[0]
    return beta


@pytest.mark.parametrize("link", ["logistic", "poisson"])
def test_every_model_equals_its_own_fit(spark, link):
    data = rows(np.random.default_rng(3))
    df = spark.createDataFrame(data, KIND).repartition(5)
    label, ridge = ("y", 0.5) if link == "logistic" else ("n", 0.1)
    spec = newton.Spec({"one": ["a"], "all": ["a", "b", "empty", "flat"]}, label, ("cat",), by="g", season="season", uptos=(2001, 2003), link=link, ridge=ridge)
    got = newton.fit(df, spec)
    assert len(got.models) == 3 * 2 * 2
    for m in got.models:
        part = [r for r in data if r[0] == m.group and r[1] <= m.upto]
        assert m.rows == len(part)
        assert m.beta == pytest.approx(single(part, spec.families[m.family], ["Unknown", "u", "v"], 7 if link == "logistic" else 8, link, ridge), abs=1e-6)
    scored = got.score(df, "all", "p").collect()
    assert all((r["p"] is None) == (r["g"] is None or r["season"] <= 2001) for r in scored)
    table = got.table(df)
    assert table.count() == sum(len(m.beta) for m in got.models) and table.columns == ["grp", "upto", "family", "term", "coefficient"]


def test_scans_do_not_grow_with_groups(spark):
    rng = np.random.default_rng(5)
    make = lambda groups: spark.createDataFrame([(f"g{i % groups}", float(rng.normal()), float(rng.random() < 0.4)) for i in range(60 * groups)], "g string, x double, y double")
    few, many = (newton.fit(make(n), newton.Spec({"f": ["x"]}, "y", by="g")) for n in (2, 40))
    assert len(many.models) == 40 and many.scans <= few.scans + 3


def test_medians_are_exact_in_every_cell_and_never_sorted_on_the_driver(spark):
    rng = np.random.default_rng(1)
    data = [(("p", "q")[int(rng.integers(2))], int(rng.integers(4)), float(rng.normal()), float(rng.integers(0, 5)) if rng.random() > 0.3 else None, None) for _ in range(3_000)]
    df = spark.createDataFrame(data, "_g string, _s long, x double, few double, none double")
    cells = [("p", 1), ("p", 3), ("q", 0), ("q", 3)]
    told = spark.createDataFrame([(i, g, u) for i, (g, u) in enumerate(cells)] + [(4, None, None)], "cell int, _g string, _upto long")
    out = newton.prefix_medians(df, ["x", "few", "none"], told)
    got = {(r["cell"], r["field"]): r["median"] for r in out.collect()}
    for i, (g, u) in enumerate([*cells, (None, None)]):
        for f, k in (("x", 2), ("few", 3)):
            assert got[i, f] == pytest.approx(np.median([r[k] for r in data if (g is None or r[0] == g) and (u is None or r[1] <= u) and r[k] is not None]), abs=0)
    assert not any(f == "none" for _, f in got)
    whole = models.medians(df.drop("_g", "_s"), ["x", "few", "none"])
    assert whole == {"x": np.median([r[2] for r in data]), "few": np.median([r[3] for r in data if r[3] is not None]), "none": 0.0}


def test_separable_rows_converge_and_limits_are_kept(spark):
    df = spark.createDataFrame([("g", float(i), float(i >= 10)) for i in range(20)], "g string, x double, y double")
    got = newton.fit(df, newton.Spec({"f": ["x"]}, "y", ridge=1e-3))
    assert got.models[0].done and np.abs(got.models[0].beta).max() < 100
    with pytest.raises(ValueError, match="most_models"):
        newton.fit(df.withColumn("g", F.col("x").cast("string")), newton.Spec({"f": ["x"]}, "y", by="g", most_models=10))
    with pytest.raises(RuntimeError, match="did not converge"):
        newton.fit(df, newton.Spec({"f": ["x"]}, "y", ridge=1e-3, steps=2))
    assert newton.fit(df.limit(0), newton.Spec({"f": ["x"]}, "y")).score(df, "f", "p").where("p IS NOT NULL").count() == 0


def test_poisson_ridge_is_on_the_mean_loss(spark):
    """The intercept-only optimum is the mean; with one field the gradient of mean loss plus alpha/2 b^2 vanishes."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=500)
    y = rng.poisson(np.exp(0.3 + 0.5 * x)).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    m = newton.fit(df, newton.Spec({"f": ["x"]}, "y", link="poisson", ridge=0.15)).models[0]
    z = (x - x.mean()) / x.std(ddof=1)
    mu = np.exp(m.beta[0] + m.beta[1] * z)
    assert np.mean(mu - y) == pytest.approx(0, abs=1e-8)
    assert np.mean((mu - y) * z) + 0.15 * m.beta[1] == pytest.approx(0, abs=1e-8)


def test_order_statistics_are_those_of_the_sorted_values(spark):
    """Every 64th of repeated, missing and not-a-number values, without one exchange of all of them."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=3_000).round(2)
    data = [(float(v) if i % 5 else None, float("nan") if i % 400 == 0 else float(v) ** 3, None) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "a double, b double, c double").repartition(3)
    at = lambda n: [(n - 1) * b // 64 for b in range(1, 64)]
    got = metrics.order_statistics(df, ["a", "b", "c"], at)
    for i in (0, 1):
        have = np.sort([r[i] for r in data if r[i] is not None])
        assert got[0, i] == {p: have[p] for p in at(len(have))}
    assert (0, 2) not in got
