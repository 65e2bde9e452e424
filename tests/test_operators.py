"""Aggregates, metrics, prices, backtest, models, audits, sources."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.operators import aggregates as agg
from cutline.operators import audit, metrics, models, prices
from cutline.operators import backtest as bt
from cutline.sources import quotes, schema, sinks

T0 = datetime(2024, 1, 1)


def test_zone_counts_unknown_air_poisons_one_counter(spark):
    rows = [("g", "rushing", 4, None), ("g", "receiving", 18, 20), ("g", "receiving", 3, 1), ("h", "receiving", 9, None)]
    got = {r["g"]: r for r in agg.zone_counts(spark.createDataFrame(rows, "g string, kind string, yardline int, air int"), ["g"]).collect()}
    assert (got["g"]["inside_5_carries"], got["g"]["red_zone_targets"], got["g"]["end_zone_targets"], got["g"]["goal_line"]) == (1, 2, 1, 2)
    assert got["h"]["end_zone_targets"] is None and got["h"]["red_zone_targets"] == 1


def test_inferred_total(spark):
    df = spark.createDataFrame([("t", 40.0, 0.5), ("t", 60.0, 0.75), ("t", 1.0, 0.0)], "t string, n double, s double")
    assert agg.inferred_total(df, ["t"], "n", "s").head()["inferred_total"] == 80


def test_value_rollup(spark):
    rows = [("g", "a", "rushing", 0.2), ("g", "a", "rushing", 0.1), ("g", "a", "receiving", 0.05), ("g", "b", "rushing", 0.3)]
    got = {r["m"]: r for r in agg.value_rollup(spark.createDataFrame(rows, "g string, m string, k string, v double"), group=["g"], member="m", kind="k", value="v").collect()}
    assert got["a"]["total_value"] == pytest.approx(0.35) and got["a"]["rushing_share"] == pytest.approx(0.5) and got["b"]["value_per_target"] is None


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(3)
    p, y = rng.integers(1, 20, 300) / 20, rng.integers(0, 2, 300)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int")
    wins = (p[y == 1][:, None] > p[y == 0]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0]).mean()
    assert metrics.auc(df, "p", "y").head()[0] == pytest.approx(wins)
    table = metrics.reliability(df, "p", "y", metrics.PLAYER_BINS).collect()
    assert len(table) == 7 and sum(r["n"] for r in table) == 300
    assert metrics.probability_metrics(df, "p", "y").head()["brier"] == pytest.approx(((p - y) ** 2).mean())


def test_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([(i % 7, float(i)) for i in range(50)], "c int, v double")
    reps = lambda d: sorted((r[0], round(r[1], 9)) for r in metrics.cluster_bootstrap(d, "c", F.sum("v"), F.count(F.lit(1)).cast("double"), 30).collect())
    assert reps(df) == reps(df.repartition(5))
    assert len(reps(df)) == 30


def test_consensus_counts_books(spark):
    rows = [("x", "a", -110, T0), ("x", "b", 100, T0), ("x", "c", 120, T0), ("x", "d", 130, T0), ("y", "a", 120, T0), ("y", "a", 140, T0), ("y", "b", 100, T0)]
    got = {r["k"]: r for r in prices.consensus(spark.createDataFrame(rows, "k string, book string, price int, quote_time timestamp"), ["k"]).collect()}
    assert got["x"]["median_decimal"] == pytest.approx(2.1) and got["x"]["median_american"] == pytest.approx(110) and got["x"]["best_decimal"] == 2.3
    assert got["y"]["books"] == 2 and not got["y"]["enough_books"]


def test_one_per_book_newest_then_better(spark):
    rows = [("x", "a", 100, T0, 1), ("x", "a", 150, T0, 2), ("x", "b", 300, T0, 3), ("x", "b", 110, T0 + timedelta(minutes=1), 4)]
    df = spark.createDataFrame(rows, "k string, book string, price int, quote_time timestamp, id int")
    assert {r["book"]: r["id"] for r in prices.one_per_book(df, ["k"], tie="id").collect()} == {"a": 2, "b": 4}


def test_portfolio_drawdown_streak(spark):
    rows = [(1, True, 2.5), (2, False, -1.0), (3, False, -1.0), (4, True, 1.0)]
    df = spark.createDataFrame(rows, "i int, won boolean, profit double").withColumn("k", F.lit("s")).withColumns({c: F.lit(0.1) for c in ("decimal", "ev", "edge", "clv")})
    p = bt.portfolio(df, ["k"]).head()
    assert (p["bets"], p["wins"], p["net"]) == (4, 2, 1.5)
    assert tuple(bt.drawdown(df, ["k"], ["i"]).head())[1:] == (1.5, 2.5, 2.0)
    assert bt.losing_streak(df, ["k"], ["i"]).head()["longest_losing_streak"] == 2
    assert bt.winner_share(df, ["k"]).head()["top1_share"] == pytest.approx(2.5 / 3.5)


def test_wager_statuses(spark):
    rows = [(False, True, True, False, True), (True, False, True, False, True), (True, True, None, True, False), (True, True, True, False, True), (True, True, True, False, False), (True, True, None, False, False)]
    df = spark.createDataFrame(rows, "bet boolean, settled boolean, played boolean, inactive boolean, won boolean")
    s = bt.wager_status(bet=F.col("bet"), settled=F.col("settled"), played=F.col("played"), inactive=F.col("inactive"), won=F.col("won"), action_on_absent=F.lit(False))
    assert [r[0] for r in df.select(s).collect()] == ["not_bet", "pending", "void", "won", "lost", "pending"]


def test_allocation_sums_to_expectation(spark):
    rows = [("g", 1.0, None), ("g", 3.0, 1.0), ("h", 0.0, 0.0), ("h", None, None), ("z", 0.0, 0.0), ("z", 0.0, None)]
    out = models.allocate(spark.createDataFrame(rows, "g string, a double, b double"), ["g"], {"a": 0.5, "b": 0.5}, F.lit(3.0)).groupBy("g").agg(F.sum("lambda").alias("s"), F.max("share").alias("m")).collect()
    assert {r["g"]: (round(r["s"], 9), round(r["m"], 9)) for r in out}["g"][0] == 3.0
    # a member without any share scores 1; only a group of zeros is dealt equally
    assert {r["g"]: r["m"] for r in out}["h"] == 1.0 and {r["g"]: r["m"] for r in out}["z"] == 0.5


def test_logistic_equals_newton(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-x))).astype(int)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    m = models.fit_logistic(df, ["x"], "y", c=1.0)
    z = (x - x.mean()) / x.std(ddof=1)
    w = np.zeros(2)
    d = np.stack([np.ones(400), z], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-d @ w))
        g = d.T @ (p - y) + np.array([0, w[1]])
        h = d.T @ (d * (p * (1 - p))[:, None]) + np.diag([0, 1.0])
        w -= np.linalg.solve(h, g)
    lr = m.stages[-1]
    assert [lr.intercept, lr.coefficients[0]] == pytest.approx(w.tolist(), abs=1e-3)


def members(rng, w, rows=600):
    """Members of groups of two to four with three families, some missing, one group of zeros, and chances by known weights."""
    out = []
    while len(out) < rows:
        g, n = len(out), int(rng.integers(2, 5))
        fam = rng.random((n, 3)) * (g > 20)
        have = rng.random((n, 3)) > 0.25
        use = have @ w
        raw = np.where(use > 0, np.where(have, fam, 0) @ w / np.where(use > 0, use, 1), 1.0)
        raw = np.where(raw.sum() == 0, 1.0, raw)
        p = 1 - np.exp(-0.7 * n * raw / raw.sum())
        out += [(g, *(float(x) if ok else None for x, ok in zip(f, h, strict=True)), 0.7 * n, float(q)) for f, h, q in zip(fam, have, p, strict=True)]
    return out


def brier_of(rows, w):
    total = n = 0.0
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        raw = []
        for r in own:
            use = sum(x for x, f in zip(w, r[1:4], strict=True) if f is not None)
            raw.append(sum(x * f for x, f in zip(w, r[1:4], strict=True) if f is not None) / use if use > 0 else 1.0)
        raw = raw if sum(raw) > 0 else [1.0] * len(own)
        total += sum((1 - np.exp(-r[4] * x / sum(raw)) - r[5]) ** 2 for r, x in zip(own, raw, strict=True))
        n += len(own)
    return total / n


def test_simplex_fit_recovers_weights_and_beats_a_grid(spark):
    rng = np.random.default_rng(1)
    kind = "g long, a double, b double, c double, e double, y double"
    true = np.array([0.2, 0.3, 0.5])
    rows = members(rng, true)
    df = spark.createDataFrame(rows, kind).cache()
    w, loss, scans = models.fit_simplex(df, ["g"], ["a", "b", "c"], "e", "y")
    assert w == pytest.approx(true, abs=1e-4) and loss < 1e-9 and scans < 15
    noisy = [(*r[:5], float(rng.random() < r[5])) for r in rows]
    df = spark.createDataFrame(noisy, kind).cache()
    w, loss, _ = models.fit_simplex(df, ["g"], ["a", "b", "c"], "e", "y")
    assert loss == pytest.approx(brier_of(noisy, w), abs=1e-9) and w.sum() == pytest.approx(1) and (w >= 0).all()
    assert loss <= min(brier_of(noisy, (i / 10, j / 10, (10 - i - j) / 10)) for i in range(1, 10) for j in range(1, 10 - i)) + 1e-9
    with pytest.raises(RuntimeError, match="no convergence"):
        models.fit_simplex(df, ["g"], ["a", "b", "c"], "e", "y", most=1)
    with pytest.raises(ValueError, match="no rows"):
        models.fit_simplex(df.limit(0), ["g"], ["a", "b", "c"], "e", "y")


def test_allocation_gradient_is_that_of_the_loss(spark):
    rows = members(np.random.default_rng(2), np.array([0.5, 0.2, 0.3]), 200)
    df = spark.createDataFrame(rows, "g long, a double, b double, c double, e double, y double").withColumn("y", F.round("y")).cache()
    w = np.array([0.4, 0.35, 0.25])
    loss, g, h = models.allocation_loss(df, ["g"], ["a", "b", "c"], "e", "y", w)
    for i in range(3):
        step = np.eye(3)[i] * 1e-5
        up, down = (models.allocation_loss(df, ["g"], ["a", "b", "c"], "e", "y", w + s)[0] for s in (step, -step))
        assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    assert np.linalg.eigvalsh(h)[0] > -1e-12


def test_forward_refuses_leakage(spark):
    df = spark.createDataFrame([(2020,), (2021,)], "season int")
    with pytest.raises(ValueError):
        models.forward(df, "season", 2021, 2021)
    with pytest.raises(ValueError):
        schema.season_firewall(df, 2020, 2020)


def test_schema_guards(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="c"):
        schema.require_columns(df, ["a", "c"], "x")
    with pytest.raises(ValueError, match="b"):
        schema.closed(df, spark.createDataFrame([], "a int").schema)
    with pytest.raises(ValueError):
        schema.feature_matrix(df, ["a", "b"], forbidden=["b"])


def test_snapshots_round_trip(spark, tmp_path):
    doc = {"timestamp": "2024-01-01T00:00:30Z", "event": "e", "bookmakers": [{"key": "b", "markets": [{"key": "m", "last_update": "2024-01-01T00:00:00Z", "outcomes": [{"name": "Over", "description": "P", "point": 1.5, "price": 120}]}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    good, broken = quotes.read_snapshots(spark, str(tmp_path), whole_files=True)
    assert [r["value"] for r in broken.collect()] == ["{broken"]
    flat = quotes.flatten(good).collect()
    assert [(r["book"], r["side"], r["line"], r["price"]) for r in flat] == [("b", "Over", 1.5, 120)]
    ok, bad = quotes.parse_snapshots(spark.createDataFrame([(json.dumps(doc),), ("{broken",)], "value string"))
    assert (ok.count(), bad.count()) == (1, 1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    sinks.write_once(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sinks.write_once(df, str(tmp_path / "o"))
    f = sinks.fingerprint(df)
    sinks.verify_fingerprint(df.orderBy(F.desc("a")), f)
    with pytest.raises(ValueError):
        sinks.verify_fingerprint(df.where("a = 1"), f)
    reg = df.select(F.sha2("b", 256).alias("sha256"))
    again = spark.createDataFrame([("x",), ("z",), ("z",)], "v string").select(F.sha2("v", 256).alias("sha256"))
    assert sinks.new_artifacts(reg, again).count() == 1


def test_audits_count_injected_violations(spark):
    rows = [(T0, T0 - timedelta(1), T0), (T0, T0, T0), (T0, None, T0 + timedelta(1))]
    df = spark.createDataFrame(rows, "cut timestamp, s timestamp, i timestamp")
    assert [r["status"] for r in audit.temporal(df, "cut", ["s"], ["i"]).collect()] == ["PASS", "BLOCKED", "BLOCKED"]
    with pytest.raises(ValueError):
        audit.require_none(audit.count_violations(df, {"late": F.col("i") > F.col("cut")}))
    with pytest.raises(ValueError):
        audit.require_budget(spark.createDataFrame([(10,)], "c int"), "c", 9)
    ok, bad = audit.ambiguous(spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"])
    assert (ok.count(), bad.count()) == (1, 2)


def test_imputer_keeps_a_column_without_values(spark):
    from cutline.operators import models

    rows = [(float(i % 7), None, float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, empty double, label double")
    m = models.fit_logistic(df, ["a", "empty"], "label")
    assert models.score_probability(m, df, ["a", "empty"]).where("p IS NULL").count() == 0


def test_group_models_need_rows_and_positives(spark):
    from cutline.operators import models

    rows = [(g, float(i % 5), float(i % 3 == 0)) for g, n in (("a", 90), ("b", 10)) for i in range(n)]
    df = spark.createDataFrame([*rows, (None, 1.0, 0.0)], "g string, x double, label double")
    out = models.group_models(df, df, "g", ["x"], "label", min_rows=50, min_positives=20)
    assert {(r["g"], r["status"], r["p"] is None) for r in out.collect()} == {("a", "fitted", False), ("b", "insufficient", True), (None, "insufficient", True)}


def test_quantiles_and_upper_median_by_group(spark):
    import random

    from cutline.operators import metrics

    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)])) for _ in range(900)]
    df = spark.createDataFrame([(g, float(x) if x is not None else None) for g, x in rows], "g string, x double")
    got = {r["g"]: (r["q"], r["m"]) for r in metrics.quantiles(df, "x", {"q": 0.9, "m": 0.5}, ["g"]).collect()}
    up = {r["g"]: r["upper_median"] for r in metrics.upper_median(df, "x", ["g"]).collect()}
    for g in ("a", "b", None):
        xs = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == pytest.approx((float(np.quantile(xs, 0.9)), float(np.quantile(xs, 0.5))))
        assert up[g] == xs[len(xs) // 2]
    assert metrics.quantiles(df.limit(0), "x", {"q": 0.9}, ["g"]).count() == 0


def test_line_chances(spark):
    import math

    from cutline.functions import dist

    def nb(mean, alpha, k):
        if alpha == 0:
            return math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        r = 1 / alpha
        return math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(r / (r + mean)) + k * math.log(mean / (r + mean)))

    cases = [(60.0, 0.0, 65.5), (60.0, 0.0, 65.0), (2.3, 0.9, 0.0), (900.0, 0.0, 880.0), (0.5, 0.2, 3.5)]
    df = spark.createDataFrame(cases, "m double, a double, l double")
    for (m, a, line), r in zip(cases, df.select(dist.line_chances(F.col("m"), F.col("a"), F.col("l")).alias("o")).collect(), strict=True):
        under = sum(nb(m, a, k) for k in range(math.ceil(line)))
        push = nb(m, a, int(line)) if line == int(line) else 0.0
        assert (r["o"]["over"], r["o"]["under"], r["o"]["push"]) == pytest.approx((1 - under - push, under, push), abs=1e-9)
    zero = spark.createDataFrame([(0.0, 0.0, 0.5), (0.0, 0.0, 0.0), (1.0, 0.0, -1.0)], "m double, a double, l double").select(dist.line_chances(F.col("m"), F.col("a"), F.col("l")).alias("o")).collect()
    assert [tuple(r["o"]) if r["o"] else None for r in zero] == [(0.0, 1.0, 0.0), (0.0, 0.0, 1.0), None]


def test_band_join_fails_on_more_than_one(spark):
    from cutline.operators import joins

    a = spark.createDataFrame([(1, "k", 0), (2, None, 0)], "id int, k string, s int").withColumn("t", F.timestamp_seconds("s"))
    b = spark.createDataFrame([("k", 50, "x"), ("k", -60, "y"), ("k", 61, "z"), (None, 0, "n")], "k2 string, s2 int, v string").withColumn("t2", F.timestamp_seconds("s2"))
    args = {"left_time": "t", "right_time": "t2", "seconds": 60, "left_id": "id"}
    assert sorted((r["id"], r["v"], r["n_matches"]) for r in joins.band_join(a, b, [("k", "k2")], **args).collect()) == [(1, "x", 2), (1, "y", 2)]
    with pytest.raises(Exception, match="more than one match"):
        joins.band_join(a, b, [("k", "k2")], **args, single=True).collect()
