"""Leakage: what the target row holds, or what comes later, never changes its features."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cutline.operators import joins, lag

DAY = timedelta(days=1)
T0 = datetime(2024, 9, 1)


def history(spark, values, entity="a", season=2024):
    rows = [(f"{entity}{i:02d}", entity, season, T0 + 7 * i * DAY, T0 + (7 * i + 1) * DAY, v, 2.0 * v if v is not None else None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "game_id string, entity string, season int, kickoff timestamp, available_at timestamp, m double, whole double")


def targets(df):
    return df.select("game_id", "entity", "season", "kickoff", (F.col("kickoff") - F.expr("INTERVAL 60 MINUTES")).alias("prediction_time"))


def features(spark, df, t=None, **k):
    k = {"metrics": ["m"], "shares": {"share": ("m", "whole")}, "windows": {"last3": 3, "all": None}, "lineage": 8} | k
    return {r["game_id"]: r.asDict() for r in lag.prefix_features(df, targets(df) if t is None else t, ["entity"], **k).collect()}


def test_last3_and_share(spark):
    got = features(spark, history(spark, [float(i) for i in range(1, 9)] + [900.0]))["a08"]
    assert got["last3_m"] == 7.0 and got["last3_share"] == 0.5 and got["n_history"] == 8
    assert got["source_ids"] == ";".join(f"a{i:02d}" for i in range(8))


def test_poisoned_target_changes_nothing(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    t = targets(history(spark, values))
    clean = features(spark, history(spark, values), t)
    for k in range(5):
        poisoned = [900.0 if i >= k else v for i, v in enumerate(values)]
        for i in range(k + 1):
            key = f"a{i:02d}"
            assert features(spark, history(spark, poisoned), t)[key] == clean[key]


def test_result_not_yet_available(spark):
    df = history(spark, [1.0, 2.0, 3.0]).withColumn("available_at", F.when(F.col("game_id") == "a01", F.col("kickoff") + F.expr("INTERVAL 7 DAYS")).otherwise(F.col("available_at")))
    assert features(spark, df)["a02"]["n_history"] == 1


def test_null_policies(spark):
    df = history(spark, [1.0, None, 3.0, 4.0])
    strict, skip = features(spark, df)["a03"], features(spark, df, null_policy="skip")["a03"]
    assert strict["last3_m"] is None and strict["ewma_m"] is None
    assert skip["last3_m"] == 2.0
    w = [0.5 ** (2 / 3), 1.0]
    assert skip["ewma_m"] == pytest.approx((1 * w[0] + 3 * w[1]) / sum(w))


def test_first_row_has_no_history(spark):
    got = features(spark, history(spark, [5.0]))["a00"]
    assert got["n_history"] == 0 and got["last3_m"] is None and got["source_ids"] is None


def test_prefix_equals_range_join(spark):
    """The linear form gives what joining every pair gives, on several entities and partitionings."""
    df = history(spark, [1.0, 5.0, 2.0, 8.0, 3.0]).unionByName(history(spark, [2.0, 2.0, 9.0], "b"))
    pairs = joins.history_join(df, targets(df), ["entity"], time="kickoff", available_at="available_at", cutoff="prediction_time", history_id="game_id", target_id="game_id")
    want = {r["game_id"]: r["m"] for r in pairs.groupBy("game_id").agg(F.avg("h_m").alias("m")).collect()}
    for parts in (1, 8):
        got = {k: v["all_m"] for k, v in features(spark, df.repartition(parts)).items()}
        assert {k: v for k, v in got.items() if v is not None} == pytest.approx(want)


def test_asof_strict_and_inclusive(spark):
    left = spark.createDataFrame([(1, "k", 10), (2, "k", 20), (3, "z", 20)], "id int, k string, t int")
    right = spark.createDataFrame([("k", 10, "x"), ("k", 20, "y"), (None, 5, "n")], "k string, t int, v string").withColumnRenamed("t", "rt")
    run = lambda strict: {r["id"]: r["v"] for r in joins.asof_join(left, right, ["k"], left_time="t", right_time="rt", values=["v"], strict=strict).collect()}
    assert run(False) == {1: "x", 2: "y", 3: None}
    assert run(True) == {1: None, 2: "x", 3: None}


def test_resolution_statuses(spark):
    from cutline.functions import text

    rows = spark.createDataFrame([("A B",), ("C",), ("D",)], "n string")
    cand = spark.createDataFrame([("a b jr", 1), ("c", 2), ("C.", 3)], "m string, i int")
    got = {r["n"]: (r["resolved_id"], r["match_status"]) for r in joins.resolve(rows, cand, name="n", candidate_name="m", candidate_id="i", normalise=text.normalize_name).collect()}
    assert got == {"A B": (1, "MATCHED"), "C": (None, "AMBIGUOUS"), "D": (None, "UNMATCHED")}


def test_crosswalk_band_and_coverage(spark):
    x = spark.createDataFrame([("p", 1), ("p", 1), ("q", 1), ("q", 2), (None, 3)], "f string, l int")
    assert [tuple(r) for r in joins.unique_crosswalk(x, "f", "l").collect()] == [("p", 1)]
    a = spark.createDataFrame([(1, "h", T0)], "id int, k string, t timestamp")
    b = spark.createDataFrame([("h", T0 + timedelta(minutes=59), "in"), ("h", T0 + timedelta(minutes=61), "out")], "k2 string, t2 timestamp, v string")
    assert [r["v"] for r in joins.band_join(a, b, [("k", "k2")], left_time="t", right_time="t2", seconds=3600, left_id="id").collect()] == ["in"]
    assert joins.coverage_gap(x.select("f"), spark.createDataFrame([("p",)], "f string"), ["f"]).select("f").distinct().count() == 2


def brute(rows, targets, *, windows, half_life, null_policy):
    """Every feature from its definition, in Python."""
    out = {}
    for t in targets:
        seen = sorted((r for r in rows if r["entity"] == t["entity"] and r["kickoff"] and r["available_at"] and r["kickoff"] < t["prediction_time"] and r["available_at"] < t["prediction_time"] and r["game_id"] != t["game_id"]), key=lambda r: (r["kickoff"], r["game_id"]))
        got = {"n_history": len(seen)}
        strict = null_policy == "strict"
        for name, n in windows.items():
            part = seen[-n:] if n else seen
            m = [r["m"] for r in part if r["m"] is not None]
            got[f"{name}_m"] = sum(m) / len(m) if m and not (strict and len(m) < len(part)) else None
            got[f"{name}_sum_m"] = sum(m) if m and not (strict and len(m) < len(part)) else None
        w = [(r["m"], r["whole"], 0.5 ** ((len(seen) - 1 - i) / half_life)) for i, r in enumerate(seen)]
        some = [x for x in w if x[0] is not None]
        whole = len(some) == len(w) or not strict
        got["ewma_m"] = sum(a * c for a, _, c in some) / sum(c for *_, c in some) if some and whole else None
        den = sum(b * c for _, b, c in some)
        got["ewma_share"] = sum(a * c for a, _, c in some) / den if some and whole and den > 0 else None
        got["source_ids"] = ";".join(r["game_id"] for r in seen[-8:]) or None
        out[t["game_id"]] = got
    return out


@pytest.mark.parametrize("null_policy", ["strict", "skip"])
@pytest.mark.parametrize("chunk", [None, 86_400.0 * 9, 86_400.0 * 1_000])
def test_late_results_stay_out_of_every_window(spark, null_policy, chunk):
    """Shuffled availability, results known before their own cutoff, ties, missing clocks, nulls."""
    import random

    rng = random.Random(4)
    rows = []
    for e in "abc":
        for i in range(40):
            kick = T0 + rng.randrange(0, 200) * DAY
            late = rng.choice([1, 1, 1, 1, 3, 60, -5, 400])
            rows.append((f"{e}{i:02d}", e, 2024, kick if rng.random() > 0.03 else None, kick + late * DAY if rng.random() > 0.03 else None, rng.choice([None, 1.0, 2.5, 7.0]) if null_policy == "skip" else rng.random(), 8.0))
    df = spark.createDataFrame(rows, "game_id string, entity string, season int, kickoff timestamp, available_at timestamp, m double, whole double")
    df = df.withColumn("whole", F.when(F.col("m").isNotNull(), F.col("whole")))
    t = targets(df)
    windows = {"last3": 3, "all": None}
    got = features(spark, df, t, windows=windows, null_policy=null_policy, sums=True, chunk=chunk)
    want = brute([r.asDict() for r in df.collect()], [r.asDict() for r in t.where("prediction_time is not null").collect()], windows=windows, half_life=3.0, null_policy=null_policy)
    for k, expected in want.items():
        for name, value in expected.items():
            assert got[k][name] == (pytest.approx(value) if isinstance(value, float) else value), (k, name)
    assert all(got[k]["n_history"] == 0 for k in got if k not in want)


def test_late_middle_game_is_left_out(spark):
    """Five games, the second known only after sixty days: later targets do not see it, nor lose the others."""
    df = history(spark, [1.0, 900.0, 2.0, 3.0, 4.0]).withColumn("available_at", F.when(F.col("game_id") == "a01", F.col("kickoff") + F.expr("INTERVAL 60 DAYS")).otherwise(F.col("available_at")))
    got = features(spark, df)
    assert [got[f"a{i:02d}"]["n_history"] for i in range(5)] == [0, 1, 1, 2, 3]
    assert got["a04"]["last3_m"] == 2.0 and got["a04"]["source_ids"] == "a00;a02;a03"


def test_null_keys_see_nothing(spark):
    left = spark.createDataFrame([(None, 5), ("a", 5), ("a", None)], "k string, t int")
    right = spark.createDataFrame([(None, 1, "x"), ("a", 1, "y"), ("a", None, "z")], "k string, u int, v string")
    got = joins.asof_join(left, right, ["k"], left_time="t", right_time="u", values=["v"])
    assert sorted((str(r["k"]), str(r["t"]), str(r["v"])) for r in got.collect()) == [("None", "5", "None"), ("a", "5", "y"), ("a", "None", "None")]


def test_beside_needs_one_partner(spark):
    make = lambda ids: spark.createDataFrame([(i,) for i in ids], "k int")
    assert joins.beside(make([1, 2]), make([2, 1]), ["k"]).count() == 2
    for a, b in (([1, 2], [1, 1]), ([1], [1, 2]), ([1, 2], [1]), ([None], [None])):
        with pytest.raises(Exception, match="no single partner"):
            joins.beside(make(a), make(b), ["k"]).collect()


@pytest.mark.parametrize("strict", [True, False])
def test_chunked_asof_equals_the_whole_scan(spark, strict):
    import random

    rng = random.Random(3)
    at = lambda: T0 + timedelta(hours=rng.randrange(0, 2000)) if rng.random() > 0.05 else None
    left = spark.createDataFrame([(i, rng.choice(["a", "a", "b", "c", None]), at()) for i in range(200)], "i int, k string, t timestamp")
    right = spark.createDataFrame([(j, rng.choice(["a", "a", "b", None]), at()) for j in range(120)], "j int, k string, u timestamp")
    args = {"left_time": "t", "right_time": "u", "values": ["j"], "strict": strict, "order": ["j"]}
    whole = {r["i"]: r["j"] for r in joins.asof_join(left, right, ["k"], **args).collect()}
    for chunk in (3600 * 7, 86_400 * 30):
        assert {r["i"]: r["j"] for r in joins.asof_join(left, right, ["k"], **args, chunk=chunk).collect()} == whole
    assert sum(v is not None for v in whole.values()) > 100
