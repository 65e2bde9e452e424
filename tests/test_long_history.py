"""Histories longer than the weights reach, of one hot entity, and with results that come in late."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cutline.operators import lag, sweep


def last_ewma(spark, values, policy, **k):
    t0 = datetime(2024, 1, 1)
    rows = [("e", i, t0 + timedelta(hours=i), t0 + timedelta(hours=i), v) for i, v in enumerate(values)]
    h = spark.createDataFrame(rows, "entity string, game_id long, kickoff timestamp, available_at timestamp, m double")
    t = spark.createDataFrame([("e", 10_000, t0 + timedelta(hours=9_999))], "entity string, game_id long, prediction_time timestamp")
    return lag.prefix_features(h, t, ["entity"], metrics=["m"], windows={}, null_policy=policy, **k).head()["ewma_m"]


@pytest.mark.parametrize("k", [{}, {"chunk": 3600.0 * 50}, {"chunk": 3600.0 * 700}])
def test_old_nulls_and_long_gaps(spark, k):
    tail = [float(i % 5) for i in range(200)]
    assert last_ewma(spark, [None, *tail], "strict", **k) is None
    want = sum(v * 0.5 ** ((199 - i) / 3) for i, v in enumerate(tail)) / sum(0.5 ** (k / 3) for k in range(200))
    assert last_ewma(spark, tail, "strict", **k) == pytest.approx(want)
    assert last_ewma(spark, tail + [None] * 300, "skip", **k) == pytest.approx(want)


def hot(spark, n, late_first):
    """n rows of one entity, one an hour, beside as many of a hundred others; the first may never be told."""
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hour = lambda c: F.timestamp_micros(F.unix_micros(t0) + c * 3_600_000_000)
    i = F.col("id")
    rows = spark.range(2 * n).select(
        i.alias("game_id"), F.when(i < n, "hot").otherwise(F.concat(F.lit("e"), (i % 100).cast("string"))).alias("entity"), hour(i % n).alias("kickoff"), (i % 7).cast("double").alias("m")
    )
    far = F.lit("2100-01-01 00:00:00").cast("timestamp")
    return rows.withColumn("available_at", F.when((i := F.col("game_id")).isin(0, 50) & F.lit(late_first), far).otherwise(F.col("kickoff") + F.expr("INTERVAL 30 MINUTES")))


def by_definition(n, late_first):
    """Features of the hot entity's targets: what is seen grows by one row each time."""
    seen, out = [], {}
    for i in range(n):
        out[i] = (len(seen), sum(seen[-3:]) / len(seen[-3:]) if seen else None, sum(seen) if seen else None)
        if not (late_first and i in (0, 50)):
            seen.append(float(i % 7))
    return out


def test_late_first_row_of_a_long_history_is_swept_in_linear_work(spark):
    """10,000 targets whose history is never a prefix: as pairs they would be 50 million rows."""
    n = 10_000
    h = hot(spark, n, True)
    t = h.where("entity = 'hot'").select("game_id", "entity", F.col("kickoff").alias("prediction_time"))
    out = lag.prefix_features(h, t, ["entity"], metrics=["m"], windows={"last3": 3, "all": None}, sums=True, with_ewma=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = {r["game_id"]: (r["n_history"], r["last3_m"], r["all_sum_m"]) for r in out.collect()}
    assert got == by_definition(n, True)


def test_hot_entity_is_spread_over_tasks(spark):
    """Half of all rows are one entity's; in chunks no task sweeps more than a sixteenth of it."""
    n, chunk = 4_000, 3600.0 * 200
    h = hot(spark, n, False)
    t = h.select("game_id", "entity", F.col("kickoff").alias("prediction_time"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = lag.prefix_features(h, t, ["entity"], metrics=["m"], windows={"last3": 3, "all": None}, sums=True, with_ewma=False, chunk=chunk)
        tasks = out.where("entity = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(tasks) >= 12 and max(r["count"] for r in tasks) <= n // 4
        got = {r["game_id"]: (r["n_history"], r["last3_m"], r["all_sum_m"]) for r in out.where("entity = 'hot'").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == by_definition(n, False)


def test_states_merge_like_one_sweep():
    import random

    rng = random.Random(1)
    want = sweep.Wanted({"last3": 3, "all": None}, {"m": 0}, {}, True, True, 4, 2.0, False, 3, 20)
    for _ in range(40):
        rows = [(rng.randrange(50), i, rng.randrange(9), (rng.choice([None, 1.0, 2.0, 5.0]),), str(i)) for i in range(rng.randrange(1, 15))]
        whole, parts = sweep.State(want), [sweep.State(want) for _ in range(3)]
        for k, r in enumerate(rows):
            whole.add(r)
            parts[3 * k // len(rows)].add(r)
        merged = parts[0].merge(parts[1]).merge(parts[2])
        assert merged.features(None, []) == pytest.approx(whole.features(None, []))
        assert merged.features("0", [rows[0][3]]) == pytest.approx(whole.features("0", [rows[0][3]]))
