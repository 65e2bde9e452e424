"""Features asked for alone, and targets without an own row, against every feature of every target."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cutline.operators import lag


def test_only_computes_what_is_asked_and_shared_cutoffs_are_asked_once(spark, monkeypatch):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, start + dt.timedelta(days=i // 3), start + dt.timedelta(days=i // 3 + (40 if i % 7 == 0 else 1)), float(i % 11)) for i in range(90)]
    history = spark.createDataFrame(rows, "game_id long, e long, kickoff timestamp_ntz, available_at timestamp_ntz, m double")
    targets = history.select("game_id", "e", F.expr("kickoff - INTERVAL 1 HOUR").alias("prediction_time"))
    whole = lag.prefix_features(history, targets, ["e"], metrics=["m"])
    some = lag.prefix_features(history, targets, ["e"], metrics=["m"], only=["last5_m", "ewma_m"])
    assert some.columns == ["game_id", "e", "prediction_time", "n_history", "last5_m", "ewma_m"]
    assert sorted(some.collect()) == sorted(whole.select(some.columns).collect())

    asked, real = [], lag.staging.stage
    monkeypatch.setattr(lag.staging, "stage", lambda df, name: asked.append(df.count()) or real(df, name))
    shared = targets.select(F.col("game_id").alias("id"), "e", "prediction_time").unionByName(targets.select(F.col("game_id").alias("id"), "e", "prediction_time"))
    out = lag.prefix_features(history, shared, ["e"], metrics=["m"], windows={"last5": 5}, with_ewma=False)
    assert asked == [90] and out.count() == 180 and out.columns == ["id", "e", "prediction_time", "n_history", "last5_m"]
