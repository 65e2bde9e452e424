"""Many rows of one entity at one instant: few are swept, and features are those of the whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cutline.operators import lag, sweep


def days(spark, n, per_day):
    """Rows of one entity, per_day of them at each instant; every ninth without a value, every seventh known an hour before itself."""
    day = F.timestamp_micros((F.col("id") / per_day).cast("long") * 86_400_000_000)
    rows = spark.range(n).select(F.col("id").alias("game_id"), F.lit("hot").alias("entity"), day.alias("kickoff"), (F.col("id") % 11).cast("double").alias("m"), F.when(F.col("id") % 9 > 0, F.col("id") % 5).alias("k"))
    return rows.withColumn("available_at", F.when(F.col("game_id") % 7 == 0, F.col("kickoff") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("kickoff") + F.expr("INTERVAL 1 DAY")))


@pytest.mark.parametrize("policy", ["strict", "skip"])
def test_chunks_equal_the_whole(spark, policy):
    h = days(spark, 3_000, 500)
    # Half of the targets may see some rows of their own day, every fourteenth its own row.
    t = h.select("game_id", "entity", F.when(F.col("game_id") % 2 == 0, F.col("kickoff") + F.expr("INTERVAL 2 HOURS")).otherwise(F.col("kickoff") - F.expr("INTERVAL 1 HOUR")).alias("prediction_time"))
    options = {"metrics": ["m", "k"], "windows": {"last5": 5, "all": None}, "sums": True, "null_policy": policy}
    names = ["n_history", *(f"{w}{s}_{m}" for w in ("last5", "all") for s in ("", "_sum") for m in ("m", "k")), "ewma_m", "ewma_k"]
    one, two = ({r["game_id"]: [r[n] for n in names] for r in lag.prefix_features(h, t, ["entity"], chunk=c, **options).collect()} for c in (None, 86_400.0 * 2))
    assert len(one) == len(two) == 3_000
    for i, row in one.items():
        assert two[i] == pytest.approx(row), i


def test_windows_without_metrics(spark):
    h = days(spark, 100, 50)
    t = h.select("game_id", "entity", (F.col("kickoff") + F.expr("INTERVAL 20 DAYS")).alias("prediction_time"))
    out = lag.prefix_features(h, t, ["entity"], windows={}, with_ewma=False, lineage=2, chunk=86_400.0)
    assert {(r["n_history"], r["source_ids"]) for r in out.where("game_id < 98").collect()} == {(99, "98;99")}
    assert out.where("game_id = 99").head()["source_ids"] == "97;98"


def test_rows_of_an_instant_are_few(spark, monkeypatch):
    """Of 4,000 rows at each of five instants, 21 and their sums are swept; 20,000 targets are answered at five."""
    staged, stage = {}, sweep.staging.stage
    monkeypatch.setattr(sweep.staging, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    h = days(spark, 20_000, 4_000)
    t = h.select("game_id", "entity", (F.col("kickoff") - F.expr("INTERVAL 1 HOUR")).alias("prediction_time"))
    out = lag.prefix_features(h, t, ["entity"], metrics=["m"], windows={"last20": 20}, with_ewma=False, chunk=86_400.0 * 2)
    assert out.count() == 20_000
    assert staged["told"].count() <= 2 * 5 * (21 + 1) and staged["swept"].count() == 5
