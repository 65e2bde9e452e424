"""Mergeable scans against the window form, bootstrap by Poisson counts, exact distinct counts in a stream."""

from __future__ import annotations

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.operators import backtest as bt
from cutline.operators import metrics, scans
from cutline.streaming import freeze


def wagers(spark, n=600):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), i % 200, i, rng.choice([None, 1.5, -1.0, -1.0, 0.0]), rng.choice([True, False, False, None])) for i in range(n)]
    return spark.createDataFrame(rows + [("alone", 1, 10_000, None, None), ("lost", 1, 10_001, -1.0, False)], "k string, d long, i long, profit double, won boolean").repartition(5)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_scans_equal_windows(spark, parts):
    df = wagers(spark)
    key = lambda r: str(r["k"])
    want, got = (sorted(bt.drawdown(df, ["k"], ["d", "i"], parts=p).collect(), key=key) for p in (None, parts))
    for a, b in zip(want, got, strict=True):
        assert a["k"] == b["k"] and [b[c] for c in ("equity", "peak", "max_drawdown")] == [pytest.approx(a[c] if c != "max_drawdown" else a[c] or 0.0) if a[c] is not None or c == "max_drawdown" else None for c in ("equity", "peak", "max_drawdown")]
    known = df.where("won IS NOT NULL")
    want, got = ({r["k"]: r["longest_losing_streak"] for r in t.collect()} for t in (bt.losing_streak(known, ["k"], ["d", "i"]), bt.losing_streak(df, ["k"], ["d", "i"], parts=parts)))
    assert want == got


def test_one_group_is_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("one").alias("k"), "id", F.when(F.col("id") % 3 == 0, 1.5).otherwise(-1.0).alias("profit"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        (row,) = scans._stretches(df, ["k"], ["id"], F.col("profit"), 20, list(scans._Equity.names), scans._Equity().fold).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(row["_s"]) == 20 and max(s["n"] for s in row["_s"]) < 3_000


def test_poisson_bootstrap_agrees_with_draws_with_replacement(spark):
    rng = np.random.default_rng(2)
    num, den = rng.normal(0.3, 1, 400), rng.integers(1, 6, 400).astype(float)
    df = spark.createDataFrame([(f"c{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(num, den, strict=True))] + [(None, 5.0, 1.0)], "c string, a double, b double").repartition(3)
    got = metrics.interval(metrics.poisson_bootstrap(df, "c", F.sum("a"), F.sum("b"))).head()
    exact = metrics.interval(metrics.cluster_bootstrap(df.where("c IS NOT NULL"), "c", F.sum("a"), F.sum("b"))).head()
    draws = rng.integers(0, 400, (4_000, 400))
    want = np.quantile(num[draws].sum(1) / den[draws].sum(1), [0.025, 0.975])
    width = want[1] - want[0]
    for r in (got, exact):
        assert r["replicates"] == 2_000 and [r["lo"], r["hi"]] == pytest.approx(want.tolist(), abs=0.08 * width)


def test_poisson_bootstrap_of_a_million_clusters(spark):
    """Every task reports two sums a replicate, whatever the number of clusters."""
    df = spark.range(1_000_000).select(F.col("id").alias("c"), (F.col("id") % 2).cast("double").alias("a"))
    out = metrics.poisson_bootstrap(df, "c", F.sum("a"), F.count(F.lit(1)), replicates=20)
    got = [r["stat"] for r in out.collect()]
    assert len(got) == 20 and np.mean(got) == pytest.approx(0.5, abs=1e-3) and 2e-4 < np.std(got) < 1e-3


def test_monitor_counts_books_exactly(spark):
    """100,000 books in one minute, each told twice; the minute closes when a later quote passes the watermark."""
    at = tempfile.mkdtemp(prefix="cutline-")
    t0 = F.lit("2024-01-01 10:00:00").cast("timestamp")
    first = spark.range(200_000).select((F.col("id") % 100_000).cast("string").alias("book"), t0.alias("quote_time"))
    later = spark.range(1).select(F.lit("x").alias("book"), F.lit("2024-01-01 11:00:00").cast("timestamp").alias("quote_time"))
    first.write.parquet(f"{at}/in")
    for part in (None, later):
        if part is not None:
            part.write.mode("append").parquet(f"{at}/in")
        out = freeze.minute_monitor(spark.readStream.schema(first.schema).parquet(f"{at}/in"))
        out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    (row,) = spark.read.schema(out.schema).parquet(f"{at}/out").collect()
    assert (row["quotes"], row["books"]) == (200_000, 100_000)
