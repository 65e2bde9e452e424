"""Frozen quotes and captures of small streams, in batches, with late rows among them."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cutline.streaming import freeze

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
QUOTES = "event string, player long, book string, price int, quote_time timestamp, cutoff timestamp"
T0 = datetime(2024, 1, 6)


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, before)


def run(spark, tmp_path, batches, build):
    """Rows of the sink and the last progress, after one run a batch, each from the checkpoint."""
    progress = None
    for rows in batches:
        part = spark.createDataFrame(rows, QUOTES)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = build(spark.readStream.schema(part.schema).parquet(f"{tmp_path}/in"))
        w = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        q = w.outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        progress = q.lastProgress
    return [tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()], progress


def test_frozen_once_and_gone_from_the_state(rocks, tmp_path):
    cut, far = at(0), at(10_000)
    own = lambda minutes, price, player=1, book="a", cutoff=cut: ("e", player, book, price, at(minutes), cutoff)
    batches = [
        [own(-60, 1), own(-50, 2), own(-50, 3), own(0, 7, book="b"), own(1, 9, book="b"), own(-40, 5, player=2), ("f", 1, "a", 4, at(-30), far)],
        [own(-55, 8), own(-1, 6, player=2), ("f", 1, "a", 2, at(-58), far), ("f", 1, "a", 3, at(30), far)],  # the first and third are behind the watermark
        [own(-2, 99), own(-1, 99, player=3), ("f", 1, "a", 5, at(60), far)],  # both of e are after its seal
    ]
    got, progress = run(rocks, tmp_path, batches, lambda s: freeze.freeze(s.withWatermark("quote_time", "10 minutes")))
    assert sorted(got) == [("e", 1, "a", at(-50), 3), ("e", 1, "b", at(0), 7), ("e", 2, "a", at(-1), 6)]
    # One row each of f: the quote not yet behind the watermark, and the session.  Nothing is left of e.
    assert [o["numRowsTotal"] for o in progress["stateOperators"]] == [1, 1]


def test_a_frozen_set_has_any_number_of_keys(rocks, tmp_path):
    """No step of the plan holds a group: 30,000 keys are frozen by native operators."""
    q = rocks.range(30_000).select(
        F.lit("e").alias("event"), (F.col("id") % 10_000).alias("player"), F.lit("b").alias("book"), F.col("id").cast("int").alias("price"),
        F.timestamp_micros(F.unix_micros(F.lit(at(-60))) + F.col("id")).alias("quote_time"), F.lit(at(0)).alias("cutoff"),
    )
    q = q.unionByName(rocks.createDataFrame([("f", 1, "a", 4, at(30), at(10_000))], QUOTES))
    q.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = freeze.freeze(rocks.readStream.schema(QUOTES).parquet(f"{tmp_path}/in").withWatermark("quote_time", "10 minutes"))
    w = s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    run_ = w.trigger(availableNow=True).start()
    run_.awaitTermination()
    assert not any("transformWithState" in o["operatorName"] for o in run_.lastProgress["stateOperators"])
    out = rocks.read.schema(s.schema).parquet(f"{tmp_path}/out")
    assert out.count() == 10_000 and out.where("price <> player + 20000").isEmpty()


def test_capture_tells_every_event(rocks, tmp_path):
    """Verdicts beside frozen quotes: also where an event has no quote in time, and without runs of its own."""
    cut = at(0)
    runs = [("in", at(1 / 3), cut), ("in", at(-5), cut), ("early", at(-5), cut), ("late", at(2), cut), ("bare", at(-1), cut)]
    rocks.createDataFrame(runs, "event string, captured_at timestamp, cutoff timestamp").coalesce(1).write.parquet(f"{tmp_path}/runs")
    batches = [
        [(e, p, "a", 10 * p + k, at(k - 60), cut) for e in ("in", "early", "late", "missed") for p in (1, 2) for k in range(3)],
        [("bare", 1, "a", 7, at(0.5), cut), ("in", 3, "a", 7, at(0), cut), ("in", 1, "a", 8, at(0.25), cut)],
        [("f", 1, "a", 1, at(60), at(10_000)), ("in", 2, "a", 99, at(-59.5), cut)],
    ]
    schema = "event string, captured_at timestamp, cutoff timestamp"
    rows, progress = run(rocks, tmp_path, batches, lambda s: freeze.capture(s, rocks.readStream.schema(schema).parquet(f"{tmp_path}/runs")))
    names = ["event", "status", "captured_at", "refused", "player", "book", "quote_time", "price"]
    table = rocks.createDataFrame(rows, freeze.VERDICT + ", player long, book string, quote_time timestamp, price int")
    got = sorted((tuple(r) for r in freeze.captured(table).select(*names).collect()), key=str)
    none = (None,) * 4
    quotes = [(1, "a", at(-58), 12), (2, "a", at(-58), 22), (3, "a", at(0), 7)]
    want = [("in", "captured", at(1 / 3), 1, *q) for q in quotes]
    want += [("early", "early", None, 1, *none), ("late", "late", None, 1, *none), ("missed", "missed", None, 0, *none), ("bare", "captured", at(-1), 0, *none)]
    assert got == sorted(want, key=str)
