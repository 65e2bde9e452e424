"""Streaming queries over the events table, delivered in parts, with a restart after each part."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import staging
from ..streaming import freeze as st
from . import views as v
from .registry import query

PARTS = 3
#: Events that arrive on time: some of the first third come with the last part only.
ON_TIME = """SELECT * FROM events WHERE NOT (event_id % 50 = 0 AND ts < (SELECT min(ts) + to_microseconds(CAST(date_diff('microsecond', min(ts), max(ts)) AS BIGINT) // 3) FROM events))"""


def parts_of(spark: SparkSession, d: str) -> list[DataFrame]:
    """The events by time in three parts; every fiftieth of the first part is late and comes with the last."""
    e = v.table(spark, d, "events")
    lo, hi = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).head()
    if lo is None:
        return [e] * PARTS
    step = (hi - lo) // PARTS
    at = F.least(F.lit(PARTS - 1), F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - lo) / max(step, 1)))
    at = F.when((F.col("event_id") % 50 == 0) & (F.unix_micros(F.col("ts").cast("timestamp")) < lo + step), PARTS - 1).otherwise(at)
    return [e.where(at == k) for k in range(PARTS)]


def quotes_of(raw: DataFrame) -> DataFrame:
    """Events as quotes."""
    return raw.select(
        F.to_date(F.date_trunc("week", "ts")).cast("string").alias("event"), F.col("user_id").alias("player"), F.concat(F.lit("b"), F.col("event_id") % 4).alias("book"),
        (F.when(F.col("event_id") % 3 == 0, -1).otherwise(1) * (100 + F.floor(F.col("value") * 5).cast("int"))).cast("int").alias("price"), F.col("ts").cast("timestamp").alias("quote_time"),
    )


def run_in_parts(spark: SparkSession, d: str, name: str, build: Callable[[Callable[[], DataFrame]], DataFrame]) -> DataFrame:
    """What a stream has written after all parts.

    Each part is a batch of new files, however many; after it the query stops, and the
    next one starts anew from the checkpoint, so state, watermark and the sink's record of
    what is done must survive.  build gets a function that opens the stream of events.
    """
    at = staging.place(spark, name)
    schema = v.table(spark, d, "events").schema
    out = None
    for part in parts_of(spark, d):
        part.write.mode("append").parquet(f"{at}/in")
        stream = build(lambda: spark.readStream.schema(schema).parquet(f"{at}/in"))
        out = stream.schema
        q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out).parquet(f"{at}/out")


@query(f"""SELECT date_trunc('minute', ts)::TIMESTAMP "minute", count(*) quotes, count(DISTINCT event_id % 4) books, min(ts) oldest FROM ({ON_TIME}) WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1""")
def stream_minute_monitor(spark: SparkSession, d: str) -> DataFrame:
    """Closed minutes only: the watermark holds the last ones back, and what comes later than it is dropped."""
    out = run_in_parts(spark, d, "monitor", lambda read: st.minute_monitor(quotes_of(read())))
    return out.select(F.col("minute").cast("timestamp_ntz").alias("minute"), "quotes", "books", F.col("oldest").cast("timestamp_ntz").alias("oldest"))


@query(v.sql("""SELECT event::VARCHAR AS event, player, book, quote_time FROM v_quotes JOIN v_cutoff USING (event) WHERE quote_time <= cutoff AND event_id IN (SELECT event_id FROM ontime) GROUP BY ALL""", ("ontime", ON_TIME)))
def stream_on_time(spark: SparkSession, d: str) -> DataFrame:
    """Late quotes dropped, repeats dropped, by the same rule as the batch."""
    cuts = v.cutoffs(spark, d).select(F.col("event").cast("string").alias("event"), F.col("cutoff").cast("timestamp").alias("cutoff"))

    def build(read: Callable[[], DataFrame]) -> DataFrame:
        return st.on_time(st.distinct_quotes(quotes_of(read()), ["event", "player", "book"]), cuts).select("event", "player", "book", "quote_time")

    return run_in_parts(spark, d, "ontime", build).withColumn("quote_time", F.col("quote_time").cast("timestamp_ntz"))


@query(v.sql("""SELECT q.event::VARCHAR AS event, player, book, max(quote_time) quote_time, arg_max(price, (quote_time, price))::BIGINT price FROM v_quotes q JOIN v_cutoff USING (event) WHERE quote_time <= cutoff AND cutoff < (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) AND event_id IN (SELECT event_id FROM ontime) GROUP BY 1, 2, 3""", ("ontime", ON_TIME)))
def stream_freeze(spark: SparkSession, d: str) -> DataFrame:
    """One frozen set of newest quotes per event and player, once event time has passed its cutoff."""
    cuts = v.cutoffs(spark, d).select(F.col("event").cast("string").alias("event"), F.col("cutoff").cast("timestamp").alias("cutoff"))

    def build(read: Callable[[], DataFrame]) -> DataFrame:
        s = quotes_of(read()).withWatermark("quote_time", "10 minutes").join(cuts, "event")
        return st.freeze(s.select("event", "player", "book", "price", "quote_time", "cutoff"))

    out = _with_rocks(spark, lambda: run_in_parts(spark, d, "freeze", build))
    return out.select("event", "player", "book", F.col("quote_time").cast("timestamp_ntz").alias("quote_time"), F.col("price").cast("long").alias("price"))


#: Runs of the capture by event: in time, too early, too late, too early and then in time, or none.
_RUNS = """SELECT event, cutoff, unnest(CASE dayofyear(event) // 7 % 5 WHEN 0 THEN [20] WHEN 1 THEN [-300] WHEN 2 THEN [120] WHEN 3 THEN [-300, -110, 10] ELSE [] END) lag_s FROM v_cutoff WHERE cutoff + INTERVAL 2 MINUTE <= (SELECT max(ts) FROM events)"""


@query(v.sql("""SELECT c.event::VARCHAR AS event, CASE WHEN r.at IS NOT NULL THEN 'captured' WHEN r.late > 0 THEN 'late' WHEN r.early > 0 THEN 'early' ELSE 'missed' END status, r.at captured_at, (coalesce(r.early, 0) + coalesce(r.late, 0))::BIGINT refused, q.player, q.book, q.quote_time, q.price FROM v_cutoff c
    LEFT JOIN (SELECT event, min(cutoff + to_seconds(lag_s)) FILTER (lag_s BETWEEN -120 AND 45) AS "at", count(*) FILTER (lag_s < -120) early, count(*) FILTER (lag_s > 45) late FROM runs GROUP BY 1) r USING (event)
    LEFT JOIN (SELECT event, player, book, max(quote_time) quote_time, arg_max(price, (quote_time, price))::BIGINT price FROM v_quotes JOIN v_cutoff USING (event) WHERE quote_time <= cutoff AND event_id IN (SELECT event_id FROM ontime) GROUP BY 1, 2, 3) q ON q.event = c.event AND r.at IS NOT NULL
    WHERE c.cutoff + INTERVAL 45 SECOND < (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""", ("ontime", ON_TIME), ("runs", _RUNS)))
def stream_capture(spark: SparkSession, d: str) -> DataFrame:
    """Quotes sealed only for events whose capture ran between two minutes before the cutoff and 45 seconds after it."""
    cuts = v.cutoffs(spark, d).select(F.col("event").cast("string").alias("event"), F.col("cutoff").cast("timestamp").alias("cutoff"))
    kind = F.expr("dayofyear(event) div 7 % 5")
    seconds = F.when(kind == 0, F.array(F.lit(20))).when(kind == 1, F.array(F.lit(-300))).when(kind == 2, F.array(F.lit(120))).when(kind == 3, F.array(F.lit(-300), F.lit(-110), F.lit(10)))
    e = v.table(spark, d, "events").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("lo"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("hi"))
    us = F.unix_micros("cutoff")
    runs = cuts.join(F.broadcast(e)).where(us + 120_000_000 <= F.col("hi")).select("event", "cutoff", "lo", "hi", F.explode(seconds).alias("s"))  # one row
    # A run before the first event comes with the first part.
    part = F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), F.floor((us + F.col("s") * 1_000_000 - F.col("lo")) / F.greatest(F.expr(f"(hi - lo) div {PARTS}"), F.lit(1)))))
    runs = staging.stage(runs.select("event", F.timestamp_micros(us + F.col("s") * 1_000_000).alias("captured_at"), "cutoff", part.alias("part")), "runs")
    at, told = staging.place(spark, "capture-runs"), iter(range(PARTS))

    def build(read: Callable[[], DataFrame]) -> DataFrame:
        """Runs come with the part of the events in whose time they fall."""
        own = runs.where(F.col("part") == next(told)).drop("part")
        own.write.mode("append").parquet(at)
        q = quotes_of(read()).join(cuts, "event").select("event", "player", "book", "price", "quote_time", "cutoff")
        return st.capture(q, spark.readStream.schema(own.schema).parquet(at))

    out = st.captured(_with_rocks(spark, lambda: run_in_parts(spark, d, "capture", build)))
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("event", "status", ntz("captured_at"), F.col("refused").cast("long").alias("refused"), "player", "book", ntz("quote_time"), F.col("price").cast("long").alias("price"))


def _with_rocks(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """A run under the state store that keeps state beside the heap, and that processors with timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        spark.conf.set(name, before)
