"""Streams of quotes: late-data rule, newest quote, freeze at the cutoff, monitor, settlement."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def on_time(quotes: DataFrame, cutoffs: DataFrame, key: str = "event", time: str = "quote_time") -> DataFrame:
    """A watermarked stream without what is later than its key's cutoff; cutoffs is static."""
    return quotes.join(cutoffs, key).where(F.col(time) <= F.col("cutoff"))


def distinct_quotes(quotes: DataFrame, keys: list[str], time: str = "quote_time", delay: str = "10 minutes") -> DataFrame:
    """Repeats of a quote dropped within the watermark."""
    return quotes.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, time])


def freeze(quotes: DataFrame, keys: tuple[str, ...] = ("event", "player", "book"), after: timedelta = timedelta(0)) -> DataFrame:
    """The newest quote (then the higher price) of each key, once, when event time has passed its cutoff by `after`.

    quotes: a stream watermarked on quote_time, with keys, price, quote_time and cutoff.  A quote after the
    cutoff, behind the watermark, or for what is frozen, is dropped.

    Two native stateful steps, so there is no group to hold: quotes of one instant, which drops what is late,
    and sessions that all end with the seal of their key, so that a key's quotes are one session.  What
    is sealed leaves the state, and the end of its session keeps it from waking again.
    """
    each = quotes.where(F.col("quote_time") <= F.col("cutoff")).groupBy(*keys, "cutoff", "quote_time").agg(F.max("price").alias("price"))
    left = F.unix_micros("cutoff") - F.unix_micros("quote_time") + (after // timedelta(microseconds=1) + 1)  # an end is not part of its session
    to_seal = F.make_interval(secs=(left.cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))
    newest = each.groupBy(*keys, F.session_window("quote_time", to_seal)).agg(F.max(F.struct("quote_time", "price")).alias("newest"))
    return newest.select(*keys, "newest.quote_time", "newest.price")


def _millis(at) -> int:
    stamp = pd.Timestamp(at)
    return int((stamp.tz_localize("UTC") if stamp.tzinfo is None else stamp).timestamp() * 1000)


class CaptureWindow(StatefulProcessor):
    """Whether a capture of an event ran in time, told once, when event time has passed the window.

    Two clocks: quotes and the seal go by event time, a capture run by the clock of the machine it ran
    on, ``captured_at``.  A run counts from BEFORE the cutoff to AFTER it; one too early, too
    late, or after another that counted is refused.  The event gives the first run that
    counted, or why there is none: early, late, or missed where nothing ran.
    """

    BEFORE, AFTER = pd.Timedelta(minutes=2), pd.Timedelta(seconds=45)
    KEEP_DAYS = 7

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "captured_at timestamp, early int, late int")
        self.sealed = handle.getValueState("sealed", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.sealed.exists():
            return iter(())
        part = pd.concat(list(rows))
        runs = part[part["captured_at"].notna()]
        if len(runs):
            at, early, late = self.run.get() if self.run.exists() else (None, 0, 0)
            in_time = runs[(runs["captured_at"] >= runs["cutoff"] - self.BEFORE) & (runs["captured_at"] <= runs["cutoff"] + self.AFTER)]
            early += int((runs["captured_at"] < runs["cutoff"] - self.BEFORE).sum())
            late += int((runs["captured_at"] > runs["cutoff"] + self.AFTER).sum())
            if len(in_time):
                first = in_time["captured_at"].min().to_pydatetime()
                at = first if at is None or first < at else at
            self.run.update((at, early, late))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(_millis(part["cutoff"].iloc[0] + self.AFTER))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.sealed.exists():
            self.sealed.clear()
            return
        at, early, late = self.run.get() if self.run.exists() else (None, 0, 0)
        status = "captured" if at is not None else "late" if late else "early" if early else "missed"
        self.sealed.update((pd.Timestamp(due, unit="ms").to_pydatetime(),))
        self.run.clear()
        self.handle.registerTimer(due + self.KEEP_DAYS * 86_400_000)
        out = pd.DataFrame([(key[0], status, at, early + late)], columns=["event", "status", "captured_at", "refused"])
        yield out.astype({"captured_at": "datetime64[us]"})

    def close(self) -> None:
        pass


VERDICT = "event string, status string, captured_at timestamp, refused int"


def _latest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch one row an event, with its newest instant."""
    for batch in batches:
        few = pa.table(batch).group_by(["event", "cutoff"]).aggregate([("at", "max")]).rename_columns(["event", "cutoff", "at"])
        yield from few.select(["event", "at", "cutoff"]).combine_chunks().to_batches()


def capture(quotes: DataFrame, runs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Rows of two kinds in one stream, written together: an event's verdict, and what was frozen of it, without a status.

    quotes: event, player, book, price, quote_time, cutoff.  runs: event, captured_at, cutoff.

    Quotes are frozen by native steps, since an event has any number of them.  The verdict needs to know only
    that an event is there, so it gets one row an event of each batch of quotes; runs share its watermark, so
    where there are none they do not hold it back.  ``captured`` puts what was written together.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    sealed = freeze(quotes.withWatermark("quote_time", delay), after=CaptureWindow.AFTER.to_pytimedelta())
    seen = quotes.select("event", F.col("quote_time").alias("at"), "cutoff").mapInArrow(_latest, "event string, at timestamp, cutoff timestamp")
    told = runs.withColumn("at", F.col("captured_at")).unionByName(seen, allowMissingColumns=True).withWatermark("at", delay)
    verdicts = told.groupBy("event").transformWithStateInPandas(CaptureWindow(), VERDICT, "append", "eventTime")
    return verdicts.unionByName(sealed, allowMissingColumns=True)


def captured(rows: DataFrame) -> DataFrame:
    """The verdict of each event beside its frozen quotes if it was captured, from the rows that ``capture`` wrote."""
    verdicts = rows.where(F.col("status").isNotNull()).select("event", "status", "captured_at", "refused")
    sealed = rows.where(F.col("status").isNull()).select("event", F.lit("captured").alias("status"), "player", "book", "quote_time", "price")
    return verdicts.join(sealed, ["event", "status"], "left")


def minute_monitor(quotes: DataFrame, time: str = "quote_time", delay: str = "10 minutes") -> DataFrame:
    """Quotes and books per minute, once the watermark has passed.

    Two stateful steps in a row: quotes are summed by minute and book, then those sums by
    minute, so books are counted exactly and no state holds a set of them.
    """
    each = quotes.withWatermark(time, delay).groupBy(F.window(time, "1 minute"), "book").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"))
    w = each.groupBy(F.window(F.col("window"), "1 minute"))
    return w.agg(F.sum("n").alias("quotes"), F.count(F.lit(1)).alias("books"), F.min("first").alias("oldest")).select(F.col("window.start").alias("minute"), "quotes", "books", "oldest")


def settle(wagers: DataFrame, results: DataFrame, wait: str = "6 hours") -> DataFrame:
    """Wagers with their result, or without one once the wait is over (pending)."""
    w = wagers.withWatermark("placed_at", "10 minutes")
    r = results.withWatermark("known_at", "10 minutes").withColumnRenamed("wager_id", "r_id")
    cond = (F.col("wager_id") == F.col("r_id")) & (F.col("known_at") >= F.col("placed_at")) & (F.col("known_at") <= F.col("placed_at") + F.expr(f"INTERVAL {wait}"))
    return w.join(r, cond, "leftOuter").withColumn("status", F.when(F.col("won").isNull(), "pending").when(F.col("won"), "won").otherwise("lost"))
