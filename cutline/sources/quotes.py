"""Nested quote snapshots and their flat form, the same for batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import SNAPSHOT


def read_snapshots(spark: SparkSession, path: str, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected) snapshot documents: one a line, or one a file; what does not parse is kept as text."""
    return parse_snapshots(spark.read.text(path, wholetext=whole_files))


def parse_snapshots(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected) of a column of JSON text."""
    own = raw.withColumn("_s", F.from_json(column, SNAPSHOT, {"mode": "PERMISSIVE"}))
    ok = F.col("_s").isNotNull() & F.col("_s.timestamp").isNotNull()
    return own.where(ok).select("_s.*"), own.where(~ok).select(column)


def flatten(snapshots: DataFrame) -> DataFrame:
    """One row per outcome: event, book, market, side, player, line, price and the two clocks."""
    book = snapshots.select(F.col("timestamp").alias("snapshot_time"), "event", F.explode("bookmakers").alias("b"))
    market = book.select("snapshot_time", "event", F.col("b.key").alias("book"), F.explode("b.markets").alias("m"))
    out = market.select("snapshot_time", "event", "book", F.col("m.key").alias("market"), F.col("m.last_update").alias("quote_time"), F.explode("m.outcomes").alias("o"))
    return out.select("event", "book", "market", F.col("o.name").alias("side"), F.col("o.description").alias("player"), F.col("o.point").alias("line"), F.col("o.price").alias("price"), "quote_time", "snapshot_time")


def canonical_spread(spread: Column, favourite_negative: Column) -> Column:
    """Home spread with the favourite negative, whatever the source's sign."""
    return F.when(favourite_negative, spread).otherwise(-spread)


def current_code(code: Column, aliases: dict[str, str]) -> Column:
    """A legacy code's current form."""
    out = code
    for old, new in aliases.items():
        out = F.when(code == old, F.lit(new)).otherwise(out)
    return out
