"""Scans of ordered histories by summaries that merge, so that one group is as many tasks as it has rows for.

Rows are dealt by ranges of (group, order), every task sums up the stretch of each group that
it holds, and a group's summaries - one for each task that has some of it - are folded in
order.  No task needs to hold a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..sources.ship import ship_package


def _stretches(df: DataFrame, by: list[str], order: list[str], value: Column, parts: int, names: list[str], fold: Callable[[tuple | None, np.ndarray], tuple]) -> DataFrame:
    """by and _s: the summaries of a group's stretches in order.  fold takes a stretch's values in pieces, in order."""
    ship_package(df.sparkSession)
    rows = df.select(F.struct(*by, F.lit(0).alias("_0")).alias("_g"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), value.cast("double").alias("_v"))
    keys = ["_g", *(f"_o{i}" for i in range(len(order)))]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("_g", "_v", F.spark_partition_id().alias("_part"))
    schema = S.StructType([ranged.schema["_g"], S.StructField("_part", S.IntegerType()), *(S.StructField(n, S.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, part, held = None, None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([group, part, *(pa.array([float(x)]) for x in held)], ["_g", "_part", *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("_g")
            new = np.zeros(batch.num_rows, bool)
            for i in range(g.type.num_fields):
                x = g.field(i)
                differ = pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).fill_null(False)
                gap = pc.not_equal(x.slice(1).is_null(), x.slice(0, len(x) - 1).is_null())
                new[1:] |= np.asarray(pc.or_(differ, gap))
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            v = batch.column("_v").to_numpy(zero_copy_only=False)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if group is None or g.slice(a, 1).to_pylist() != group.to_pylist():
                    if group is not None:
                        yield told()
                    group, part, held = g.slice(a, 1), batch.column("_part").slice(a, 1), None
                held = fold(held, v[a:b])
        if group is not None:
            yield told()

    out = ranged.mapInArrow(run, schema)
    return out.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_part", *names))).alias("_s")).select(*(F.col(f"_g.{c}").alias(c) for c in by), "_s")


class _Equity:
    """(sum, greatest and least prefix, greatest fall, values): prefixes include the empty one."""

    names = ("s", "top", "low", "fall", "n")

    @staticmethod
    def merge(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], max(a[1], a[0] + b[1]), min(a[2], a[0] + b[2]), max(a[3], b[3], a[1] - (a[0] + b[2])), a[4] + b[4]

    def fold(self, before: tuple | None, v: np.ndarray) -> tuple:
        run = np.concatenate([[0.0], np.cumsum(np.nan_to_num(v))])
        own = (run[-1], run.max(), run.min(), (np.maximum.accumulate(run) - run).max(), float((~np.isnan(v)).sum()))
        return self.merge(before, own) if before else own


class _Losses:
    """(rows, losses before the first win, after the last one, longest run)."""

    names = ("n", "lead", "trail", "longest")

    @staticmethod
    def merge(a: tuple, b: tuple) -> tuple:
        lead = a[1] + (b[1] if a[1] == a[0] else 0)
        trail = b[2] + (a[2] if b[2] == b[0] else 0)
        return a[0] + b[0], lead, trail, max(a[3], b[3], a[2] + b[1])

    def fold(self, before: tuple | None, v: np.ndarray) -> tuple:
        won = np.flatnonzero(v > 0)
        n = len(v)
        gaps = np.diff(np.concatenate([[-1], won, [n]])) - 1
        own = (float(n), float(gaps[0]), float(gaps[-1]), float(gaps.max()))
        return self.merge(before, own) if before else own


def equity(df: DataFrame, by: list[str], order: list[str], profit: str, parts: int) -> DataFrame:
    """by, equity, peak and max_drawdown of each group; the start counts as 0, a null profit as no change."""
    t = _stretches(df, by, order, F.col(profit), parts, list(_Equity.names), _Equity().fold)
    start = F.struct(*(F.lit(0.0).alias(n) for n in _Equity.names))

    def merge(a: Column, b: Column) -> Column:
        return F.struct(
            (a["s"] + b["s"]).alias("s"), F.greatest(a["top"], a["s"] + b["top"]).alias("top"), F.least(a["low"], a["s"] + b["low"]).alias("low"),
            F.greatest(a["fall"], b["fall"], a["top"] - a["s"] - b["low"]).alias("fall"), (a["n"] + b["n"]).alias("n"),
        )

    t = t.withColumn("_r", F.aggregate("_s", start, merge))
    return t.select(*by, F.when(F.col("_r.n") > 0, F.col("_r.s")).alias("equity"), F.col("_r.top").alias("peak"), F.col("_r.fall").alias("max_drawdown"))


def losses(df: DataFrame, by: list[str], order: list[str], won: str, parts: int) -> DataFrame:
    """by and longest_losing_streak of each group; rows without a result neither count nor end a streak."""
    t = _stretches(df.where(F.col(won).isNotNull()), by, order, F.col(won).cast("int"), parts, list(_Losses.names), _Losses().fold)
    start = F.struct(*(F.lit(0.0).alias(n) for n in _Losses.names))

    def merge(a: Column, b: Column) -> Column:
        return F.struct(
            (a["n"] + b["n"]).alias("n"), (a["lead"] + F.when(a["lead"] == a["n"], b["lead"]).otherwise(0.0)).alias("lead"),
            (b["trail"] + F.when(b["trail"] == b["n"], a["trail"]).otherwise(0.0)).alias("trail"), F.greatest(a["longest"], b["longest"], a["trail"] + b["lead"]).alias("longest"),
        )

    return t.withColumn("_r", F.aggregate("_s", start, merge)).select(*by, F.col("_r.longest").cast("long").alias("longest_losing_streak"))
