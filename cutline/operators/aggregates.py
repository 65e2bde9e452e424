"""Conditional aggregates over plays and fact rows, coverage and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify(kind: Column, *, void: Column, kneel: Column, actor: Column, scored: Column, scorer: Column, lateral: Column) -> Column:
    """Struct (type, actor, label, reason) of a play; the order of the tests matters.

    Voided plays and kneels are no opportunity; a score by someone else, or after a
    lateral, has no label.
    """
    reason = (
        F.when(F.coalesce(void, F.lit(False)), "void").when(F.coalesce(kneel, F.lit(False)), "kneel").when(kind.isNull(), "no_type").when(actor.isNull(), "no_actor")
        .when(F.coalesce(scored, F.lit(0)).eqNullSafe(F.lit(1)) & F.coalesce(lateral, F.lit(False)), "lateral")
        .when(F.coalesce(scored, F.lit(0)).eqNullSafe(F.lit(1)) & ~scorer.eqNullSafe(actor), "other_scorer")
    )
    fine = reason.isNull()
    return F.struct(F.when(fine, kind).alias("type"), F.when(fine, actor).alias("actor"), F.when(fine, F.coalesce(scored, F.lit(0)).cast("int")).alias("label"), reason.alias("reason"))


def finite(c: Column) -> Column:
    """null for NaN and infinities."""
    v = c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def play_context(yard: Column, air: Column, category: Column) -> dict[str, Column]:
    y, a = finite(yard), finite(air)
    return {
        "yard": y, "log_yard": F.log1p(y), "inside_20": (y <= 20).cast("int"), "inside_10": (y <= 10).cast("int"), "inside_5": (y <= 5).cast("int"),
        "past_line": a - y, "end_zone_target": (a >= y).cast("int"), "category": F.coalesce(category, F.lit("Unknown")),
    }


def zone_counts(plays: DataFrame, by: list[str], kind: str = "kind", yard: str = "yardline", air: str = "air") -> DataFrame:
    """Six counters; an unknown air distance of a catch makes the end-zone counter unknown, not the others."""
    rush, catch, y = F.col(kind) == "rushing", F.col(kind) == "receiving", F.col(yard)
    unknown = F.bool_or(catch & F.col(air).isNull())
    return plays.groupBy(*by).agg(
        F.count_if(rush & (y <= 20)).alias("red_zone_carries"), F.count_if(rush & (y <= 10)).alias("inside_10_carries"), F.count_if(rush & (y <= 5)).alias("inside_5_carries"),
        F.count_if((rush | catch) & (y <= 5)).alias("goal_line"), F.count_if(catch & (y <= 20)).alias("red_zone_targets"),
        F.when(~F.coalesce(unknown, F.lit(False)), F.count_if(catch & (F.col(air) >= y))).alias("end_zone_targets"),
    )


def efficiency(plays: DataFrame, by: list[str], *, kind: str, value: str, td: str, drive: str, explosive: float) -> DataFrame:
    v = F.col(value)
    return plays.groupBy(*by).agg(
        F.count(F.lit(1)).alias("plays"), F.avg(v).alias("mean_value"), F.avg(F.when(F.col(kind) == "rushing", v)).alias("rush_value"), F.avg(F.when(F.col(kind) == "receiving", v)).alias("catch_value"),
        F.avg((v >= explosive).cast("double")).alias("explosive_rate"), F.sum(td).cast("long").alias("tds"),
        # a null drive counts as one drive of its own
        (F.count_distinct(drive) + F.max(F.col(drive).isNull().cast("int"))).alias("drives"),
    )


def drive_conversion(plays: DataFrame, game: list[str], drive: str, *, near: Column, scored: Column) -> DataFrame:
    """Per drive whether it came near and whether it scored, then trips, conversions and their ratio per game."""
    each = plays.groupBy(*game, drive).agg(F.bool_or(near).alias("near"), F.bool_or(scored).alias("scored"))
    return each.groupBy(*game).agg(F.count_if("near").alias("trips"), F.count_if(F.col("near") & F.col("scored")).alias("conversions")).withColumn("rate", F.try_divide(F.col("conversions").cast("double"), F.col("trips")))


def value_rollup(plays: DataFrame, *, group: list[str], member: str, kind: str, value: str) -> DataFrame:
    """Value by member and type, with rates, the group's totals and the member's shares."""
    v = F.col(value)
    own = plays.groupBy(*group, member).agg(
        F.sum(F.when(F.col(kind) == "rushing", v)).alias("rushing_value"), F.sum(F.when(F.col(kind) == "receiving", v)).alias("receiving_value"), F.sum(v).alias("total_value"),
        F.count_if(F.col(kind) == "rushing").alias("rushes"), F.count_if(F.col(kind) == "receiving").alias("targets"),
    )
    w = Window.partitionBy(*group)
    own = own.fillna(0.0, ["rushing_value", "receiving_value"])
    for k in ("rushing", "receiving", "total"):
        own = own.withColumn(f"group_{k}", F.sum(f"{k}_value").over(w))
        own = own.withColumn(f"{k}_share", F.when(F.col(f"group_{k}") > 0, F.col(f"{k}_value") / F.col(f"group_{k}")))
    return own.withColumn("value_per_rush", F.try_divide("rushing_value", "rushes")).withColumn("value_per_target", F.try_divide("receiving_value", "targets"))


def inferred_total(rows: DataFrame, by: list[str], part: str, share: str) -> DataFrame:
    """The whole that parts and their shares imply: the median ratio, half to even."""
    return rows.where(F.col(share) > 0).groupBy(*by).agg(F.bround(F.median(F.col(part) / F.col(share)), 0).alias("inferred_total"))


def coverage(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, column, present, missing, pct: one pass over all columns, then turned on its side."""
    one = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *(F.count(c).alias(c) for c in columns))
    long = one.unpivot([*by, "_n"], columns, "column", "present")
    return long.select(*by, "column", "present", (F.col("_n") - F.col("present")).alias("missing"), F.round(F.col("present") * 100.0 / F.col("_n"), 4).alias("pct"))


def first_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def set_equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: members on one side only, and whether the sets are equal."""
    left, right = a.distinct(), b.distinct()
    la = left.exceptAll(right).agg(F.count(F.lit(1)).alias("only_left"))
    rb = right.exceptAll(left).agg(F.count(F.lit(1)).alias("only_right"))
    return la.join(F.broadcast(rb)).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def team_value(plays: DataFrame, by: list[str], value: str, near: Column) -> DataFrame:
    """by, team_value and near_value: log1p of summed values, of all plays and of those near the goal."""
    return plays.groupBy(*by).agg(F.log1p(F.sum(value)).alias("team_value"), F.log1p(F.sum(F.when(near, F.col(value)))).alias("near_value"))


def labels(rows: DataFrame, keys: list[str], count: Column) -> DataFrame:
    """keys, n and label: a count that is 0 where nothing is known, and whether it is positive."""
    n = F.coalesce(count, F.lit(0)).cast("long")
    return rows.select(*keys, n.alias("n"), (n > 0).cast("long").alias("label"))


def completeness(rows: DataFrame, plan: DataFrame, keys: list[str], value: str, order: list[str], planned: str) -> DataFrame:
    """keys, last value by order, and whether it is the planned one."""
    last = rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("last"))
    return plan.select(*keys, planned).join(last, keys).select(*keys, "last", (F.col("last") == F.col(planned)).alias("complete"))


def performers(rows: DataFrame, actor: str, game: str, difference: Column, n: int = 8) -> DataFrame:
    """actor, games, diff and side: the n furthest above and below expectation, a top-k report."""
    s = rows.groupBy(actor).agg(F.count_distinct(game).alias("games"), F.round(F.sum(difference), 9).alias("diff"))
    over = s.orderBy(F.desc("diff"), actor).limit(n).withColumn("side", F.lit("over"))
    return over.unionByName(s.orderBy("diff", actor).limit(n).withColumn("side", F.lit("under")))


def participation(members: DataFrame, key: str, *evidence: DataFrame) -> DataFrame:
    """members with evidence: seen if any source has the key; absence is unknown, not false."""
    seen = evidence[0].select(key)
    for e in evidence[1:]:
        seen = seen.unionByName(e.select(key))
    return members.join(seen.distinct().withColumn("evidence", F.lit("seen")), key, "left")
