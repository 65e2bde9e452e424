"""Violation counts: clocks, lineage, quotes, labels, feature and scored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def temporal(rows: DataFrame, cutoff: str, strict: list[str], inclusive: list[str]) -> DataFrame:
    """rows with max_available, violations (names of clocks past the cutoff) and status PASS or BLOCKED.

    Strict clocks must lie before the cutoff, inclusive ones at or before; a missing clock
    is no violation.
    """
    bad = [F.when(F.col(c) >= F.col(cutoff), F.lit(c)) for c in strict] + [F.when(F.col(c) > F.col(cutoff), F.lit(c)) for c in inclusive]
    names = F.array_join(F.filter(F.array(*bad), lambda x: x.isNotNull()), "|")
    clocks = [*strict, *inclusive]
    top = F.greatest(*clocks) if len(clocks) > 1 else F.col(clocks[0])
    return rows.withColumn("max_available", top).withColumn("violations", names).withColumn("status", F.when(names == "", "PASS").otherwise("BLOCKED"))


def recompute(rows: DataFrame, sources: DataFrame, *, ids: str, source_id: str, value: str, reported: str, keys: list[str], eps: float = 1e-12) -> DataFrame:
    """keys, recomputed, differs: the mean of the recorded sources against the reported value."""
    one = rows.withColumn("_id", F.explode(F.split(ids, ";"))).where("_id <> ''")
    s = sources.select(F.col(source_id).cast("string").alias("_id"), F.col(value).alias("_v"))
    again = one.join(s, "_id", "left").groupBy(*keys).agg(F.avg("_v").alias("recomputed"), F.count_if(F.col("_v").isNull()).alias("unknown_sources"))
    out = rows.select(*keys, reported).join(again, keys)
    return out.withColumn("differs", F.coalesce(F.abs(F.col("recomputed") - F.col(reported)) > eps, F.lit(True)))


def unmatched(reported: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """Reported rows that no raw row supports."""
    return reported.join(raw.select(*keys).distinct(), keys, "left_anti")


def outcome(left: DataFrame, right: DataFrame, keys: list[str], label: str) -> DataFrame:
    """One row: labels that agree, differ, or exist on one side only."""
    a, b = left.select(*keys, F.col(label).alias("_a")), right.select(*keys, F.col(label).alias("_b"))
    j = a.join(b, keys, "full")
    return j.agg(F.count_if(F.col("_a") == F.col("_b")).alias("agree"), F.count_if(F.col("_a") != F.col("_b")).alias("differ"), F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"))


def with_provenance(left: DataFrame, right: DataFrame, keys: list[str], label: str, names: tuple[str, str]) -> DataFrame:
    """keys, label and provenance: agreed, from one side only, or the left one over the right."""
    a, b = left.select(*keys, F.col(label).alias("_a")), right.select(*keys, F.col(label).alias("_b"))
    tag = F.when(F.col("_a").isNull(), f"{names[1]}_only").when(F.col("_b").isNull(), f"{names[0]}_only").when(F.col("_a") == F.col("_b"), "agreed").otherwise(f"{names[0]}_over_{names[1]}")
    return a.join(b, keys, "full").select(*keys, F.coalesce("_a", "_b").alias(label), tag.alias("provenance"))


def feature_table(rows: DataFrame, schedule: DataFrame, *, key: str, cutoff: str, clocks: list[str], history: str, shares: list[str], same_as_schedule: list[str], ids: str, null_families: list[str]) -> DataFrame:
    """Violation counts of a feature table against the schedule that its keys come from.

    Source ids are the schedule's keys; null_families are columns that no source supplies
    and that must stay null.
    """
    late = F.lit(False)
    for c in clocks:
        late = late | F.coalesce(F.col(c) >= F.col(cutoff), F.lit(False))
    beyond = F.lit(False)
    for c in shares:
        beyond = beyond | F.coalesce(~F.col(c).between(0.0, 1.0), F.lit(False))
    plan = schedule.select(F.col(key), *(F.col(c).alias(f"_s_{c}") for c in same_as_schedule))
    apart = F.lit(False)
    for c in same_as_schedule:
        apart = apart | ~F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    filled = F.lit(False)
    for c in null_families:
        filled = filled | F.col(c).isNotNull()
    known = schedule.select(F.col(key).cast("string").alias("_id")).distinct().withColumn("_known", F.lit(True))
    named = rows.select(key, F.explode(F.split(ids, ";")).alias("_id")).where("_id <> ''")
    lost = named.join(known, "_id", "left").where("_known IS NULL").select(key).distinct().withColumn("_lost", F.lit(True))
    marked = rows.join(plan, key, "left").join(lost, key, "left")
    rules = {"late_history": late, "no_history": F.col(history) == 0, "share_out_of_range": beyond, "schedule_differs": apart, "unknown_sources": F.coalesce("_lost", F.lit(False)), "family_not_null": filled}
    one = marked.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *(F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    return one.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows"), *(F.count_if(n).alias(n) for n in rules))


def scored_table(rows: DataFrame, sums: DataFrame, told: DataFrame, *, key: str, p: str, fit: str, season: str, eps: float = 1e-9) -> DataFrame:
    """Violation counts of scored rows: range, keys, fit season before the scored one, sums by season against those told."""
    bad = sums.select(season, F.col(p).alias("_a")).join(told.select(season, F.col(p).alias("_b")), season, "full").agg(F.count_if(F.coalesce(F.abs(F.col("_a") - F.col("_b")) > eps, F.lit(True))).alias("sums_differ"))
    one = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.bool_or((F.col(p) <= 0) | (F.col(p) >= 1)).alias("_range"), F.count_if(F.col(fit) >= F.col(season)).alias("_late"))
    out = one.agg(F.sum("_n").alias("rows"), F.count_if("_range").alias("out_of_range"), F.sum(F.col("_n") - 1).alias("duplicates"), F.sum("_late").alias("not_forward"))
    return out.crossJoin(F.broadcast(bad))  # one row each


def rebuilt_table(stored: DataFrame, rebuilt: DataFrame, keys: list[str], values: list[str], *, sums: str, eps: float = 1e-9) -> DataFrame:
    """A stored table against its rebuild: rows, rows that differ or lack a partner, and sums that are not one."""
    b = rebuilt.select(*keys, *(F.col(c).alias(f"_{c}") for c in values), F.lit(True).alias("_there"))
    both = stored.withColumn("_here", F.lit(True)).join(b, keys, "full")
    apart = F.lit(False)
    for c in values:
        apart = apart | (F.abs(F.col(c) - F.col(f"_{c}")) > eps)
    return both.agg(
        F.count("_here").alias("rows"), F.count_if(F.coalesce(apart, F.lit(False))).alias("differing"), F.count_if(F.col("_here").isNull() | F.col("_there").isNull()).alias("missing"), F.count_if(F.abs(F.col(sums) - 1) > eps).alias("not_one"),
    )


def count_violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that break each rule, in one pass."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))


def require_none(counts: DataFrame) -> DataFrame:
    """counts, or an error that names the broken rules."""
    row = counts.head().asDict()
    broken = {k: n for k, n in row.items() if k != "rows" and n}
    if broken:
        raise ValueError(f"violations: {broken}")
    return counts


def require_budget(plan: DataFrame, cost: str, budget: int) -> DataFrame:
    """plan, or an error if its cost exceeds the budget: fail closed."""
    total = plan.agg(F.sum(cost)).head()[0] or 0
    if total > budget:
        raise ValueError(f"the plan costs {total}, over {budget}")
    return plan


def ambiguous(rows: DataFrame, keys: list[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(unambiguous, quarantined) rows; strict raises instead of parting them."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    marked = rows.join(n, keys)
    if strict:
        marked = marked.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("ambiguous key"))).otherwise(F.col("_n")))
    return marked.where("_n = 1").drop("_n"), marked.where("_n > 1").drop("_n")


def disagreements(rows: DataFrame, difference: str, keys: list[str], history: DataFrame, entity: list[str], *, value: str, order: list[str], aliases: DataFrame, alias: str, n: int = 20, last: int = 3) -> DataFrame:
    """The n rows of greatest absolute difference, with n_history, the tail of the last values and ambiguous identity.

    A top-k report: only the entities of those n rows meet their history.  An entity is
    ambiguous if another shares its alias.
    """
    top = rows.orderBy(F.desc(F.abs(F.round(difference, 9))), *keys).limit(n)
    own = history.join(F.broadcast(top.select(*entity).distinct()), entity, "left_semi")  # n rows at most
    w = Window.partitionBy(*entity).orderBy(*(F.desc(c) for c in order))
    ranked = own.withColumn("_r", F.row_number().over(w))
    told = ranked.groupBy(*entity).agg(F.count(F.lit(1)).alias("n_history"), F.array_sort(F.collect_list(F.when(F.col("_r") <= last, F.struct(F.col("_r"), F.col(value).cast("string").alias("v"))))).alias("_t"))
    told = told.select(*entity, "n_history", F.array_join(F.reverse(F.transform("_t", lambda x: x["v"])), ";").alias("tail"))
    shared = aliases.groupBy(alias).agg(F.count_distinct(*entity).alias("_n"))
    known = aliases.join(shared, alias).select(*entity, (F.col("_n") > 1).alias("ambiguous"))
    return top.join(told, entity).join(known, entity)
