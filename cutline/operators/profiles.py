"""Entities as they stood before a target: event rates, universes, rankings, profiles, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from . import lag


def event_rates(history: DataFrame, targets: DataFrame, entity: list[str], label: str, *, windows: dict[str, int | None] | None = None, ewma_rows: int = 8, half_life: float = 3.0, **clocks) -> DataFrame:
    """targets with n_history, wins, {window}_rate and ewma_rate of a 0/1 label over what each may see.

    The weighted rate looks at the last ewma_rows only.  clocks are those of
    lag.prefix_features.
    """
    windows = windows or {"last5": 5, "last8": 8}
    rows = history.withColumn("_label", F.col(label).cast("double"))
    out = lag.prefix_features(rows, targets, entity, metrics=["_label"], windows={**windows, "_all": None}, sums=True, with_ewma=False, ewma_rows=ewma_rows, half_life=half_life, null_policy="skip", **clocks)
    rates = [F.col(f"{n}__label").alias(f"{n}_rate") for n in windows]
    return out.select(*targets.columns, "n_history", F.coalesce("_all_sum__label", F.lit(0.0)).cast("long").alias("wins"), *rates, F.col(f"ewma{ewma_rows}__label").alias("ewma_rate"))


def candidate_universe(history: DataFrame, targets: DataFrame, entity: list[str], *, usage: str, allowed: Column, exempt: Column, recent: int = 3, **clocks) -> DataFrame:
    """Targets that are allowed by position, have so many recent rows, and some usage in them or are exempt.

    usage is a column of the history, allowed and exempt are conditions on a target.
    """
    out = lag.prefix_features(history.withColumn("_use", F.col(usage).cast("double")), targets, entity, metrics=["_use"], windows={"_recent": recent}, sums=True, with_ewma=False, null_policy="skip", **clocks)
    n = F.least(F.col("n_history"), F.lit(recent))
    kept = allowed & (n == recent) & ((F.coalesce("_recent_sum__use", F.lit(0.0)) > 0) | exempt)
    return out.where(kept).select(*targets.columns, n.cast("long").alias("n_recent"))


def top_usage(rows: DataFrame, group: list[str], member: str, usage: Column, n: int = 2, offered: DataFrame | None = None) -> DataFrame:
    """group, member, usage, rank: the members of most usage, ties to the lesser id; only those that offered lists, if given."""
    use = rows.groupBy(*group, member).agg(F.sum(usage).alias("usage"))
    if offered is not None:
        use = use.join(offered.select(member).distinct(), member, "left_semi")
    w = Window.partitionBy(*group).orderBy(F.desc("usage"), member)
    return use.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def profile(rows: DataFrame, entity: list[str], order: list[str], *, metric: str, part: str, whole: str, hits: str, scored: Column, last: int = 8, min_games: int = 3, min_scored: int = 3) -> DataFrame:
    """entity, games, scored_games, mean_metric, share of sums and smoothed rate over each entity's last rows, for those with enough of them."""
    w = Window.partitionBy(*entity).orderBy(*(F.desc(c) for c in order))
    some = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    out = some.groupBy(*entity).agg(
        F.count(F.lit(1)).alias("games"), F.count_if(scored).alias("scored_games"), F.avg(metric).alias("mean_metric"), F.when(F.sum(whole) > 0, F.sum(part) / F.sum(whole)).alias("share"), F.sum(hits).alias("hits"),
    )
    return out.where((F.col("games") >= min_games) & (F.col("scored_games") >= min_scored)).withColumn("smoothed", dist.smoothed_rate(F.col("hits"), F.col("games")))


def season_shares(rows: DataFrame, season: str, group: list[str], entity: str, counts: list[str]) -> DataFrame:
    """season, group, entity with each count's share of its group's season total; null where the total is not positive."""
    own = rows.groupBy(season, *group, entity).agg(*(F.sum(c).alias(c) for c in counts))
    w = Window.partitionBy(season, *group)
    return own.select(season, *group, entity, *(F.when(F.sum(c).over(w) > 0, F.col(c) / F.sum(c).over(w)).alias(f"{c}_share") for c in counts))


def availability(rows: DataFrame, key: str, cover: str, covered: DataFrame, cover_key: str, flag: str, statuses: DataFrame, status_key: str, active: Column, inactive: Column) -> DataFrame:
    """rows with available: complete coverage, positive evidence, and no inactive record, which wins.

    cover is the column of rows that covered says by cover_key whether all reports are in; statuses are records by
    status_key, of which active and inactive are conditions.  Nothing known is not available.
    """
    told = statuses.groupBy(F.col(status_key).alias("_who")).agg(F.bool_or(active).alias("_act"), F.bool_or(inactive).alias("_ina"))
    out = rows.join(covered.select(F.col(cover_key).alias("_cover"), F.col(flag).alias("_full")), F.col(cover) == F.col("_cover"), "left").join(told, F.col(key) == F.col("_who"), "left")
    no = F.lit(False)
    return out.withColumn("available", F.coalesce("_full", no) & F.coalesce("_act", no) & ~F.coalesce("_ina", no)).drop("_cover", "_full", "_who", "_act", "_ina")
