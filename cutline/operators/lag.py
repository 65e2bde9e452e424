"""Strictly lagged window features.

prefix_features computes windows once along each history, in time order, and gives every
target those of the last row it may see, by one as-of scan: work is linear in history plus
targets.  That is exact where the rows a target may see are a prefix of the history, which
the scan itself finds out: their number must be the rank of the latest of them.  Targets
for which it is not - a game whose result came in late lies between, or the target's own
row is already known - are answered by a sweep in order of availability instead (sweep.py), which
is linear too; so is an entity of any length with ``chunk``, which sweeps it by many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..sources import staging
from . import sweep

#: A block of so many half-lives: rows before the previous block add nothing to a double.
BLOCK_HALF_LIVES = 64


def _mean(col: str, w: WindowSpec, null_policy: str) -> Column:
    """The mean in a frame: strict is null if any value is, skip leaves nulls out."""
    mean = F.avg(col).over(w)
    return mean if null_policy == "skip" else F.when(F.count(col).over(w) == F.count(F.lit(1)).over(w), mean)


def _total(col: str, w: WindowSpec, null_policy: str) -> Column:
    total = F.sum(col).over(w)
    return total if null_policy == "skip" else F.when(F.count(col).over(w) == F.count(F.lit(1)).over(w), total)


def _ratio(num: str, den: str, w: WindowSpec, null_policy: str) -> Column:
    """Ratio of sums in a frame; null if the denominator is not positive, strict also if a part is null."""
    total = F.sum(den).over(w)
    ratio = F.when(total > 0, F.sum(num).over(w) / total)
    whole = (F.count(num).over(w) == F.count(F.lit(1)).over(w)) & (F.count(den).over(w) == F.count(F.lit(1)).over(w))
    return ratio if null_policy == "skip" else F.when(whole, ratio)


def ewma(col: str, w: WindowSpec, half_life: float, null_policy: str = "strict", *, rows: int) -> Column:
    """Mean of the last rows with weight 0.5^(rank/half_life), the newest row at rank 0; ranks count null rows too.

    For a few rows; a whole history takes the running sums of prefix_features.
    """
    values = F.collect_list(F.struct(F.col(col).alias("m"))).over(w.rowsBetween(-(rows - 1), 0))
    n = F.size(values)
    pairs = F.transform(values, lambda x, i: F.struct(x["m"].alias("m"), F.pow(F.lit(0.5), (n - 1 - i) / F.lit(float(half_life))).alias("w")))
    some = F.filter(pairs, lambda p: p["m"].isNotNull())
    both = F.aggregate(
        some, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda a, p: F.struct((a["s"] + p["m"] * p["w"]).alias("s"), (a["w"] + p["w"]).alias("w"))
    )
    value = F.when(both["w"] > 0, both["s"] / both["w"])
    return value if null_policy == "skip" else F.when(F.size(some) == n, value)


def _weighted(num: Column, den: Column, keys: list[str], order: list[str], half_life: float, null_policy: str) -> Column:
    """Ratio of the weighted sums of num and den over the whole history, by running sums in blocks of ranks.

    A row's weight is 2^(rank in its block / half_life); the previous block counts for
    2^-64 less, and what is older not at all.  The ratio is taken at the newest row that
    has both parts, where that is exact, and carried on over rows that have not: weights
    cancel, however many nulls follow.
    """
    length = math.ceil(BLOCK_HALF_LIVES * half_life)
    whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rangeBetween(-1, -1)
    fine = num.isNotNull() & den.isNotNull()
    weight = F.pow(F.lit(2.0), (F.col("_rank") - 1 - F.col("_block") * length) / F.lit(float(half_life)))
    shrink = 2.0 ** (-length / half_life)

    def total(c: Column) -> Column:
        own = F.when(fine, c * weight)
        return F.sum(own).over(inside) + F.coalesce(F.sum(own).over(before), F.lit(0.0)) * shrink

    value = F.last(F.when(fine, F.struct((F.when(total(den) > 0, total(num) / total(den))).alias("v"))), ignorenulls=True).over(whole)["v"]
    return value if null_policy == "skip" else F.when(F.count(F.when(fine, 1)).over(whole) == F.col("_rank"), value)


def _windows(history: DataFrame, keys: list[str], order: list[str], available_at: str, windows: dict[str, int | None], metrics: list[str], shares: dict[str, tuple[str, str]], sums: bool, with_ewma: bool, ewma_rows: int | None, half_life: float, null_policy: str, lineage: int | None) -> tuple[DataFrame, list[str]]:
    """history with _rank and the features of each row's prefix, and their names."""
    time, row_id = order
    base = Window.partitionBy(*keys).orderBy(*order)
    frame = lambda n: base.rowsBetween(-(n - 1) if n else Window.unboundedPreceding, 0)
    history = history.withColumn("_rank", F.row_number().over(base))
    made: dict[str, Column] = {"n_history": F.col("_rank").cast("long")}
    for name, n in windows.items():
        for m in metrics:
            made[f"{name}_{m}"] = _mean(m, frame(n), null_policy)
            if sums:
                made[f"{name}_sum_{m}"] = _total(m, frame(n), null_policy)
        for s, (num, den) in shares.items():
            made[f"{name}_{s}"] = _ratio(num, den, frame(n), null_policy)
    if with_ewma and (metrics or shares):
        history = history.withColumn("_block", F.expr(f"(_rank - 1) div {math.ceil(BLOCK_HALF_LIVES * half_life)}"))
        for m in metrics:
            value = F.col(m).cast("double")
            made[f"ewma_{m}"] = _weighted(value, F.when(value.isNotNull(), F.lit(1.0)), keys, order, half_life, null_policy)
        for s, (num, den) in shares.items():
            made[f"ewma_{s}"] = _weighted(F.col(num).cast("double"), F.col(den).cast("double"), keys, order, half_life, null_policy)
    for m in metrics if ewma_rows else ():
        made[f"ewma{ewma_rows}_{m}"] = ewma(m, base, half_life, null_policy, rows=ewma_rows)
    if lineage:
        made["source_ids"] = F.array_join(F.collect_list(F.col(row_id).cast("string")).over(frame(lineage)), ";")
        made["latest_used"] = F.max(time).over(frame(lineage))
        made["max_available_at"] = F.max(available_at).over(frame(lineage))
    return history.withColumns(made), list(made)


def prefix_features(
    history: DataFrame,
    targets: DataFrame,
    entity: list[str],
    *,
    time: str = "kickoff",
    available_at: str = "available_at",
    cutoff: str = "prediction_time",
    row_id: str = "game_id",
    metrics: list[str] = (),
    shares: dict[str, tuple[str, str]] | None = None,
    windows: dict[str, int | None] | None = None,
    season: str | None = None,
    half_life: float = 3.0,
    null_policy: str = "strict",
    sums: bool = False,
    with_ewma: bool = True,
    ewma_rows: int | None = None,
    lineage: int | None = None,
    chunk: float | None = None,
    only: list[str] | None = None,
) -> DataFrame:
    """targets with {window}_{metric}, {window}_{share}, ewma_{metric}, ewma_{share}, n_history and lineage columns.

    A target sees the history rows of its entity whose time and availability both lie
    strictly before its cutoff, its own row (of the same row_id, where targets have one)
    never.  Availability may be in any order.  Rows without a time or an availability are
    never seen, and a null key or cutoff sees nothing.

    windows maps a name to a number of rows, None for all.  season: a column that history
    and target must share.  shares maps a name to (numerator, denominator); a share is the
    ratio of sums over the window, null if a part is null or the denominator is not
    positive.  sums adds {window}_sum_{metric}, ewma_rows ewma{n}_{metric} over the last n rows.  lineage: how many of the latest ids to
    list, oldest first.  A target without history has null features and n_history 0.

    chunk: seconds of a chunk of the time line, for entities too long for one task.  Each chunk is swept
    by itself, from the state that the chunks before it leave behind.

    only: the features asked for beside n_history; None for all.  No others are computed along the histories.
    """
    windows = windows if windows is not None else {"last3": 3, "last5": 5, "last8": 8}
    keys, order = [*entity, *([season] if season else [])], [time, row_id]
    told_by = (available_at, windows, list(metrics), shares or {}, sums, with_ewma, ewma_rows, half_life, null_policy, lineage)
    fine = F.col(time).isNotNull() & F.col(available_at).isNotNull()
    for k in keys:
        fine = fine & F.col(k).isNotNull()
    if row_id not in targets.columns:
        # Without an own row all targets of one key and cutoff see the same: each is asked for once, however many share it.
        asked = [*keys, cutoff]
        each = targets.select(*asked).distinct().select(*(F.col(c).alias(f"_q{i}") for i, c in enumerate(asked)), *asked, F.lit(None).cast("string").alias(row_id))
        options = {"time": time, "available_at": available_at, "cutoff": cutoff, "row_id": row_id, "metrics": metrics, "shares": shares, "windows": windows, "season": season, "half_life": half_life, "null_policy": null_policy, "sums": sums, "with_ewma": with_ewma, "ewma_rows": ewma_rows, "lineage": lineage, "chunk": chunk, "only": only}
        found = prefix_features(history, each, entity, **options).drop(*asked, row_id)
        same_asked = F.lit(True)
        for i, c in enumerate(asked):
            same_asked = same_asked & targets[c].eqNullSafe(found[f"_q{i}"])
        return targets.join(found, same_asked, "left").drop(*(f"_q{i}" for i in range(len(asked))))
    history = history.where(fine).withColumn("_known", F.greatest(time, available_at))
    told, names = _windows(history, keys, order, *told_by)
    names = [n for n in names if only is None or n == "n_history" or n in only]

    if chunk:
        blind = F.col(cutoff).isNull()
        for k in keys:
            blind = blind | F.col(k).isNull()
        unseen = targets.where(blind).select("*", *(F.lit(None).cast(told.schema[n].dataType).alias(n) for n in names))
        out = _swept(history, targets.where(~blind), keys, order, told, names, told_by, cutoff, chunk).unionByName(unseen)
        return out.withColumn("n_history", F.coalesce("n_history", F.lit(0)).cast("long"))

    # Tagged union, one exchange by key: targets stand before history of the same instant.
    pack = F.struct("_rank", *names)
    kind = told.select(pack.alias("v")).schema["v"].dataType
    own_id = F.col(row_id).cast("string") if row_id in targets.columns else F.lit(None).cast("string")
    at = F.col(cutoff).cast(told.schema["_known"].dataType)
    left = targets.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), at.alias("_t"), F.lit(0).alias("_tag"), own_id.alias("_id"), F.lit(None).cast(kind).alias("_v"), F.struct(*targets.columns).alias("_l"))
    row = left.schema["_l"].dataType
    right = told.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_known").alias("_t"), F.lit(1).alias("_tag"), F.col(row_id).cast("string").alias("_id"), pack.alias("_v"), F.lit(None).cast(row).alias("_l"))
    by = [f"_k{i}" for i in range(len(keys))]
    seen = Window.partitionBy(*by).orderBy("_t", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy(*by, "_id")
    scan = left.unionByName(right).withColumns({
        "_v": F.max("_v").over(seen), "_n": F.count("_v").over(seen), "_own": F.min(F.when(F.col("_tag") == 1, F.col("_t"))).over(same),
    }).where("_tag = 0")
    some = F.lit(True)
    for k in by:
        some = some & F.col(k).isNotNull()
    prefix = F.coalesce(F.col("_v._rank") == F.col("_n"), F.lit(True)) & ~F.coalesce(F.col("_own") < F.col("_t"), F.lit(False))
    scan = scan.select("_l", "_t", *by, F.col("_v"), (~some | F.col("_t").isNull() | prefix).alias("_plain"))
    # Written, since it is asked for three times: what is late, what is not, and whether there is any.
    scan = staging.stage(scan, "seen")
    plain = scan.where("_plain").select("_l.*", *(F.when(some & F.col("_t").isNotNull(), F.col(f"_v.{n}")).alias(n) for n in names))

    # Where no target is late nothing is swept.
    rest, out = scan.where("not _plain").select("_l.*"), plain
    if not rest.isEmpty():
        some_history = history.join(rest.select(*keys).distinct(), keys, "left_semi")
        out = plain.unionByName(_swept(some_history, rest, keys, order, told, names, told_by, cutoff, None))
    return out.withColumn("n_history", F.coalesce("n_history", F.lit(0)).cast("long"))


def _swept(history: DataFrame, targets: DataFrame, keys: list[str], order: list[str], told: DataFrame, names: list[str], told_by: tuple, cutoff: str, chunk: float | None) -> DataFrame:
    """targets with the features, by sweeps in order of availability."""
    available_at, windows, metrics, shares, sums, with_ewma, ewma_rows, half_life, null_policy, lineage = told_by
    values = sorted({*metrics, *(c for pair in shares.values() for c in pair)})
    at = {c: i for i, c in enumerate(values)}
    weighted_rows = math.ceil(BLOCK_HALF_LIVES * half_life) if with_ewma and (metrics or shares) else 0
    depth = sweep.rows_needed(windows, weighted_rows, ewma_rows, lineage)
    want = sweep.Wanted(windows, {m: at[m] for m in metrics}, {s: (at[a], at[b]) for s, (a, b) in shares.items()}, sums, with_ewma, ewma_rows, half_life, null_policy == "strict", lineage, depth)
    decimal = lambda t: isinstance(t, S.DecimalType)
    history = history.withColumns({c: F.col(c).cast("double") for c in values if decimal(history.schema[c].dataType)})
    types = {n: S.DoubleType() if decimal(told.schema[n].dataType) else told.schema[n].dataType for n in sweep.names(want)}
    out = sweep.sweep(history, targets, keys, want, order=tuple(order), available_at=available_at, known="_known", cutoff=cutoff, values=values, types=types, chunk=chunk)
    return out.select(*targets.columns, *(F.col(n).cast(told.schema[n].dataType).alias(n) for n in names))
