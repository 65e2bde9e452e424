"""Point-in-time joins: history, as-of, band, resolution, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history_join(
    history: DataFrame, targets: DataFrame, entity: list[str], *, time: str, available_at: str, cutoff: str, history_id: str, target_id: str, season: str | None = None
) -> DataFrame:
    """Every history row that a target may see: strictly before its cutoff by both clocks, not the target itself.

    The output is as large as the histories together; bound it by season where that
    matters.  For windows over the latest rows use lag.prefix_features, which does not
    build it.
    """
    h = history.select(*(F.col(c).alias(f"h_{c}") for c in history.columns))
    on = [F.col(e) == F.col(f"h_{e}") for e in entity]
    on += [F.col(f"h_{time}") < F.col(cutoff), F.col(f"h_{available_at}") < F.col(cutoff), F.col(f"h_{history_id}") != F.col(target_id)]
    if season:
        on.append(F.col(season) == F.col(f"h_{season}"))
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return targets.join(h, cond)


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], *, left_time: str, right_time: str, values: list[str], strict: bool = False, order: list[str] | None = None, chunk: float | None = None
) -> DataFrame:
    """left with the values of the latest right row at or before (strict: before) left_time.

    One shuffle and one sort: both sides are tagged, united and scanned in order.  order
    breaks ties among right rows of one time, the last wins.  No match gives nulls.  As in
    any equi-join a null key matches nothing; right rows without a time are left out, and
    a null left_time sees nothing.

    chunk: seconds of a chunk of the time line.  A key is then scanned in chunks by as many
    tasks, and only each chunk's last value is carried on, so a key with a third of all
    rows is no long task.
    """
    order = order or []
    for k in [*keys, right_time]:
        right = right.where(F.col(k).isNotNull())
    pack = F.struct(*(F.col(v) for v in values))
    kind = right.select(pack.alias("v")).schema["v"].dataType
    l = left.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(left_time).alias("_t"), F.lit(0 if strict else 2).alias("_tag"),
        *(F.lit(None).cast(right.schema[o].dataType).alias(f"_o{i}") for i, o in enumerate(order)),
        F.lit(None).cast(kind).alias("_v"), F.struct(*left.columns).alias("_l"),
    )
    r = right.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(right_time).alias("_t"), F.lit(1).alias("_tag"),
        *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), pack.alias("_v"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"),
    )
    by, then = [f"_k{i}" for i in range(len(keys))], ["_t", "_tag", *(f"_o{i}" for i in range(len(order)))]
    both = l.unionByName(r)
    last = lambda keys: F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*then).rowsBetween(Window.unboundedPreceding, 0))
    if chunk is None:
        seen = both.withColumn("_v", last(by))
    else:
        both = both.withColumn("_c", F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / F.lit(chunk * 1e6)))
        ends = both.groupBy(*by, "_c").agg(F.max_by("_v", F.when(F.col("_tag") == 1, F.struct(*then))).alias("_end"))
        before = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*by, "_c", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
        seen = both.join(carried, [*by, "_c"], "left").withColumn("_v", F.coalesce(last([*by, "_c"]), F.col("_carry")))
    return seen.where(F.col("_l").isNotNull()).select("_l.*", *(F.col(f"_v.{v}").alias(v) for v in values))


def band_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], *, left_time: str, right_time: str, seconds: float, left_id: str, single: bool = False) -> DataFrame:
    """Pairs with equal keys whose times differ by at most so many seconds, with n_matches of each left row.

    Both sides meet by key and by buckets of twice that time, so a long history of one key
    is many buckets, each with what lies near.  single fails the query where a left row
    has more than one match.  Null keys and times match nothing.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    reach = max(int(seconds * 1_000_000), 1)
    bucket = lambda c: F.floor(c / F.lit(2 * reach)).cast("long")
    a = left.withColumn("_bucket", bucket(micros(left_time)))
    b = right.withColumn("_b", F.explode(F.array_distinct(F.array(bucket(micros(right_time) - reach), bucket(micros(right_time) + reach)))))
    cond = (F.col("_bucket") == F.col("_b")) & (F.abs(micros(left_time) - micros(right_time)) <= int(seconds * 1_000_000))
    for x, y in keys:
        cond = cond & (F.col(x) == F.col(y))
    out = a.join(b, cond).drop("_bucket", "_b").withColumn("n_matches", F.count(F.lit(1)).over(Window.partitionBy(left_id)))
    if single:
        told = F.concat(F.lit("more than one match for "), F.col(left_id).cast("string"))
        out = out.where(F.when(F.col("n_matches") > 1, F.raise_error(told).cast("boolean")).otherwise(F.lit(True)))
    return out


def resolve(rows: DataFrame, candidates: DataFrame, *, name: str, candidate_name: str, candidate_id: str, normalise, allowed: list[tuple[str, str]] | None = None) -> DataFrame:
    """rows with resolved_id and match_status: MATCHED only if exactly one candidate id has the normalised name."""
    c = candidates.select(normalise(F.col(candidate_name)).alias("_key"), F.col(candidate_id).alias("_id"), *(F.col(b).alias(f"_a{i}") for i, (_, b) in enumerate(allowed or [])))
    by = ["_key", *(f"_a{i}" for i in range(len(allowed or [])))]
    one = c.groupBy(*by).agg(F.min("_id").alias("_id"), F.count_distinct("_id").alias("_n"))
    cond = normalise(F.col(name)) == F.col("_key")
    for i, (a, _) in enumerate(allowed or []):
        cond = cond & (F.col(a) == F.col(f"_a{i}"))
    out = rows.join(one, cond, "left")
    status = F.when(F.col("_n") == 1, "MATCHED").when(F.col("_n") > 1, "AMBIGUOUS").otherwise("UNMATCHED")
    return out.withColumn("resolved_id", F.when(F.col("_n") == 1, F.col("_id"))).withColumn("match_status", status).drop(*by, "_id", "_n")


def unique_crosswalk(pairs: DataFrame, foreign: str, local: str) -> DataFrame:
    """Foreign ids that map to exactly one local id."""
    known = pairs.where(F.col(foreign).isNotNull() & F.col(local).isNotNull())
    return known.groupBy(foreign).agg(F.min(local).alias(local), F.max(local).alias("_max")).where(F.col(local) == F.col("_max")).drop("_max")


def conflicts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that carry more than one value."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def require_one_value(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows; the query fails where a key carries more than one value, as two spellings of one name in a book."""
    w = Window.partitionBy(*keys)
    told = F.concat(F.lit("conflicting values of "), F.to_json(F.struct(*keys)))
    fine = F.when(F.min(value).over(w) != F.max(value).over(w), F.raise_error(told).cast("boolean")).otherwise(F.lit(True))
    return rows.withColumn("_fine", fine).where("_fine").drop("_fine")


def coverage_gap(planned: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(present.select(*keys).distinct(), keys, "left_anti")


def members(rows: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(of.select(*keys).distinct(), keys, "left_semi")


def fan_out(games: DataFrame, *, home: str, away: str, mirrored: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Two rows a game, one for each side; mirrored names the (home, away) value of a column."""
    def side(i: int, own: str, other: str) -> Column:
        return F.struct(F.col(own).alias("team"), F.col(other).alias("opponent"), F.lit(i).alias("is_home"), *(v[1 - i].alias(k) for k, v in mirrored.items()))

    return games.withColumn("_s", F.explode(F.array(side(1, home, away), side(0, away, home)))).select(*games.columns, "_s.*")


def pair_sides(quotes: DataFrame, keys: list[str], side: str, price: str, sides: tuple[str, str] = ("Over", "Under")) -> DataFrame:
    """Keys with both sides, and the price of each (the best, where one repeats)."""
    named = [F.max(F.when(F.col(side) == s, F.col(price))).alias(s.lower()) for s in sides]
    return quotes.groupBy(*keys).agg(*named).where(" AND ".join(f"{s.lower()} IS NOT NULL" for s in sides))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str, eps: float = 1e-10) -> DataFrame:
    """One row: keys on one side only, keys on both, and values further apart than eps."""
    a, b = left.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_l")), right.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_r"))
    both = a.join(b, keys, "full")
    return both.agg(
        F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"), F.count_if(F.abs(F.col("_a") - F.col("_b")) > eps).alias("different"),
    )


def status_at(rows: DataFrame, statuses: DataFrame, keys: list[str], *, at: str, known_at: str, flag: str) -> DataFrame:
    """rows with flag: whether a status record of the key was known at or before a time of the row."""
    first = statuses.groupBy(*keys).agg(F.min(known_at).alias("_first"))
    return rows.join(first, keys, "left").withColumn(flag, F.coalesce(F.col("_first") <= F.col(at), F.lit(False))).drop("_first")


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of two tables side by side, by key; every row of both must find one partner.

    The query fails where a key is null, repeats on a side or stands on one side only.
    """
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias(c)
    a, b = left.select("*", n("_in_left")), right.select("*", n("_in_right"))
    both = a.join(b, keys, "full")
    bad = ~((F.col("_in_left").eqNullSafe(1)) & (F.col("_in_right").eqNullSafe(1)))
    told = F.concat(F.lit("no single partner for "), F.to_json(F.struct(*keys)))
    return both.where(F.when(bad, F.raise_error(told).cast("boolean")).otherwise(F.lit(True))).drop("_in_left", "_in_right")
