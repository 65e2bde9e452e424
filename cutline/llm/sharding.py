"""Consistent hashing with virtual nodes and bounded loads, in DataFrame operations.

Ring.  Every shard has ``vnodes`` points on a ring of 2^48 positions (MD5, so that any
engine can repeat it).  A row's key hashes to a position; the next point clockwise is its
home.  The ring is also cut by ``grid`` equal marks; what lies between two neighbouring
points or marks is a segment, inside one arc, and only segments are ever counted.

Bounded loads.  Shards have capacities that add up to the number of rows and differ by at
most one (law ``rows``).  A shard first takes the rows whose home it is, in ring order,
until it is full.  Rows beyond that continue clockwise to the next shard, then the next,
and are taken while there is room, so no more rows leave their home than must, and adding
a shard moves few.

Scale.  Only the row counts of the arcs (shards x vnodes of them) reach the driver, where
the walk over the ring deals out ranges of ranks; the rows get their rank from prefix sums
over segment counts plus a row number inside a segment.  Segments get finer as the table
grows, so no window partition does.  A hot key, whose one position holds more than that,
becomes a segment of its own and is dealt by ranges of the tie-break's hash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = 1 << 48


def _point(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:12], 16)


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard), in ring order."""
    return sorted((_point(f"shard-{s}#{v}"), s) for s in range(shards) for v in range(vnodes))


def segments(points: list[tuple[int, int]], grid: int, hot: tuple[int, ...] = ()) -> list[tuple[int, int, int, int]]:
    """(grid cell, first position, end, arc) of each segment, in ring order; hot positions stand alone."""
    width = RING // grid
    cuts = sorted({0, *(g * width for g in range(grid)), *(p + 1 for p, _ in points), *hot, *(p + 1 for p in hot)} - {RING})
    at = [p for p, _ in points]
    ends = [*cuts[1:], RING]
    return [(a // width, a, b, bisect_left(at, a) % len(points)) for a, b in zip(cuts, ends, strict=True)]


def walk(points: list[tuple[int, int]], arc_rows: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): which ranks of each arc go where.

    Round k offers what an arc has left to the k-th distinct shard clockwise from it.
    """
    shards, used, out = len(capacity), [0] * len(capacity), []
    order = []
    for i in range(len(points)):
        seen: list[int] = []
        for k in range(len(points)):
            s = points[(i + k) % len(points)][1]
            if s not in seen:
                seen.append(s)
                if len(seen) == shards:
                    break
        order.append(seen)
    done = [0] * len(points)
    for k in range(shards):
        for arc, seen in enumerate(order):
            if k < len(seen):
                s = seen[k]
                n = min(arc_rows[arc] - done[arc], capacity[s] - used[s])
                if n > 0:
                    out.append((arc, done[arc], done[arc] + n, s, used[s]))
                    done[arc] += n
                    used[s] += n
    return out


def key_position(key: Column) -> Column:
    """Ring position of a key; null is a key of its own."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\u0000null"))), 1, 12), 16, 10).cast("long")


def assign_shards(
    df: DataFrame,
    key: str,
    shards: int,
    *,
    vnodes: int = 128,
    grid: int = 4096,
    rows_per_segment: int = 4096,
    tie_break: list[Column] | None = None,
    names: tuple[str, str] = ("shard", "slot"),
) -> DataFrame:
    """df with two more columns: the shard, and the row's gapless slot in it from 0.

    tie_break: what orders rows of equal keys, and spreads them over window partitions.
    Rows that agree in all of it are interchangeable and stay in one partition.  Null keys
    are a key of their own.  A column of df that has one of the new names is replaced,
    other columns are carried as one struct, whatever their names.  An empty df gives an empty result.
    """
    spark = df.sparkSession
    shard_col, slot_col = names
    ties = [F.col(f"_tie{i}") for i in range(len(tie_break or []))]
    df = df.drop(shard_col, slot_col).select(F.struct("*").alias("_row"), F.col(key).alias("_key"), *(t.alias(f"_tie{i}") for i, t in enumerate(tie_break or [])))
    points = ring_points(shards, vnodes)
    n = df.count()
    fine = max(1, -(-n // (rows_per_segment * grid)))
    # One position may hold so many rows; at most 4096 positions hold more.
    most = max(rows_per_segment, -(-n // 4096))
    own = F.xxhash64(*(ties or [F.col("_key")]))

    def placed(frame: DataFrame, hot: dict[int, int]) -> DataFrame:
        """frame with its segment, and its part of it: finer for larger tables, by the tie-break's hash for hot positions."""
        # Bounded by the ring's parameters: shards * vnodes + grid + 8192 rows, whatever df holds.
        pieces = [(i, *p, -(-hot.get(p[1], 0) // most)) for i, p in enumerate(segments(points, grid, tuple(hot)))]
        table = spark.createDataFrame(pieces, "_seg int, _cell int, _from long, _to long, _arc int, _fan int")
        frame = frame.withColumns({"_pos": key_position(F.col("_key")), "_own": own})
        own_cell = F.expr(f"_pos div {RING // grid}").cast("int")
        hit = (own_cell == F.col("_cell")) & (F.col("_pos") >= F.col("_from")) & (F.col("_pos") < F.col("_to"))
        frame = frame.join(F.broadcast(table), hit).drop("_cell")
        part = F.expr(f"cast((_pos - _from) * {fine} div (_to - _from) as int)") if fine > 1 else F.lit(0)
        if hot:
            spread = F.least(F.floor((F.col("_own") / F.lit(2.0**64) + 0.5) * F.col("_fan")), F.col("_fan") - 1).cast("int")
            part = F.when(F.col("_fan") > 0, spread).otherwise(part)
        return frame.withColumn("_part", part)

    def counted(hot: dict[int, int]) -> DataFrame:
        return placed(df, hot).groupBy("_arc", "_seg", "_part").agg(F.count(F.lit(1)).alias("_n"))

    def arcs(hot: dict[int, int]) -> list:
        """(arc, rows, most rows of a part): at most shards * vnodes rows."""
        return counted(hot).groupBy("_arc").agg(F.sum("_n"), F.max("_n")).collect()

    hot: dict[int, int] = {}
    told = arcs(hot)
    if max((r[2] for r in told), default=0) > most:
        # at most 4096 rows
        hot = dict(df.groupBy(key_position(F.col("_key")).alias("_pos")).count().where(F.col("count") > most).collect())
        told = arcs(hot) if hot else told
    counts = counted(hot)
    before = Window.partitionBy("_arc").orderBy("_seg", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_seg", "_part", "_start")

    per_arc = {r[0]: r[1] for r in told}
    total = sum(per_arc.values())
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    dealt = walk(points, [per_arc.get(i, 0) for i in range(len(points))], capacity)
    # At most shards * vnodes + shards ranges.
    ranges = spark.createDataFrame(dealt or [(-1, 0, 0, 0, 0)], f"_in_arc int, _lo long, _hi long, _shard int, _slot0 long")

    inside = Window.partitionBy("_seg", "_part").orderBy("_pos", "_own", *ties)
    ranked = placed(df, hot).withColumn("_rn", F.row_number().over(inside) - 1).join(starts, ["_seg", "_part"]).withColumn("_rank", F.col("_start") + F.col("_rn"))
    hit = (F.col("_arc") == F.col("_in_arc")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    slot = F.col("_slot0") + F.col("_rank") - F.col("_lo")
    return ranked.join(F.broadcast(ranges), hit).select("_row.*", F.col("_shard").alias(shard_col), slot.alias(slot_col))
