"""Window features by one sweep over each entity in order of availability.

What a target may see is what had become known before its cutoff, so in order of becoming
known it is always a prefix, however late results are and whatever the order of the events
themselves.  A sweep keeps a state of bounded size - the newest rows by event time, and
running counts and sums - and answers every target from it: work is linear in rows.

States merge.  With ``chunk`` an entity's time line is cut, every chunk is summed up by a task
of its own, the summaries (a bounded number of rows a chunk) are folded along the entity,
and every chunk is swept again from the state before it.  So an entity that holds a third
of all rows is as many tasks as it has chunks.  Of the rows that become known at one instant only
the newest that can decide anything are swept beside their counts and sums, and targets that see
the same are answered once: the Python work goes by instants, not by rows.
"""

from __future__ import annotations

import pickle
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

from ..sources import staging
from ..sources.ship import ship_package


@dataclass(frozen=True)
class Wanted:
    """What to compute; columns are positions in a row's values."""

    windows: dict[str, int | None]
    metrics: dict[str, int]
    shares: dict[str, tuple[int, int]]
    sums: bool
    with_ewma: bool
    ewma_rows: int | None
    half_life: float
    strict: bool
    lineage: int | None
    depth: int

    @property
    def weighted(self) -> list[tuple[str, int, int | None]]:
        """(name, numerator, denominator or None) of what is averaged over the whole history with weights."""
        if not self.with_ewma:
            return []
        return [(f"ewma_{m}", i, None) for m, i in self.metrics.items()] + [(f"ewma_{s}", a, b) for s, (a, b) in self.shares.items()]


def rows_needed(windows: dict[str, int | None], weighted_rows: int, ewma_rows: int | None, lineage: int | None) -> int:
    """How many of the newest rows decide everything but counts and sums; one more, since a target leaves out its own."""
    return 1 + max(1, weighted_rows, ewma_rows or 0, lineage or 0, *(n or 0 for n in windows.values()))


def _pair(values: tuple, a: int, b: int | None) -> tuple[float, float] | None:
    """Numerator and denominator of a weighted mean where a row has both."""
    x, y = values[a], 1.0 if b is None else values[b]
    return None if x is None or y is None else (float(x), float(y))


@dataclass
class State:
    """What is known so far: the newest rows (time, tie-break, availability, values, id), counts and sums of all.

    tails: for each weighted mean the decayed sums of the rows beyond the newest ones, which
    count only where none of those has a value, and how many rows lie before the last of them.
    """

    want: Wanted
    rows: list[tuple] = field(default_factory=list)
    n: int = 0
    counts: list[int] = field(default_factory=list)
    sums: list = field(default_factory=list)
    tails: list[tuple[float, float, int] | None] = field(default_factory=list)

    def __post_init__(self) -> None:
        w = self.want
        self.counts = self.counts or [0] * (1 + max([-1, *w.metrics.values(), *(i for p in w.shares.values() for i in p)]))
        self.sums = self.sums or [None] * len(self.counts)
        self.tails = self.tails or [None] * len(w.weighted)

    def add(self, row: tuple) -> None:
        self.n += 1
        for i, x in enumerate(row[3]):
            if x is not None:
                self.counts[i] += 1
                self.sums[i] = x if self.sums[i] is None else self.sums[i] + x
        self._place(row)

    def grow(self, n: int, counts: list[int], sums: list) -> None:
        """Counts and sums of all rows that became known at one instant."""
        self.n += n
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        self.sums = [b if a is None else a if b is None else a + b for a, b in zip(self.sums, sums, strict=True)]

    def _place(self, row: tuple) -> None:
        insort(self.rows, row, key=lambda r: r[:2])
        if len(self.rows) > self.want.depth:
            self._leave(self.rows.pop(0))

    def _leave(self, row: tuple) -> None:
        """A row beyond the newest joins the tails.  One that came in later than depth newer rows weighs
        nothing beside what is there already, so its exact place in the tail does not matter."""
        decay = 0.5 ** (1 / self.want.half_life)
        for k, (_, a, b) in enumerate(self.want.weighted):
            pair, tail = _pair(row[3], a, b), self.tails[k]
            if pair:
                shrink = decay ** (tail[2] + 1) if tail else 0.0
                self.tails[k] = (pair[0] + tail[0] * shrink, pair[1] + tail[1] * shrink, 0) if tail else (*pair, 0)
            elif tail:
                self.tails[k] = (tail[0], tail[1], tail[2] + 1)

    def merge(self, later: State) -> State:
        """This state after all rows of a later one."""
        out = State(self.want, list(self.rows), self.n + later.n, [a + b for a, b in zip(self.counts, later.counts, strict=True)], tails=list(self.tails))
        out.sums = [b if a is None else a if b is None else a + b for a, b in zip(self.sums, later.sums, strict=True)]
        for k, tail in enumerate(later.tails):
            out.tails[k] = tail or out.tails[k]
        for row in later.rows:
            out._place(row)
        return out

    def features(self, own: str | None, mine: list[tuple]) -> tuple | None:
        """Values in the order of names(); own: the id that must not be seen, mine: the values of its rows seen so far."""
        w = self.want
        rows = [r for r in self.rows if r[4] != own] if own is not None else self.rows
        n = self.n - len(mine)
        out: list = [n]
        if n <= 0:
            return None
        counts, sums = self.counts, self.sums
        if mine:
            counts, sums = list(counts), list(sums)
            for values in mine:
                for i, x in enumerate(values):
                    if x is not None:
                        counts[i], sums[i] = counts[i] - 1, sums[i] - x
        for size in w.windows.values():
            part = rows[-size:] if size else []
            total = len(part) if size else n
            for i in w.metrics.values():
                have = [r[3][i] for r in part if r[3][i] is not None]
                count, s = (len(have), sum(have) if have else None) if size else (counts[i], sums[i] if counts[i] else None)
                fine = count and (count == total or not w.strict)
                out.append(float(s) / count if fine else None)
                if w.sums:
                    out.append(s if fine else None)
            for a, b in w.shares.values():
                if size:
                    tops, lows = [r[3][a] for r in part if r[3][a] is not None], [r[3][b] for r in part if r[3][b] is not None]
                    top, low, whole = (sum(tops) if tops else None), (sum(lows) if lows else None), len(tops) == len(lows) == total
                else:
                    top, low, whole = (sums[a] if counts[a] else None), (sums[b] if counts[b] else None), counts[a] == counts[b] == total
                out.append(float(top) / float(low) if top is not None and low is not None and low > 0 and (whole or not w.strict) else None)
        for k, (_, a, b) in enumerate(w.weighted):
            out.append(self._weighted(rows, k, a, b, n, counts))
        for i in w.metrics.values() if w.ewma_rows else ():
            part = rows[-w.ewma_rows :]
            have = [(float(r[3][i]), 0.5 ** ((len(part) - 1 - j) / w.half_life)) for j, r in enumerate(part) if r[3][i] is not None]
            out.append(sum(x * y for x, y in have) / sum(y for _, y in have) if have and (len(have) == len(part) or not w.strict) else None)
        if w.lineage:
            part = rows[-w.lineage :]
            out += [";".join(r[4] for r in part), max(r[0] for r in part), max(r[2] for r in part)]
        return tuple(out)

    def _weighted(self, rows: list[tuple], k: int, a: int, b: int | None, n: int, counts: list[int]) -> float | None:
        pairs = [(j, p) for j, r in enumerate(rows) if (p := _pair(r[3], a, b))]
        if self.want.strict and (len(pairs) < len(rows) or counts[a] < n or (b is not None and counts[b] < n)):
            return None
        if pairs:
            at = np.array([j for j, _ in pairs])
            weight = 0.5 ** ((at[-1] - at) / self.want.half_life)
            top, low = (float(weight @ np.array([p[i] for _, p in pairs])) for i in (0, 1))
        elif self.tails[k]:
            top, low, _ = self.tails[k]
        else:
            return None
        return top / low if low > 0 else None


def names(w: Wanted) -> list[str]:
    """Names of what State.features returns, in its order."""
    out = ["n_history"]
    for name in w.windows:
        for m in w.metrics:
            out += [f"{name}_{m}", *([f"{name}_sum_{m}"] if w.sums else [])]
        out += [f"{name}_{s}" for s in w.shares]
    out += [x for x, *_ in w.weighted]
    out += [f"ewma{w.ewma_rows}_{m}" for m in w.metrics] if w.ewma_rows else []
    return out + (["source_ids", "latest_used", "max_available_at"] if w.lineage else [])


def _events(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(group, chunk, tag, time known, row, values of the target's own row, carried state)."""
    g = batch.column("_g").to_pylist()
    plain = lambda c: [None] * len(c) if c.null_count == len(c) else c.to_pylist()
    cols = [plain(batch.column(c)) for c in ("_c", "_tag", "_t", "_time", "_tie", "_available", "_values", "_id", "_mine", "_state", "_all")]
    for group, c, tag, t, time, tie, available, values, ident, mine, state, whole in zip(g, *cols, strict=True):
        yield group, c, tag, t, (time, tie, available, tuple(values.values()) if values else (), ident), mine, state, whole


def _at_once(told: DataFrame, want: Wanted, width: int) -> DataFrame:
    """Of the rows of one instant the newest, and a row (tag 2) of the counts and sums of all.

    What is left out lies beyond the newest rows for every target, so it decides only counts and sums; but
    tails of weighted means that skip nulls, so those are swept row by row.
    """
    instant = ["_g", "_c", "_t"]
    newest = told.withColumn("_rank", F.row_number().over(Window.partitionBy(*instant).orderBy(F.desc("_time"), F.desc("_tie")))).where(F.col("_rank") <= want.depth).drop("_rank")
    value = [F.col(f"_values.v{i}") for i in range(max(width, 1))]
    whole = F.struct(F.count(F.lit(1)).alias("n"), F.array(*(F.count(v) for v in value)).alias("counts"), F.struct(*(F.sum(v).alias(f"s{i}") for i, v in enumerate(value))).alias("sums"))
    return newest.unionByName(told.groupBy(*instant).agg(whole.alias("_all")).withColumn("_tag", F.lit(2)), allowMissingColumns=True)


def sweep(history: DataFrame, targets: DataFrame, keys: list[str], want: Wanted, *, order: tuple[str, str], available_at: str, known: str, cutoff: str, values: list[str], types: dict[str, S.DataType], chunk: float | None) -> DataFrame:
    """targets with the features of names(want), null where a target sees nothing.

    history: rows with no null in keys, clocks or `known`, the later of both clocks.  targets: rows with
    no null in keys or cutoff.  chunk: seconds of a chunk of the time line.
    """
    ship_package(history.sparkSession)
    time, row_id = order
    has_own = row_id in targets.columns
    by = F.to_json(F.struct(*(F.col(k).cast(history.schema[k].dataType).alias(f"k{i}") for i, k in enumerate(keys)))).alias("_g")
    kind = history.schema[known].dataType
    cut = lambda c: (F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(chunk * 1e6)) if chunk else F.lit(0)).cast("long").alias("_c")
    row = F.struct(*(F.col(x).alias(f"v{i}") for i, x in enumerate(values))) if values else F.struct(F.lit(None).cast("int").alias("v0"))
    told = history.select(by, cut(F.col(known)), F.lit(1).alias("_tag"), F.col(known).alias("_t"), F.col(time).alias("_time"), F.col(row_id).alias("_tie"), F.col(row_id).cast("string").alias("_id"), (F.col(available_at) if want.lineage else F.lit(None).cast(history.schema[available_at].dataType)).alias("_available"), row.alias("_values"))
    own_id = (F.col(row_id).cast("string") if has_own else F.lit(None).cast("string")).alias("_own")
    asked = targets.select(by, cut(F.col(cutoff)), F.lit(0).alias("_tag"), F.col(cutoff).cast(kind).alias("_t"), own_id, F.struct(*targets.columns).alias("_l"))
    own = F.struct(F.col("_k").alias("t"), F.col("_values").alias("v"))
    if has_own:  # rows of a target's own that are known before its cutoff, which few have
        ids = asked.select("_g", "_own", "_t").where(F.col("_own").isNotNull()).distinct()
        mine = told.select("_g", F.col("_id").alias("_own"), F.col("_t").alias("_k"), "_values").join(ids, ["_g", "_own"]).where(F.col("_k") < F.col("_t"))
        mine = mine.groupBy("_g", "_own", "_t").agg(F.collect_list(own).alias("_mine"))
        asked = asked.join(staging.stage(mine, "own") if chunk else mine, ["_g", "_own", "_t"], "left")
    else:
        asked = asked.withColumn("_mine", F.lit(None).cast(told.withColumn("_k", F.col("_t")).select(F.array(own).alias("m")).schema["m"].dataType))
    alike = asked.where(F.col("_mine").isNull())
    compact = bool(chunk) and (want.strict or not want.weighted)
    width = len(State(want).counts)
    told = staging.stage(_at_once(told, want, width), "told") if compact else told.withColumn("_all", F.lit(None).cast("int"))
    if chunk:
        # Targets that see none of their own rows see the same at the same instant.
        each = alike.select("_g", "_c", "_tag", "_t").distinct()
        asked = asked.where(F.col("_mine").isNotNull()).unionByName(each, allowMissingColumns=True)
    both = told.unionByName(asked.withColumnRenamed("_own", "_id"), allowMissingColumns=True).withColumn("_state", F.lit(None).cast("binary"))

    def learn(state: State, row: tuple, whole: dict | None, tag: int) -> None:
        if tag == 2:
            state.grow(whole["n"], whole["counts"][:width], list(whole["sums"].values())[:width])
        elif compact:
            state._place(row)
        else:
            state.add(row)

    if chunk:
        sums = told.withColumn("_mine", F.lit(None).cast(asked.schema["_mine"].dataType)).withColumn("_state", F.lit(None).cast("binary"))

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, state = None, State(want)
            for batch in batches:
                for group, c, tag, _, r, _, _, whole in _events(batch):
                    if (group, c) != now:
                        if now:
                            yield _summary([now], [state])
                        now, state = (group, c), State(want)
                    learn(state, r, whole, tag)
            if now:
                yield _summary([now], [state])

        sums = sums.repartition("_g", "_c").sortWithinPartitions("_g", "_c", "_t", "_id").mapInArrow(total, "_g string, _c long, _state binary")
        marks = asked.select("_g", "_c").distinct().withColumn("_state", F.lit(None).cast("binary"))

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The state before each chunk of a group that has rows or targets."""
            now, state, last = None, State(want), None
            for batch in batches:
                out: tuple[list, list] = ([], [])
                for group, c, raw in zip(*(batch.column(x).to_pylist() for x in ("_g", "_c", "_state")), strict=True):
                    if group != now:
                        now, state, last = group, State(want), None
                    if c != last and state.n:
                        out[0].append((group, c))
                        out[1].append(state)
                    last = c
                    if raw:
                        state = state.merge(_load(want, raw))
                if out[0]:
                    yield _summary(*out)

        before = sums.unionByName(marks).repartition("_g").sortWithinPartitions("_g", "_c", F.col("_state").isNotNull()).mapInArrow(fold, "_g string, _c long, _state binary")
        both = both.unionByName(before.withColumn("_tag", F.lit(-1)), allowMissingColumns=True)

    made = names(want)
    out_types = {n: to_arrow_type(t) for n, t in types.items()}

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, State(want)
        for batch in batches:
            keep, rows = [], []
            for i, (group, c, tag, t, r, own_rows, raw, whole) in enumerate(_events(batch)):
                if (group, c) != now:
                    now, state = (group, c), State(want)
                if tag == -1:
                    state = _load(want, raw)
                elif tag > 0:
                    learn(state, r, whole, tag)
                else:
                    seen = [tuple(x["v"].values()) for x in own_rows or () if x["t"] < t]
                    keep.append(i)
                    rows.append(state.features(r[4], seen) or (None,) * len(made))
            if keep:
                cols = [pa.array([r[k] for r in rows], out_types[n]) for k, n in enumerate(made)]
                asked_by = [batch.column(x).take(pa.array(keep)) for x in ("_g", "_t", "_l")]
                yield pa.RecordBatch.from_arrays([*asked_by, *cols], ["_g", "_t", "_l", *made])

    schema = S.StructType([*(S.StructField(x, both.schema[x].dataType) for x in ("_g", "_t", "_l")), *(S.StructField(n, types[n]) for n in made)])
    # A carried state first, then in order of time, targets before what becomes known at the same instant.
    swept = both.repartition("_g", "_c").sortWithinPartitions("_g", "_c", F.col("_tag") != -1, "_t", "_tag", "_id").mapInArrow(answer, schema)
    if chunk:
        swept = staging.stage(swept, "swept")
        # Dealt by instant, so that a long entity's targets are many tasks however they were read.
        shared = alike.select("_g", "_t", "_l").repartition("_g", "_t").join(swept.where(F.col("_l").isNull()).drop("_l"), ["_g", "_t"])
        swept = swept.where(F.col("_l").isNotNull()).unionByName(shared)
    return swept.select("_l.*", *made)


def _summary(groups: list[tuple[str, int]], states: list[State]) -> pa.RecordBatch:
    raw = [pickle.dumps((s.rows, s.n, s.counts, s.sums, s.tails)) for s in states]
    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in groups], pa.string()), pa.array([c for _, c in groups], pa.int64()), pa.array(raw, pa.binary())], ["_g", "_c", "_state"])


def _load(want: Wanted, raw: bytes) -> State:
    rows, n, counts, sums, tails = pickle.loads(raw)
    out = State(want, rows, n, counts, tails=tails)
    out.sums = sums
    return out
