"""Approximate nearest neighbours by cross-polytope hashing.

Each table has its own pseudo-rotations: three rounds of random signs and a fast Hadamard
transform.  A unit vector's hash is the signed axis nearest to its rotation, several of
them joined so that buckets grow in number with the vectors.  Every vector is in every
table; a query probes the buckets of its best axes.  The probed part of the buckets falls
with n^0.35 for n vectors, so a query sees about n^0.65 of them.

What travels to the tables is a vector's copy in bytes with the length of its rounding
error.  By the triangle inequality that bounds its distance from a query on both sides, so
a task may leave out what k others surely beat, and nothing else.  The vectors of what is
left, a few more than k a query, are fetched once and ranked by exact distance.

A table's buckets are dealt by ranges of about ``block_rows`` vectors; a range that a hot
bucket makes larger is dealt into blocks.  A query that finds fewer than k candidates is
compared with all rows, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


@dataclass(frozen=True)
class CrossPolytopeConfig:
    """share: part of the buckets that a query probes, over all tables, among share_at vectors."""

    tables: int = 12
    share: float = 0.3
    share_at: int = 2000
    k: int = 10
    block_rows: int = 65536
    seed: int = 7


@dataclass(frozen=True)
class Plan:
    """What follows from the number of vectors and their length.

    parts: axes of each joined hash; a rotation's last ones are left out of the last.
    """

    parts: tuple[int, ...]
    probes: int
    ranges: int

    @property
    def buckets(self) -> int:
        return math.prod(self.parts)


def plan(n: int, dim: int, cfg: CrossPolytopeConfig) -> Plan:
    """A bucket for every four vectors, or, of few vectors, eight for each up to 2^14."""
    wide = 2 << max(dim - 1, 1).bit_length()
    want = max(n / 4, min(8 * n, 1 << 14), 2)
    parts: list[int] = []
    while not parts or math.prod(parts) < want:
        parts.append(wide)
    rest = math.prod(parts[:-1])
    parts[-1] = min(wide, 2 * math.ceil(want / rest / 2))
    share = min(1.0, cfg.share * (cfg.share_at / max(n, 1)) ** 0.35)
    probes = math.ceil(share * math.prod(parts) / cfg.tables)
    return Plan(tuple(parts), probes, math.ceil(max(n, 1) / cfg.block_rows))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def axes(vectors: np.ndarray, cfg: CrossPolytopeConfig, table: int, part: int, most: int) -> np.ndarray:
    """Closeness of each vector's rotation to the first signed axes."""
    d = vectors.shape[1]
    wide = 1 << max(d - 1, 1).bit_length()
    x = np.zeros((len(vectors), wide))
    x[:, :d] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = np.random.default_rng([cfg.seed, table, part]).choice([-1.0, 1.0], (3, wide))
    for s in signs:
        x = hadamard(x * s)
    x = x[:, : most // 2]
    return np.concatenate([x, -x], 1)


def codes(vectors: np.ndarray, cfg: CrossPolytopeConfig, p: Plan, table: int) -> np.ndarray:
    """The bucket of each vector in a table."""
    out = np.zeros(len(vectors), np.int64)
    for part, most in enumerate(p.parts):
        out = out * most + axes(vectors, cfg, table, part, most).argmax(1)
    return out


#: Memory for the lists of probed buckets of one batch, and for the sums they are chosen from.
PROBE_BYTES = 64_000_000


@lru_cache(8)
def _near_pairs(m: int, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of two falling lists of m and n whose sum can be among the `most` greatest.

    (i + 1) * (j + 1) - 1 other sums are as great, so about most * ln(most) pairs are left of m * n.
    """
    length = np.minimum(m, most // np.arange(1, min(n, most) + 1))
    return np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length), np.repeat(np.arange(len(length)), length)


def probed(vectors: np.ndarray, cfg: CrossPolytopeConfig, p: Plan, table: int) -> np.ndarray:
    """The ``probes`` buckets of each vector in a table whose axes are closest together."""
    code, score = np.zeros((len(vectors), 1), np.int64), np.zeros((len(vectors), 1))
    for part, most in enumerate(p.parts):
        a = axes(vectors, cfg, table, part, most)
        order = np.argsort(-a, axis=1, kind="stable")
        a = np.take_along_axis(a, order, 1)
        # what is not among the best of the first parts is not among the best of all
        i, j = _near_pairs(score.shape[1], most, p.probes)
        keep, step = min(len(i), p.probes), max(1, PROBE_BYTES // (24 * len(i)))
        codes_, scores_ = np.empty((len(a), keep), np.int64), np.empty((len(a), keep))
        for lo in range(0, len(a), step):
            rows = slice(lo, lo + step)
            total = score[rows][:, i] + a[rows][:, j]
            best = np.argpartition(-total, keep - 1, axis=1)[:, :keep] if keep < len(i) else np.broadcast_to(np.arange(keep), total.shape)
            total = np.take_along_axis(total, best, 1)
            fall = np.argsort(-total, axis=1, kind="stable")
            best, scores_[rows] = np.take_along_axis(best, fall, 1), np.take_along_axis(total, fall, 1)
            codes_[rows] = np.take_along_axis(code[rows], i[best], 1) * most + np.take_along_axis(order[rows], j[best], 1)
        code, score = codes_, scores_
    return code


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1) if data else np.empty((0, 1), kind)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, dim, vec) of the vectors that take part: finite, not zero, with an id; vec holds doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            offsets = vectors.offsets.to_numpy()
            flat = vectors.values.cast(pa.float64())
            x = np.nan_to_num(flat.to_numpy(zero_copy_only=False), nan=np.inf)
            # null components read as not finite
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            some = np.concatenate([[0], np.cumsum(x != 0)])
            a, b = offsets[:-1], offsets[1:]
            fine = (bad[b] == bad[a]) & (some[b] > some[a]) & vectors.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(fine)
            raw = pa.array([x[a[i] : b[i]].tobytes() for i in at], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array((b - a)[at].astype(np.int32)), raw], ["vec_id", "dim", "vec"])

    source = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return source.mapInArrow(run, "vec_id long, dim int, vec binary")


def _bytes(x: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Vectors in signed bytes, their steps, and the lengths of what rounding took."""
    step = np.abs(x).max(1) / 127
    q = np.rint(x / step[:, None]).astype(np.int8)
    away = np.linalg.norm(x - q * step[:, None], axis=1) + 1e-9 * np.abs(x).max(1)
    return [r.tobytes() for r in q], step, away


_SKETCH = "vec_id long, ask long, codes array<long>, vec binary, step double, away double"


def _sketch(cfg: CrossPolytopeConfig, p: Plan, query: bool):
    """Bytes and codes of each vector: tables * buckets lie behind one another."""
    many = min(256, max(1, PROBE_BYTES // (8 * cfg.tables * p.probes))) if query else 2048

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, many):
                part = batch.slice(i, many)
                x = _matrix(part.column(2))
                code = np.concatenate([(probed if query else lambda *a: codes(*a)[:, None])(x, cfg, p, t) + t * p.buckets for t in range(cfg.tables)], 1)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * code.shape[1]), pa.array(code.ravel()))
                packed, step, away = _bytes(x)
                ask = part.column(1) if query else pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), ask, listed, pa.array(packed, pa.binary()), pa.array(step), pa.array(away)], ["vec_id", "ask", "codes", "vec", "step", "away"])

    return run


_FOUND = "query_id long, ask long, vec_id long, low double, high double"


def _reach(ids: np.ndarray, high: np.ndarray, k: int) -> float:
    """A distance within which k different ids lie for certain."""
    if len(ids) < k:
        return np.inf
    if len(np.unique(ids)) == len(ids):
        return np.partition(high, k - 1)[k - 1]
    order = np.argsort(high, kind="stable")
    first = np.sort(np.unique(ids[order], return_index=True)[1])
    return high[order][first[k - 1]] if len(first) >= k else np.inf


def _match(k: int):
    """What may be among each query's k nearest of one block; rows without ask are candidates."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asked = table.column("ask").is_valid()
        here, there = table.filter(asked), table.filter(pa.compute.invert(asked))
        out: list[tuple[np.ndarray, ...]] = []
        if here.num_rows and there.num_rows:
            code = np.array(there.column("codes").combine_chunks().flatten())
            order = np.argsort(code, kind="stable")
            code, ids = code[order], there.column("vec_id").to_numpy()[order]
            away = there.column("away").to_numpy()[order]
            x = _matrix(there.column("vec"), np.int8)[order] * there.column("step").to_numpy()[order, None]
            ask, query = here.column("ask").to_numpy(), here.column("vec_id").to_numpy()
            y, gone = _matrix(here.column("vec"), np.int8) * here.column("step").to_numpy()[:, None], here.column("away").to_numpy()
            for i, probes in enumerate(here.column("codes").to_pylist()):
                lo, hi = np.searchsorted(code, probes, "left"), np.searchsorted(code, probes, "right")
                wide = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(wide)[:-1]]), wide) + np.arange(wide.sum())
                at = at[ids[at] != query[i]]
                if not len(at):
                    continue
                d = np.sqrt(((x[at] - y[i]) ** 2).sum(1))
                slack = (away[at] + gone[i]) * (1 + 1e-9)
                high = d + slack
                keep = d - slack <= _reach(ids[at], high, k)
                out.append((np.full(keep.sum(), query[i]), np.full(keep.sum(), ask[i]), ids[at][keep], (d - slack)[keep], high[keep]))
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        columns = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
        return pa.Table.from_arrays(columns, ["query_id", "ask", "vec_id", "low", "high"])

    return run


def _meet(rows: DataFrame, asks: DataFrame, cfg: CrossPolytopeConfig) -> DataFrame:
    """Possible neighbours from every block of every range; both sides are sketches with a key."""
    # a row for each range: tables times the vectors by block_rows
    blocks = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(2.0 * cfg.block_rows)).cast("int").alias("n"))
    told = ["key", "block", "vec_id", "ask", "codes", "vec", "step", "away"]
    left = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int")).select(told)
    right = asks.join(blocks, "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(told)
    return left.unionByName(right).groupBy("key", "block").applyInArrow(_match(cfg.k), _FOUND)


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = np.sqrt(((_matrix(batch.column(2)) - _matrix(batch.column(3))) ** 2).sum(1)) if batch.num_rows else np.empty(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], ["query_id", "vec_id", "score"])


def candidates(rows: DataFrame, asks: DataFrame, n: int, dim: int, cfg: CrossPolytopeConfig, scratch: Scratch) -> DataFrame:
    """(query_id, ask, vec_id) of what can be among the k nearest of what the buckets hold, or of all rows where that is too little."""
    p = plan(n, dim, cfg)
    index = scratch.table(rows.select("vec_id", F.lit(None).cast("long").alias("ask"), "vec").mapInArrow(_sketch(cfg, p, False), _SKETCH), "index")
    probes = scratch.table(asks.select("vec_id", "ask", "vec").mapInArrow(_sketch(cfg, p, True), _SKETCH), "probes")
    # a range of one table's buckets holds about block_rows vectors
    key = lambda c: F.floor(c / F.lit(p.buckets / p.ranges)).cast("long")
    spread = index.withColumn("code", F.explode("codes")).withColumn("key", key(F.col("code"))).withColumn("codes", F.array("code"))
    parted = F.explode(F.array_distinct(F.transform("codes", key)))
    own = F.filter("codes", lambda c: key(c) == F.col("key"))
    found = _meet(spread, probes.withColumn("key", parted).withColumn("codes", own), cfg)

    def best(found: DataFrame) -> DataFrame:
        """Each pair once, without what k others surely beat; n_found counts all pairs of a query."""
        by = Window.partitionBy("query_id", "ask")
        pairs = found.repartition("query_id", "ask").groupBy("query_id", "ask", "vec_id").agg(F.min("low").alias("low"), F.min("high").alias("high"))
        pairs = pairs.withColumn("_n", F.row_number().over(by.orderBy("high", "vec_id")))
        reach = F.coalesce(F.max(F.when(F.col("_n") == cfg.k, F.col("high"))).over(by), F.lit(float("inf")))
        pairs = pairs.withColumns({"_reach": reach, "n_found": F.count(F.lit(1)).over(by)})
        return pairs.where("low <= _reach").select("query_id", "ask", "vec_id", "n_found")

    found = scratch.table(best(found), "found")
    enough = found.where(F.col("n_found") >= cfg.k).select(F.col("query_id").alias("vec_id"), "ask").distinct()
    short = scratch.table(asks.join(enough, ["vec_id", "ask"], "left_anti"), "short")
    if not short.isEmpty():
        # all rows, in blocks, is the exact way
        whole = lambda d: d.withColumn("codes", F.array(F.lit(0).cast("long"))).withColumn("key", F.lit(0).cast("long"))
        every = _meet(whole(index), whole(probes.join(short.select("vec_id", "ask"), ["vec_id", "ask"], "left_semi")), cfg)
        found = found.where(F.col("n_found") >= cfg.k).unionByName(best(every))
    return found.drop("n_found")


def nearest(df: DataFrame, is_query: Column, cfg: CrossPolytopeConfig = CrossPolytopeConfig(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's nearest rows, by Euclidean distance.

    is_query: a condition on ``vec_id``.  Ties go to the smaller vec_id.  Vectors that are
    null, empty, zero or hold null or non-finite components, rows without an id, and
    vectors of another length than most have take no part.  Rows of one id count once, by
    the nearest of them; a query never finds its own id.  An empty table, or one without
    queries, gives an empty result; other columns of df are not read.
    """
    scratch = Scratch(df.sparkSession, "ann")
    rows = usable(df, id_col, vec_col)
    # as many rows as there are lengths
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).head()
    dim, n = (dims["dim"], dims["count"]) if dims else (1, 0)
    rows = rows.where(F.col("dim") == dim).select("vec_id", "vec")
    asks = scratch.table(rows.where(is_query).dropDuplicates(["vec_id", "vec"]).select("vec_id", F.xxhash64("vec").alias("ask"), "vec"), "asks")
    pairs = scratch.table(candidates(rows, asks, n, dim, cfg, scratch), "pairs")
    both = pairs.join(rows, "vec_id").join(asks.select(F.col("vec_id").alias("query_id"), "ask", F.col("vec").alias("own")), ["query_id", "ask"])
    scored = both.select("query_id", "vec_id", "vec", "own").mapInArrow(_distances, "query_id long, vec_id long, score double")
    found = scored.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")
