"""Near-duplicate detection: MinHash banding with sequential Bayesian verification.

Method.  Each document becomes the set of its distinct word shingles.  Documents with
equal sets are one vertex from the start.  Vertices that agree in all rows of a MinHash
band meet in a bucket; every bucket compares its members first with one centre, and then,
only where members are still in different components, all remaining cross-component pairs
in blocks.  A candidate's signature is compared batch by batch on hash functions that the
bands do not use; after each batch the pair is given up if the posterior probability of
``similarity >= threshold`` (uniform prior) is below ``miss``.  Survivors are verified
exactly on their full sets, so a reported link is always a true one.

No pair inside an equal-set group is made, no all-pairs list leaves a task, and buckets
have no cap: block comparison covers whatever the centres leave.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .components import connected_components
from .scratch import Scratch


@dataclass(frozen=True)
class NearConfig:
    """width: words of a shingle.  percent: the link threshold, in whole hundredths.

    broadcast_rows: rows to remove, of two numbers each, up to which near_dedup filters
    without a shuffle of the texts; beyond it the filter is a join by key.
    """

    width: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    check_hashes: int = 64
    batch: int = 16
    miss: float = 1e-5
    block_shingles: int = 1_000_000
    chunk_bytes: int = 1_500_000
    broadcast_rows: int = 2_000_000


@lru_cache(maxsize=8)
def _multipliers(n: int, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


@lru_cache(maxsize=8)
def least_matches(cfg: NearConfig) -> tuple[tuple[int, int], ...]:
    """(hashes compared, fewest matches that keep a pair) after each batch.

    With a uniform prior and m matches of n, the posterior is Beta(m + 1, n - m + 1), and
    P(s >= t) is the chance of at most m successes in n + 1 trials of probability t.
    """
    t, out = cfg.percent / 100, []
    for n in range(cfg.batch, cfg.check_hashes + 1, cfg.batch):
        tail, need = 0.0, n + 1
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= cfg.miss:
                need = m
                break
        out.append((n, need))
    return tuple(out)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    buf, off = T.utf8(column)
    buf = T.lower_ascii(buf)
    words = T.split_words(buf, off)
    hashes, begin = T.windows(T.span_hashes(buf, words.start, words.end), words.first, width, short=True)
    return [np.unique(hashes[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]


def _vertex_ids(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits that stand for a set: two sums of mixed elements, with its size."""
    n = np.array([len(s) for s in sets], np.uint64)
    one = np.array([T.mix64(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    two = np.array([T.mix64(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) for s in sets], np.uint64)
    pair = np.stack([T.mix64(one + n), T.mix64(two ^ (n << np.uint64(17)))], 1)
    return [r.tobytes() for r in pair]


def _signatures(sets: list[np.ndarray], n_hashes: int) -> np.ndarray:
    """MinHash values, 32 bits each; rows of empty sets hold 0."""
    mul, add = _multipliers(n_hashes)
    out = np.zeros((len(sets), n_hashes), np.uint32)
    block: list[int] = []
    size = 0

    def flush() -> None:
        joined = np.concatenate([sets[i] for i in block])
        begin = np.concatenate([[0], np.cumsum([len(sets[i]) for i in block])[:-1]])
        tmp, low = np.empty_like(joined), np.empty((len(block), n_hashes), np.uint64)
        for j in range(n_hashes):
            np.multiply(joined, mul[j], out=tmp)
            tmp += add[j]
            low[:, j] = np.minimum.reduceat(tmp, begin)
        out[block] = (low >> np.uint64(32)).astype(np.uint32)

    for i, s in enumerate(sets):
        if len(s):
            block.append(i)
            size += len(s)
        if size >= 16_384:
            flush()
            block, size = [], 0
    if block:
        flush()
    return out


def _sketch(cfg: NearConfig):
    used = cfg.bands * cfg.rows
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("vid", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary()), ("text_hash", pa.int64()), ("row_key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            _, off = T.utf8(texts)
            for a, b in T.chunks(off, cfg.chunk_bytes):
                sets = shingle_sets(texts.slice(a, b - a), cfg.width)
                sig = _signatures(sets, used + cfg.check_hashes)
                key = np.zeros((b - a, cfg.bands), np.uint64)
                for r in range(cfg.rows):
                    key = T.mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r:used:cfg.rows].astype(np.uint64))
                key = T.mix64(key + np.arange(cfg.bands, dtype=np.uint64)).view(np.int64)
                n = np.array([len(s) for s in sets], np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * cfg.bands), pa.array(key.ravel()))
                check = np.ascontiguousarray(sig[:, used:])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n), pa.array(_vertex_ids(sets), pa.binary()), bands, pa.array([r.tobytes() for r in check], pa.binary()), *(batch.column(k).slice(a, b - a) for k in (2, 3))],
                    schema=schema,
                )
            T.release_memory()

    return run


def _alike(mine: np.ndarray, others: np.ndarray, cfg: NearConfig) -> np.ndarray:
    """Rows of others that the sequential test does not give up against mine."""
    live, hits, done = np.arange(len(others)), np.zeros(len(others), np.int64), 0
    for n, need in least_matches(cfg):
        hits = hits + (others[live, done:n] == (mine[live, done:n] if mine.ndim == 2 else mine[done:n])).sum(1)
        keep = hits >= need
        live, hits, done = live[keep], hits[keep], n
        if not len(live):
            break
    return live


def _sig(column: pa.Array | pd.Series) -> np.ndarray:
    data = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(data), np.uint32).reshape(len(data), -1)


def _prune(cfg: NearConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                live = _alike(_sig(batch.column(2)), _sig(batch.column(3)), cfg)
                yield batch.select(["a", "b"]).take(pa.array(live))

    return run


def _linked(inter: np.ndarray, na: np.ndarray | int, nb: np.ndarray | int, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (na + nb - inter)


def _verify(cfg: NearConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                left, right = shingle_sets(part.column(2), cfg.width), shingle_sets(part.column(3), cfg.width)
                for k, (x, y) in enumerate(zip(left, right, strict=True)):
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    if _linked(inter, len(x), len(y), cfg.percent):
                        keep.append(i + k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _block(cfg: NearConfig):
    """Pairs of components that a link joins, in one block of a bucket.

    Rows with minor are compared with all rows of another component.  A pair that meets
    in an earlier band too is left to that band.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        band = int(pdf["band"].iloc[0])
        sig, comp = _sig(pdf["sig"]), pdf["comp"].to_numpy()
        keys = np.array(pdf["bands"].tolist(), np.int64)
        minor = pdf["minor"].to_numpy()
        sets = shingle_sets(pa.array(pdf["text"], pa.string()), cfg.width)
        size = np.array([len(s) for s in sets])
        joined = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(joined, kind="stable")
        joined, owner = joined[order], owner[order]
        found: set[tuple[bytes, bytes]] = set()
        for a in np.flatnonzero(minor):
            other = np.flatnonzero((comp != comp[a]) & ~((keys[:, :band] == keys[a, :band]).any(1)))
            other = other[_alike(sig[a], sig[other], cfg)] if len(other) else other
            if not len(other):
                continue
            lo, hi = np.searchsorted(joined, sets[a], "left"), np.searchsorted(joined, sets[a], "right")
            wide = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(wide)[:-1]]), wide) + np.arange(wide.sum())
            inter = np.bincount(owner[at], minlength=len(sets))[other]
            hit = other[_linked(inter, size[a], size[other], cfg.percent)]
            found.update((comp[a], c) for c in set(comp[hit]))
        del joined, owner, sets
        T.release_memory()
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype=object)

    return run


def _pairs_with(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with that column of either side."""
    one = table.select(F.col("vid").alias("a"), F.col(column).alias("x"))
    two = table.select(F.col("vid").alias("b"), F.col(column).alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")


def near_components(docs: DataFrame, cfg: NearConfig = NearConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept.

    component_id is the smallest id reachable over links; kept says whether it is the
    row's own.  Texts that are null or hold no word have an empty set and link with
    nothing.  Rows of one id count as one document where their texts agree; where they
    differ each text is a vertex of its own.  A null id never becomes a component_id
    unless its whole component has none; ids compare null-safe, so such a row is kept.
    Texts of any length are read whole.  An empty table gives an empty result, and other
    columns of docs are not read.
    """
    out = _components(docs, cfg, id_col, text_col).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _components(docs: DataFrame, cfg: NearConfig, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, text_hash, component (null without words) and its component_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    # A row is told by its id and two hashes of its text, so rows without an id, or that share one, meet only those of the same text.
    source = source.withColumn("row_key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text_hash", F.xxhash64(F.lit("row"), F.col("text"))))
    schema = "doc_id long, n_shingles long, vid binary, bands array<long>, sig binary, text_hash long, row_key long"
    rows = scratch.table(source.select("doc_id", "text", "text_hash", "row_key").mapInArrow(_sketch(cfg), schema), "rows")

    # One vertex for each distinct set; its copies, whose bands and signatures are equal, only pass their ids on.
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "row_key"))
    reps = rows.where("n_shingles > 0").groupBy("vid").agg(F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n"), one.alias("r"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps = scratch.table(reps.select("vid", "least_id", "n", F.col("r.doc_id").alias("rep_id"), F.col("r.text_hash").alias("rep_hash"), "r.row_key", "bands", "sig"), "reps")
    ids = reps.select("vid", "least_id", "n")

    member = reps.select("vid", F.posexplode("bands").alias("band", "bucket"))
    shared = member.groupBy("bucket").agg(F.min("vid").alias("centre"), F.count(F.lit(1)).alias("m")).where("m > 1")
    member = scratch.table(member.join(shared, "bucket").select("bucket", "band", "vid", "centre", "m"), "members")

    # Text of what has a candidate at all, read once; repeated rows of one id and text count once.
    busy = reps.join(member.select("vid").distinct(), "vid", "left_semi").select("row_key", "vid", "rep_id", "rep_hash", "bands", "sig")
    text = busy.join(source, "row_key").where(F.col("rep_id").eqNullSafe(F.col("doc_id")) & (F.col("rep_hash") == F.col("text_hash")))
    busy = scratch.table(text.dropDuplicates(["row_key", "vid"]).select("vid", "bands", "sig", "text"), "texts")

    # Every member of a bucket against its centre.
    star = member.where("vid <> centre").select(F.col("centre").alias("a"), F.col("vid").alias("b")).distinct()
    alive = scratch.table(_pairs_with(star, busy, "sig").mapInArrow(_prune(cfg), "a binary, b binary"), "alive")
    links = scratch.table(_pairs_with(alive, busy, "text").mapInArrow(_verify(cfg), "a binary, b binary"), "links")
    labels = connected_components(links, scratch)

    # What is left: members of one bucket, other than its centre, in different components.
    known = labels.select("v", F.col("label").alias("known"))
    member = member.where("vid <> centre and m > 2").join(known, F.col("vid") == F.col("v"), "left").select("bucket", "band", "vid", F.coalesce("known", "vid").alias("comp"))
    mixed = member.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    member = scratch.table(member.join(mixed, "bucket", "left_semi").join(ids.select("vid", "n"), "vid"), "mixed")
    if not member.isEmpty():
        more = scratch.table(_blocks(member, busy, cfg), "links")
        if not more.isEmpty():
            over = connected_components(more, scratch).select(F.col("v").alias("comp"), F.col("label").alias("top"))
            known = labels.select("v", "label").unionByName(over.select(F.col("comp").alias("v"), F.col("comp").alias("label"))).distinct()
            labels = known.join(over, F.col("label") == F.col("comp"), "left").select("v", F.coalesce("top", "label").alias("label"))
            labels = scratch.table(labels.groupBy("v").agg(F.min("label").alias("label")), "labels")

    # A component's smallest id, and from there back to the rows.
    named = ids.join(labels, F.col("vid") == F.col("v"), "left").select("vid", "least_id", "label")
    smallest = named.where("label is not null").groupBy("label").agg(F.min("least_id").alias("smallest"))
    named = named.join(smallest, "label", "left").select("vid", F.coalesce("label", "vid").alias("component"), F.coalesce("smallest", "least_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "text_hash", "vid").join(named, "vid", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "text_hash", "component", component.alias("component_id"))


def _parts(total: Column, most: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / F.lit(float(most)))).cast("int")


def _blocks(member: DataFrame, busy: DataFrame, cfg: NearConfig) -> DataFrame:
    """Pairs of components linked by comparing each bucket's minor components with all its members.

    Both sides are dealt into chunks of about block_shingles shingles; one task handles a
    chunk of minors against a chunk of members, whatever the size of the bucket.
    """
    sizes = member.groupBy("bucket", "comp").agg(F.sum("n").alias("s"))
    whole = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("s", "comp")).alias("main"), F.sum("s").alias("all"), F.max("s").alias("most"))
    whole = whole.select("bucket", "main", _parts(F.col("all") - F.col("most"), cfg.block_shingles).alias("ni"), _parts(F.col("all"), cfg.block_shingles).alias("nj"))
    side = member.join(whole, "bucket").withColumn("minor", F.col("comp") != F.col("main"))
    chunk = lambda k: F.pmod(F.xxhash64("vid"), F.col(k)).cast("int")
    every = side.withColumn("j", chunk("nj")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).withColumn("minor", F.lit(False))
    few = side.where("minor").withColumn("i", chunk("ni")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1)))
    both = few.unionByName(every.select(few.columns)).groupBy("bucket", "band", "i", "j", "vid").agg(F.first("comp").alias("comp"), F.max("minor").alias("minor"))
    both = both.join(busy, "vid").select("bucket", "i", "j", "band", "vid", "comp", "minor", "bands", "sig", "text")
    return both.groupBy("bucket", "i", "j").applyInPandas(_block(cfg), "a binary, b binary")


def near_dedup(docs: DataFrame, cfg: NearConfig = NearConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest id; columns as they were.

    Rows are told apart by id and text, so rows that share an id, or have none, but differ
    in text are judged each by its own.  Of rows that agree in both one stays, but rows
    with neither an id nor a word all do.  Texts are read whole, whatever their length; an empty table gives
    an empty result, and other columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "near-kept")
    key = ["doc_id", "text_hash"]
    marked = scratch.table(_components(docs, cfg, id_col, text_col))
    counted = scratch.table(marked.groupBy("component", *key).agg(F.count(F.lit(1)).alias("n")), "keys")
    order = F.struct(F.col("doc_id").isNull(), *key)
    won = counted.where("component is not null").groupBy("component").agg(F.min_by("doc_id", order).alias("won_id"), F.min_by("text_hash", order).alias("won_hash"), F.count(F.lit(1)).alias("keys"))
    both = counted.join(won.where("keys > 1"), "component")
    # written, so that its size is known when the join is planned
    gone = scratch.table(both.where(~(F.col("doc_id").eqNullSafe(F.col("won_id")) & (F.col("text_hash") == F.col("won_hash")))).select(*key), "gone")
    again = scratch.table(counted.where("n > 1 and (component is not null or doc_id is not null)").select(*key), "again")
    # columns travel as one struct, so none clashes with the operator's own
    here = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_near_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_near_hash"))
    same = F.col("_near_id").eqNullSafe(F.col("doc_key")) & (F.col("_near_hash") == F.col("hash_key"))
    sized = lambda d: F.broadcast(d) if d.count() <= cfg.broadcast_rows else d
    out = here.join(sized(gone.toDF("doc_key", "hash_key")), same, "left_anti")
    if not again.isEmpty():
        again = sized(again.toDF("doc_key", "hash_key"))
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["_near_id", "_near_hash"]))
    return out.select("_row.*")
