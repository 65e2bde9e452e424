"""Importance resampling of documents towards the word distribution of a target text set.

Hashed n-grams of both sides are counted into arrays of ``buckets`` entries; a bucket's gain
is a smoothed log ratio in thousandths, a document's weight the sum of the gains over its
features, and its score that weight plus Gumbel noise from a hash of its id, so that taking
the highest scores is a draw without replacement in proportion to exp(weight / 1000).

The draw needs exact ranks, which come from parallel sorting by regular sampling: every task
sorts its run of eligible rows and every ``step``-th row of a run is a sample; samples give
splitters at regular ranks, so that no segment between two splitters holds more rows than its
share and ``step`` rows a run; rows are exchanged by segment and each segment's runs are merged
where they meet; counts of the segments before it turn a place in a segment into a rank.
Segments that begin beyond the last drawn rank are counted but never exchanged.

What reaches the driver are the bucket counts, the samples (at most 100 / percent * segments *
32 and one a run) and the counts of at most ``most_segments`` segments.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .scratch import Scratch

#: Samples for every segment; more of them make segments more alike.
OVERSAMPLE = 32
_RUN = 33  # monotonically_increasing_id: partition number above, row number in the partition below


@dataclass(frozen=True)
class ResampleConfig:
    """ngrams: features are runs of 1 to so many words.  percent: of the documents with at least least_words words."""

    ngrams: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024
    segment_rows: int = 250_000
    least_segments: int = 16
    most_segments: int = 4_096
    chunk_bytes: int = 4_000_000


def _crc_table() -> np.ndarray:
    """The byte table of the reflected CRC-32 polynomial 0xEDB88320."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_TABLE = _crc_table()
#: Bytes that a word of this operator may hold, after A-Z are lowered.
_WORD = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])


def crc_extend(state: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Running CRC-32 states after one byte span each; begin with 0xFFFFFFFF and invert the last."""
    out = state.copy()
    live, pos, stop = np.arange(len(start)), start, end
    more = pos < stop
    while more.any():
        live, pos, stop = live[more], pos[more], stop[more]
        out[live] = _TABLE[(out[live] ^ buf[pos]) & 0xFF] ^ (out[live] >> np.uint32(8))
        pos = pos + 1
        more = pos < stop
    return out


def _features(buf: np.ndarray, offsets: np.ndarray, cfg: ResampleConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its document, words by document)."""
    low = T.lower_ascii(buf)
    w = T.split_spans(low, offsets, _WORD[low])
    n = len(w.start)
    doc = np.repeat(np.arange(w.n_docs), w.counts)
    left = np.repeat(w.first[1:], w.counts) - np.arange(n)
    state, at = crc_extend(np.full(n, 0xFFFFFFFF, np.uint32), low, w.start, w.end), np.arange(n)
    buckets, docs = [(~state) % np.uint32(cfg.buckets)], [doc]
    for k in range(1, cfg.ngrams):
        fits = left[at] > k
        at, state = at[fits], state[fits]
        state = _TABLE[(state ^ np.uint32(32)) & 0xFF] ^ (state >> np.uint32(8))
        state = crc_extend(state, low, w.start[at + k], w.end[at + k])
        buckets.append((~state) % np.uint32(cfg.buckets))
        docs.append(doc[at])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(docs), w.counts


def bucket_counts(texts: DataFrame, text_col: str, cfg: ResampleConfig) -> np.ndarray:
    """How many features of all texts fall in each bucket: one array a task, added up by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cfg.buckets, np.int64)
        for batch in batches:
            buf, off = T.utf8(batch.column(0))
            for a, b in T.chunks(off, cfg.chunk_bytes):
                total += np.bincount(_features(buf[off[a] : off[b]], off[a : b + 1] - off[a], cfg)[0], minlength=cfg.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(cfg.buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares) by bucket."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + n) / ((int(a) + 1) * (t + n)))) for a, b in zip(source, target, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor of Gumbel noise in thousandths, from a hash of the id; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, cfg: ResampleConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.utf8(batch.column(1))
            for a, b in T.chunks(off, cfg.chunk_bytes):
                bucket, doc, words = _features(buf[off[a] : off[b]], off[a : b + 1] - off[a], cfg)
                ids = batch.column(0).slice(a, b - a)
                n = np.bincount(doc, minlength=b - a)
                total = np.zeros(b - a, np.int64)
                np.add.at(total, doc, gain[bucket])
                extra = np.array([noise(i, cfg.seed) for i in ids.to_pylist()], np.int64)
                cols = [ids, *(pa.array(x.astype(np.int64)) for x in (words, n, total, total + extra))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def _before(score: np.ndarray, doc_id: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Sort keys for numpy's lexsort: highest score, least id, most features first."""
    return [-n, doc_id, -score]


def splitters(samples: list[tuple[int, int, int, int]], step: int, drawn: int, segments: int) -> np.ndarray:
    """Up to `segments` splitters (score, id, features) at regular ranks.

    samples: score, id, features, run.  A sample closes `step` rows of its run, so with s
    samples up to one, at least s * step rows are up to it; the last splitter is the first
    sample with at least `drawn` rows up to it, so nothing beyond it is drawn.
    """
    a = np.array(sorted(samples, key=lambda r: (-r[0], r[1], -r[2])), np.int64).reshape(-1, 4)[:, :3]
    surely = (np.arange(len(a)) + 1) * step
    last = int(np.searchsorted(surely, drawn))
    if last >= len(a):  # the rest of the runs is needed too: one segment more, open at its end
        last = len(a) - 1
    every = max(1, -(-(last + 1) // segments))
    return a[sorted({*range(every - 1, last + 1, every), last})] if len(a) else a


def resample(docs: DataFrame, target: DataFrame, cfg: ResampleConfig = ResampleConfig(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs; undrawn rows have a null rank.

    Ties in the score go to the smaller id, then to more features, null ids first; rows alike
    in all of them are interchangeable.  A null, empty or wordless text has no feature, weight 0 and
    is not eligible.  Texts of any length are read whole, repeated rows are drawn each by
    itself, other columns are not read whatever their names; an empty docs gives an empty
    result, and with an empty target all gains follow from the smoothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resample")
    gain = gains(bucket_counts(docs, text_col, cfg), bucket_counts(target, target_col, cfg))
    scored = scratch.table(score(docs, gain, cfg, id_col, text_col), "scored")
    eligible = scored.where(F.col("n_words") >= cfg.least_words)
    drawn = cfg.percent * eligible.count() // 100
    unranked = scored.withColumn("rank", F.lit(None).cast("long"))
    if not drawn:
        return unranked
    order = [F.desc("score"), F.asc("doc_id"), F.desc("n_features")]
    segments = int(min(max(cfg.least_segments, -(-drawn // cfg.segment_rows)), cfg.most_segments))
    step = max(1, drawn // (segments * OVERSAMPLE))
    runs = scratch.table(eligible.sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "runs")
    at = F.col("place").bitwiseAND((1 << _RUN) - 1)
    low = -(1 << 63)
    samples = runs.where(at % step == step - 1).select("score", F.coalesce("doc_id", F.lit(low)), "n_features", F.shiftright("place", _RUN)).collect()
    cut = splitters([tuple(r) for r in samples], step, drawn, segments)

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(low).to_numpy(zero_copy_only=False)
            n, s = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            is_row = np.concatenate([np.ones(len(ids), np.int8), np.zeros(len(cut), np.int8)])
            keys = _before(np.concatenate([s, cut[:, 0]]), np.concatenate([ids, cut[:, 1]]), np.concatenate([n, cut[:, 2]]))
            merged = np.lexsort([1 - is_row, *keys])  # a row equal to a splitter lies before it
            before = np.cumsum(is_row[merged] == 0)
            segment = np.empty(len(merged), np.int64)
            segment[merged] = before
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(segment[: len(ids)])], [*batch.schema.names[:5], "segment"])

    divided = scratch.table(runs.drop("place").mapInArrow(divide, "doc_id long, n_words long, n_features long, weight long, score long, segment long"), "segments")
    sizes = np.zeros(len(cut) + 1, np.int64)
    for r in divided.groupBy("segment").count().collect():
        sizes[r["segment"]] = r["count"]
    begin = np.cumsum(sizes) - sizes
    reached = int(np.searchsorted(begin, drawn))  # segments that begin before the last drawn rank
    starts = F.broadcast(spark.createDataFrame([(i, int(begin[i])) for i in range(reached)], "segment long, begin long"))
    merged = Window.partitionBy("segment").orderBy(*order)
    place = F.col("begin") + F.row_number().over(merged)
    ranked = divided.where(F.col("segment") < reached).join(starts, "segment").withColumn("place", place)
    ranked = ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    rest = divided.where(F.col("segment") >= reached).drop("segment").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).unionByName(unranked.where(F.col("n_words") < cfg.least_words))
