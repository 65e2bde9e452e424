"""Periodic runs of words in documents, and documents with every run cut to its first period.

A run of period q and at least 4 q words has a multiple of 3 q among the places at which a
word equals the word q further on.  So a grid of n / 3q places for each period q up to n / 4
- a harmonic sum, about (n / 3) ln n in all - holds a candidate of every run; those whose word
does equal the one q further on are extended to both sides by exact extension queries on a
run-length grammar (recompression.py).  No suffix array or per-period scan is built.  What is
found with a multiple of its least period has the same ends as with that period and is left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .recompression import extensions, grammar

#: Order of a document's words, given its id and their number; None leaves them.
Arrange = Callable[[int | None, int], np.ndarray | None]


@dataclass(frozen=True)
class RunConfig:
    """times: least repeats of the period.  A run also has at least least_words words."""

    times: int = 4
    least_words: int = 6
    chunk_bytes: int = 2_000_000
    candidates: int = 1_000_000


def planted_periods(doc_id: int | None, n: int) -> np.ndarray | None:
    """Makes a tenth of the documents periodic from some word on; a null id plants nothing."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def _grid(counts: np.ndarray, cfg: RunConfig) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period) of all candidates, in blocks of bounded size."""
    most = np.where(counts >= cfg.least_words, counts // cfg.times, 0)
    doc = np.repeat(np.arange(len(counts)), most)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    stride = (cfg.times - 1) * q
    made = (counts[doc] - 1 - q) // stride + 1
    end = np.cumsum(made)
    lo = 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + cfg.candidates, "right")))
        m = made[lo:hi]
        k = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(doc[lo:hi], m), k * np.repeat(stride[lo:hi], m), np.repeat(q[lo:hi], m)
        lo = hi


def find_runs(ids: np.ndarray, first: np.ndarray, cfg: RunConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start and period.

    ids: one integer a word; the words of document d are first[d] to first[d + 1].
    """
    counts = np.diff(first)
    n_docs, used = len(counts), int(ids.max()) + 1 if len(ids) else 0
    origin = first[:-1] + np.arange(n_docs) + 1  # a separator of its own before every document, and one after all
    string = np.empty(len(ids) + n_docs + 1, np.int64)
    string[np.append(first[:-1] + np.arange(n_docs), len(string) - 1)] = used + np.arange(n_docs + 1)
    string[np.arange(len(ids)) + np.repeat(np.arange(n_docs) + 1, counts)] = ids
    levels: list = []
    found = []
    for doc, place, q in _grid(counts, cfg):
        i = place + origin[doc]
        alike = string[i] == string[i + q]
        doc, i, q = doc[alike], i[alike], q[alike]
        # At least (times - 1) q >= 3 places in a row must match, so a neighbour does.
        beside = (string[i + 1] == string[i + q + 1]) | (string[i - 1] == string[i + q - 1]) if cfg.times > 2 else np.ones(len(i), bool)
        doc, i, q = doc[beside], i[beside], q[beside]
        if not len(i):
            continue
        if not levels:
            levels = grammar(string, 2 * n_docs)
        ahead, back = extensions(levels, i, i + q), extensions(levels, i, i + q, forward=False)
        length = ahead + back + q
        good = length >= np.maximum(cfg.least_words, cfg.times * q)
        found.append(np.stack([doc[good], (i - back - origin[doc])[good], length[good], q[good]]))
    rows = np.concatenate(found, axis=1) if found else np.empty((4, 0), np.int64)
    rows = rows[:, np.lexsort(rows[[3, 2, 1, 0]])]
    again = (rows[:3, 1:] == rows[:3, :-1]).all(axis=0)
    rows = rows[:, np.concatenate([[True], ~again])[: rows.shape[1]]]
    doc, start, length, period = rows[:, np.lexsort(rows[[3, 1, 0]])]
    return doc, start, length, period


def periodic_runs(docs: DataFrame, cfg: RunConfig = RunConfig(), id_col: str = "doc_id", text_col: str = "text", arrange: Arrange | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and the collapsed text of every row of docs.

    A run is a stretch of words with least period q and at least max(least_words, times * q)
    words that no neighbouring word extends.  The collapsed text joins by one space the words that
    no run holds after its first q words.  A null, empty or wordless text has no run and an
    empty collapsed text.  Texts are read whole, whatever their length, in memory of some 200
    bytes a word; repeated rows are each treated, other columns are not read whatever their
    names, and an empty table gives an empty result.  arrange may put a document's words in
    another order first.
    """
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.utf8(batch.column(1))
            for a, b in T.chunks(off, cfg.chunk_bytes):
                own = batch.column(0).slice(a, b - a)
                w = T.split_words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                n = len(w.start)
                order = np.arange(n)
                if arrange is not None:
                    for d, (i, k) in enumerate(zip(own.to_pylist(), w.counts.tolist(), strict=True)):
                        new = arrange(i, k)
                        if new is not None:
                            order[w.first[d] : w.first[d + 1]] = w.first[d] + new
                start, end = w.start[order], w.end[order]
                ids = np.unique(T.span_hashes(w.buf, w.start, w.end), return_inverse=True)[1][order]
                doc, at, length, period = find_runs(ids, w.first, cfg)
                marks = np.zeros(n + 1, np.int64)
                np.add.at(marks, w.first[doc] + at + period, 1)
                np.add.at(marks, w.first[doc] + at + length, -1)
                text = T.join_words(w.buf, start, end, w.first, np.cumsum(marks)[:-1] == 0)
                parts = pa.StructArray.from_arrays([pa.array(x) for x in (at, length, period)], ["start", "length", "period"])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))]).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), parts)
                yield pa.RecordBatch.from_arrays([own, pa.array(w.counts.astype(np.int64)), runs, text], ["doc_id", "n_words", "runs", "collapsed"])
        T.release_memory()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def digest(runs: DataFrame) -> DataFrame:
    """One row a document: number of runs, the longest one, and digests of the list and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return runs.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
