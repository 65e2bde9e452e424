"""A quality classifier: hashed word n-grams, logistic regression, FTRL updates.

Features of a text are hashed uni- and bigrams of two views of its words: the lower-cased
word without what surrounds its letters, and the word's shape (case, what follows its last
letter, length class).  Each view's n-grams share one unit of mass, so a text's vector is
linear in its windows and a score is a sparse dot product over the batch.

Learning takes a bounded sample of labelled documents.  ``trainers`` tasks each run
follow-the-regularised-leader passes over their part, and their weights are averaged; what
reaches the driver are the non-zero weights, at most 2^bits of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .filtering import keep_rows
from .folds import held_out, thinned


@dataclass(frozen=True)
class QualityConfig:
    """sample_docs: most documents, about, of each label to learn from."""

    bits: int = 18
    sample_docs: int = 4000
    trainers: int = 4
    passes: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.0005
    l2: float = 0.0005
    scale: float = 4.0
    seed: int = 11
    threshold: float = 0.7
    chunk_bytes: int = 1_500_000


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float


def _views(buf: np.ndarray, w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bare words and of their shapes."""
    upper = (buf >= 65) & (buf <= 90)
    # capitals of the Latin-1 block: C3 80 to C3 9E
    lead = np.zeros(len(buf), bool)
    lead[:-1] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    low = T.lower_ascii(buf)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    at = np.arange(len(buf))
    first = np.minimum.reduceat(np.where(letter, at, len(buf)), w.start) if len(w.start) else w.start
    # reduceat runs to the next word's start; separators are no letters, so only letters count
    last = np.maximum.reduceat(np.where(letter, at + 1, 0), w.start) if len(w.start) else w.start
    none = (first >= w.end) | (last <= w.start)
    first, last = np.where(none, w.start, np.minimum(first, w.end)), np.where(none, w.end, np.minimum(last, w.end))
    bare = T.span_hashes(low, first, last, 1)
    caps = np.concatenate([[0], np.cumsum(upper | lead)])
    letters = np.concatenate([[0], np.cumsum(letter & ((buf & 0xC0) != 0x80))])
    n_caps, n_letters = caps[w.end] - caps[w.start], letters[w.end] - letters[w.start]
    case = np.where(n_letters == 0, 0, np.where(n_caps == 0, 1, np.where((n_caps == n_letters) & (n_letters > 1), 3, 2)))
    size = np.minimum(n_letters, 12) // 3
    tail = T.span_hashes(buf, np.where(none, w.start, last), w.end, 2)
    shape = T.mix64(tail * np.uint64(31) + (case * 8 + size).astype(np.uint64))
    return bare, shape


def _windows(buf: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature of each window, where each document's windows begin), by view and length."""
    w = T.split_words(buf, offsets)
    out = []
    for k, view in enumerate(_views(buf, w)):
        for n in (1, 2):
            hashes, begin = T.windows(view, w.first, n)
            out.append(((T.mix64(hashes + np.uint64(97 * k + n)) >> np.uint64(64 - bits)).astype(np.int64), begin))
    return out


def scores(buf: np.ndarray, offsets: np.ndarray, model: QualityModel, cfg: QualityConfig) -> np.ndarray:
    """Probability of label 1 for each document."""
    total = np.full(len(offsets) - 1, model.bias)
    for feature, begin in _windows(buf, offsets, cfg.bits):
        total += cfg.scale * T.segment_sum(model.weights[feature].astype(np.float64), begin) / np.maximum(np.diff(begin), 1)
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _vectors(texts: pd.Series, cfg: QualityConfig) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse vectors, the bias as the last feature."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    buf, off = T.utf8(pa.array(texts, pa.string()))
    for a, b in T.chunks(off, cfg.chunk_bytes):
        views = _windows(buf[off[a] : off[b]], off[a : b + 1] - off[a], cfg.bits)
        for d in range(b - a):
            parts = [(f[s[d] : s[d + 1]], cfg.scale / max(s[d + 1] - s[d], 1)) for f, s in views]
            index = np.concatenate([p for p, _ in parts] + [[1 << cfg.bits]])
            mass = np.concatenate([np.full(len(p), v) for p, v in parts] + [[1.0]])
            index, back = np.unique(index, return_inverse=True)
            out.append((index, np.bincount(back, mass)))
    return out


def ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cfg: QualityConfig) -> np.ndarray:
    """Weights after the passes; the last one is the bias."""
    z, n = np.zeros((1 << cfg.bits) + 1), np.zeros((1 << cfg.bits) + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        own = -(zi - np.sign(zi) * cfg.l1) / ((cfg.beta + np.sqrt(n[i])) / cfg.alpha + cfg.l2)
        return np.where(np.abs(zi) <= cfg.l1, 0.0, own)

    order = np.random.default_rng(cfg.seed)
    # each label counts alike, however many documents carry it
    ones = max(int(labels.sum()), 1)
    cost = np.where(labels == 1, len(labels) / (2 * ones), len(labels) / (2 * max(len(labels) - ones, 1)))
    for _ in range(cfg.passes):
        for k in order.permutation(len(vectors)):
            i, x = vectors[k]
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -40, 40)))
            g = (p - labels[k]) * x * cost[k]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / cfg.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weight(np.arange(len(z)))


def fit_quality(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """A model of labels that are not held out; without any, one that scores 0.5.

    Null ids, labels and labels other than 0 and 1 are left out; an id with both labels
    counts as 0; a null text is empty.  Of rows that share an id one text is learned from,
    that of the least hash, so the sample is bounded by rows.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"))
    size = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    share = F.when(F.col("_y") == 1, min(1.0, cfg.sample_docs / size.get(1, 1))).otherwise(min(1.0, cfg.sample_docs / size.get(0, 1)))
    known = F.broadcast(known.where(thinned(F.col("_id"), share)))  # about 2 * sample_docs ids
    sample = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(known, F.col("_doc") == F.col("_id"))
    sample = sample.groupBy("_id", "_y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    sample = sample.select("_id", "text", "_y", F.pmod(F.xxhash64("_id"), F.lit(cfg.trainers)).alias("_part"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", "_y", "text"])
        w = ftrl(_vectors(pdf["text"], cfg), pdf["_y"].to_numpy(), cfg)
        at = np.flatnonzero(w)
        return pd.DataFrame({"feature": np.append(at, -1), "w": np.append(w[at], 1.0) * len(pdf)})

    # Trainers count by their rows, and those without any do not count; feature -1 tells all rows.
    # What is collected is bounded by the sample: about 2 * sample_docs documents over all trainers.
    parts = sample.groupBy("_part").applyInPandas(train, "feature long, w double").groupBy("feature").agg(F.sum("w").alias("w")).toArrow()
    weights = np.zeros((1 << cfg.bits) + 1)
    at, w = parts["feature"].to_numpy(), parts["w"].to_numpy()
    if len(at):
        weights[at[at >= 0]] = w[at >= 0] / w[at < 0]
    return QualityModel(weights[:-1].astype(np.float32), float(weights[-1]))


def _score_column(column: pa.Array, model: QualityModel, cfg: QualityConfig) -> np.ndarray:
    buf, off = T.utf8(column)
    parts = [scores(buf[off[a] : off[b]], off[a : b + 1] - off[a], model, cfg) for a, b in T.chunks(off, cfg.chunk_bytes)]
    T.release_memory()
    return np.concatenate(parts) if parts else np.empty(0)


def score_quality(docs: DataFrame, model: QualityModel, cfg: QualityConfig = QualityConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, predicted.

    A null, empty or wordless text scores by the bias; a text of any length is scored
    whole.  Repeated rows and null ids are kept as they are, extra columns are not read,
    and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _score_column(batch.column(1), shared.value, cfg)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= cfg.threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_quality(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig(), text_col: str = "text") -> DataFrame:
    """docs without those that score as label 0; each row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, cfg))
    return keep_rows(docs, text_col, lambda texts: _score_column(texts, shared.value, cfg) >= cfg.threshold)
