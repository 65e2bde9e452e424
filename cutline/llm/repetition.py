"""Quality rules on repetition: how many characters lie in duplicated n-grams and lines.

Word n-grams of several lengths get rolling 64-bit hashes in numpy, a whole batch at once;
an n-gram is duplicated if its hash occurs again in the same document.  Coverage is the
share of a document's word characters inside duplicated n-grams of that length, each
character once however many duplicates cover it, and the share inside lines that equal an
earlier line.  Longer n-grams are only looked for in documents in which the shortest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


@dataclass(frozen=True)
class RepeatConfig:
    """limits: (n, most share of word characters in duplicated n-grams of n words).

    line_chars: most share of word characters in lines equal to an earlier one.
    """

    limits: tuple[tuple[int, float], ...] = ((5, 0.40), (8, 0.40), (12, 0.35))
    line_chars: float = 0.40
    least_words: int = 50
    repeat_percent: int = 50
    chunk_bytes: int = 4_000_000

    @property
    def names(self) -> list[str]:
        return [f"cover_{n}" for n, _ in self.limits]


def _covered(hashes: np.ndarray, begin: np.ndarray, first: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Words inside windows whose hash occurs twice or more in their document."""
    marks = np.zeros(n_words + 1, np.int64)
    if len(hashes):
        doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        key = T.mix64(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        word = at + first[:-1][doc[at]] - begin[:-1][doc[at]]
        np.add.at(marks, word, 1)
        np.add.at(marks, word + width, -1)
    return np.cumsum(marks)[:-1] > 0


def _lines(w: T.Words, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line, and the word characters in them, by document."""
    edge = np.zeros(len(w.buf) + 1, bool)
    edge[w.offsets] = True
    feed = np.flatnonzero(w.buf == 10)
    start = np.union1d(w.offsets[:-1][np.diff(w.offsets) > 0], feed + 1)
    start = start[start < len(w.buf)]
    stop = np.searchsorted(feed, start)
    end = np.where(stop < len(feed), feed[np.minimum(stop, max(len(feed) - 1, 0))] if len(feed) else len(w.buf), len(w.buf))
    doc = np.searchsorted(w.offsets, start, "right") - 1
    end = np.minimum(end, w.offsets[doc + 1])
    lo, hi = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    some = hi > lo
    start, end, doc, lo, hi = start[some], end[some], doc[some], lo[some], hi[some]
    key = T.mix64(T.span_hashes(w.buf, start, end) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:][key[order][1:] == key[order][:-1]]] = True
    total = np.concatenate([[0], np.cumsum(chars)])
    inside = np.where(again, total[hi] - total[lo], 0)
    n = w.n_docs
    return np.bincount(doc, again, n).astype(np.int64), np.bincount(doc, inside, n).astype(np.int64)


def measure(buf: np.ndarray, offsets: np.ndarray, cfg: RepeatConfig) -> dict[str, np.ndarray]:
    """The measures of each document, as columns."""
    w = T.split_words(buf, offsets)
    chars = T.code_points(buf, w.start, w.end)
    word_chars = T.segment_sum(chars, w.first)
    hashes = T.span_hashes(buf, w.start, w.end)
    three, begin = T.windows(hashes, w.first, 3)
    repeat = _covered(three, begin, w.first, 3, len(chars))
    n_repeat = T.segment_sum(repeat, w.first)
    dup_lines, line_chars = _lines(w, chars)
    n_words = w.counts.astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[buf])])
    out = {
        "n_words": n_words,
        "word_chars": word_chars.astype(np.int64),
        "n_symbols": (symbols[offsets[1:]] - symbols[offsets[:-1]]).astype(np.int64),
        "n_dup_lines": dup_lines,
        "n_repeat_words": n_repeat.astype(np.int64),
    }
    # A longer n-gram repeats only where its first three words do.
    busy = np.flatnonzero(n_repeat > 0)
    at = np.concatenate([np.arange(w.first[d], w.first[d + 1]) for d in busy]) if len(busy) else np.empty(0, np.int64)
    first = np.concatenate([[0], np.cumsum(w.counts[busy])])
    whole = np.maximum(word_chars, 1)
    for n, _ in cfg.limits:
        share = np.zeros(w.n_docs)
        if len(at):
            long, start = T.windows(hashes[at], first, n)
            inside = _covered(long, start, first, n, len(at))
            share[busy] = T.segment_sum(inside * chars[at], first) / whole[busy]
        out[f"cover_{n}"] = share
    out["cover_lines"] = line_chars / whole
    base = (n_words < cfg.least_words) | (100 * out["n_repeat_words"] > cfg.repeat_percent * n_words)
    bad = base.copy()
    for n, most in cfg.limits:
        bad |= out[f"cover_{n}"] > most
    out["base_failed"], out["kept"] = base, ~(bad | (out["cover_lines"] > cfg.line_chars))
    return out


def repetition(docs: DataFrame, cfg: RepeatConfig = RepeatConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs with all measures and the verdict.

    A null, empty or wordless text has no word and fails the base rule.  Texts of any
    length are read whole.  Repeated rows and null ids are kept, extra columns are not
    read whatever their names, and an empty table gives an empty result.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *cfg.names, "cover_lines", "base_failed", "kept"]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + "".join(f"{c} double, " for c in [*cfg.names, "cover_lines"]) + "base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.utf8(batch.column(1))
            for a, b in T.chunks(off, cfg.chunk_bytes):
                got = measure(buf[off[a] : off[b]], off[a : b + 1] - off[a], cfg)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(got[n]) for n in names)], ["doc_id", *names])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema)
