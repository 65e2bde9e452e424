"""Language identification of mixed text: scripts, per-word scores, Viterbi with a switching penalty.

Learning.  Hashed counts of byte trigrams (with word edges) and of whole words, by
language, over a bounded sample of labelled documents, are summed by Spark; the collected
table is bounded by languages x features.  Scripts seen with a language are counted too.

Labelling.  Each word's script, found from code point ranges, narrows the candidate
languages; the candidates' scores are log likelihoods of the word's features.  A Viterbi
pass over the words of a document, whose path pays a penalty at each change of language,
labels spans.  It runs over all documents of a batch at once, one step per word position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .filtering import keep_rows
from .folds import held_out, thinned

#: First code points of script blocks and the scripts that begin there (fixed values).
SCRIPT_STARTS = np.array([0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0x980, 0xE00, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD800])
SCRIPTS = ["Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Indic", "Thai", "Georgian", "Hangul", "Ethiopic", "Latin", "Greek", "Other", "Kana", "Other", "Han", "Other", "Hangul", "Other"]
_NAMES = sorted(set(SCRIPTS))
_SCRIPT = np.array([_NAMES.index(s) for s in SCRIPTS])
BITS = 16
_WORDS = 1 << BITS
UNKNOWN = "und"


@dataclass(frozen=True)
class LangConfig:
    """sample_docs: most documents, about, to learn each language from."""

    sample_docs: int = 3000
    penalty: float = 8.0
    floor: float = -6.0
    smoothing: float = 0.5
    feature_bytes: int = 500_000
    chunk_bytes: int = 3_000_000


@dataclass(frozen=True)
class LangModel:
    langs: tuple[str, ...]
    table: np.ndarray  # languages x (trigrams, words), log probabilities
    allowed: np.ndarray  # scripts x languages


def _letters(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case with all that is no letter blank, documents apart; where each byte and document went."""
    n_docs = len(offsets) - 1
    out = np.full(len(buf) + n_docs + 1, 32, np.uint8)
    shift = np.repeat(np.arange(1, n_docs + 1), np.diff(offsets))
    shift += np.arange(len(buf))
    at = shift
    low = T.lower_ascii(buf)
    keep = ((low >= 97) & (low <= 122)) | (low >= 128)
    out[at] = np.where(keep, low, 32)
    # Capital letters of the Latin-1 block are C3 80 to C3 9E.
    lead = np.flatnonzero(out[:-1] == 0xC3)
    second = out[lead + 1]
    out[lead + 1] = second + np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), 0x20, 0).astype(np.uint8)
    return out, at, offsets + np.arange(n_docs + 1)


@dataclass
class _Features:
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    grams: np.ndarray
    gram_begin: np.ndarray
    words: np.ndarray
    script: np.ndarray


def _features(buf: np.ndarray, offsets: np.ndarray) -> _Features:
    clean, _, place = _letters(buf, offsets)
    word = clean != 32
    start = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    end = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    first = np.searchsorted(start, place)
    size = end - start
    begin = np.concatenate([[0], np.cumsum(size)])
    # A word of m bytes has m trigrams: from edge and first two bytes to last two and edge.
    third = np.arange(begin[-1]) + np.repeat(start + 1 - begin[:-1], size)
    wide = clean.astype(np.uint32)
    code = (wide[third - 2] << np.uint32(16)) | (wide[third - 1] << np.uint32(8)) | wide[third]
    grams = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
    words = (T.span_hashes(clean, start, end) >> np.uint64(64 - BITS)).astype(np.int32)
    a, b, c = (clean[np.minimum(start + k, len(clean) - 1)].astype(np.int64) for k in range(3))
    cp = np.where(a < 0x80, a, np.where(a < 0xE0, ((a & 0x1F) << 6) | (b & 0x3F), np.where(a < 0xF0, ((a & 0xF) << 12) | ((b & 0x3F) << 6) | (c & 0x3F), 0x3400)))
    script = _SCRIPT[np.searchsorted(SCRIPT_STARTS, cp, "right") - 1]
    return _Features(start, end, first, grams, begin, words, script)


def _count(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            buf, off = T.utf8(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), object)
            for a, b in T.chunks(off, chunk_bytes):
                f = _features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                of_doc = np.repeat(np.arange(b - a), np.diff(f.first))
                of_gram = np.repeat(of_doc, np.diff(f.gram_begin))
                for lang in set(langs[a:b]):
                    mine = langs[a:b] == lang
                    total = seen.setdefault(lang, np.zeros(2 * _WORDS + len(_NAMES), np.int64))
                    total[:_WORDS] += np.bincount(f.grams[mine[of_gram]], minlength=_WORDS)
                    total[_WORDS : 2 * _WORDS] += np.bincount(f.words[mine[of_doc]], minlength=_WORDS)
                    total[2 * _WORDS :] += np.bincount(f.script[mine[of_doc]], minlength=len(_NAMES))
        for lang, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], ["lang", "feature", "n"])

    return run


def fit_languages(docs: DataFrame, cfg: LangConfig = LangConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel | None:
    """A model of the labelled languages of documents that are not held out; None if there are none.

    About sample_docs ids a language are drawn by a hash, and of rows that share an id and a language one
    text is learned from, that of the least hash, so the sample is bounded by rows however often
    an id is repeated.
    """
    use = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    size = {r[0]: r[1] for r in use.groupBy(lang_col).agg(F.approx_count_distinct(id_col, 0.02)).collect()}  # one row a language
    share = F.lit(0.0)
    for lang, n in size.items():
        share = F.when(F.col(lang_col) == lang, min(1.0, cfg.sample_docs / n)).otherwise(share)
    sample = use.where(thinned(F.col(id_col), share)).select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sample = sample.groupBy("_id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")).select("lang", "text")
    counted = sample.mapInArrow(_count(cfg.feature_bytes), "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # at most languages x (2 x 2^16 + scripts)
    if not rows.num_rows:
        return None
    lang, feature, n = (rows.column(i).to_numpy() for i in range(3))
    langs = tuple(sorted(set(lang)))
    dense = np.zeros((len(langs), 2 * _WORDS + len(_NAMES)))
    dense[[langs.index(x) for x in lang], feature] = n
    both = dense[:, : 2 * _WORDS].reshape(len(langs), 2, _WORDS) + cfg.smoothing
    table = np.log(both / both.sum(2, keepdims=True)).reshape(len(langs), -1).astype(np.float32)
    scripts = dense[:, 2 * _WORDS :].T
    allowed = scripts > 0.001 * dense[:, 2 * _WORDS :].sum(1)
    allowed[~allowed.any(1)] = True  # a script never seen excludes nobody
    return LangModel(langs, table, allowed)


def word_scores(f: _Features, model: LangModel, floor: float) -> np.ndarray:
    """Log likelihood of each word by language, relative to the best, not under floor."""
    out = np.empty((len(f.words), len(model.langs)), np.float32)
    begin = f.gram_begin[:-1]
    for k, row in enumerate(model.table):
        grams = np.add.reduceat(row[f.grams], begin) if len(begin) else np.empty(0, np.float32)
        out[:, k] = grams + row[_WORDS + f.words]
    out = np.where(model.allowed[f.script], out, np.float32(-1e9))
    out -= out.max(1, keepdims=True) if len(out) else 0
    return np.maximum(out, floor)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; segments first[i]:first[i + 1] are independent."""
    n, k = scores.shape
    labels = np.zeros(n, np.uint8 if k < 256 else np.int32)
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    if not len(order):
        return labels
    start, size = first[:-1][order], count[order]
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(steps), "left")  # documents longer than t
    switched, came = np.zeros((n, k), bool), np.zeros(n, labels.dtype)
    state = np.zeros(len(order), np.int64)
    d = scores[start]
    for t in range(1, steps):
        a = active[t]
        if a < len(d):
            state[a : len(d)] = d[a:].argmax(1)
            d = d[:a]
        row = start[:a] + t
        top = d.max(1)
        least = (top - penalty)[:, None]
        came[row] = d.argmax(1)
        switched[row] = d < least
        d = np.maximum(d, least) + scores[row] - top[:, None]
    state[: len(d)] = d.argmax(1)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        row = start[:a] + t
        s = state[:a]
        labels[row] = s
        if t:
            state[:a] = np.where(switched[row, s], came[row], s)
    return labels


def _scored_words(buf: np.ndarray, offsets: np.ndarray, model: LangModel | None, cfg: LangConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word scores of a chunk, where each document's words begin, and the words' places in their own texts.

    Features take many times a text's size, so they are made a small part at a time; only
    the scores of the whole chunk are kept.
    """
    if model is None:
        none = np.empty(0, np.int64)
        return np.empty((0, 0), np.float32), np.zeros(len(offsets), np.int64), none, none
    scores, start, end, counts = [], [], [], []
    for a, b in T.chunks(offsets, cfg.feature_bytes):
        f = _features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n = np.diff(f.first)
        # documents were moved apart by one place each, the first by one as well
        base = np.repeat(offsets[a:b] - offsets[a] + np.arange(1, b - a + 1), n)
        scores.append(word_scores(f, model, cfg.floor))
        start.append(f.start - base)
        end.append(f.end - base)
        counts.append(n)
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(len(offsets), np.int64)
    return np.concatenate(scores), first, np.concatenate(start), np.concatenate(end)


@dataclass(frozen=True)
class _Labelled:
    """A chunk of texts: predictions, scores, words, and each document's spans."""

    pred: np.ndarray
    score: np.ndarray
    n_words: np.ndarray
    spans: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # language, start, end; where documents begin


def _label(column: pa.Array, model: LangModel | None, cfg: LangConfig) -> Iterator[tuple[int, int, _Labelled]]:
    """(first, end, labels) of the chunks of a column; language number len(langs) is unknown."""
    buf, off = T.utf8(column)
    lettered = pc.match_substring_regex(column, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
    for a, b in T.chunks(off, cfg.chunk_bytes):
        n_docs, k = b - a, len(model.langs) if model else 0
        own, first, start, end = _scored_words(buf[off[a] : off[b]], off[a : b + 1] - off[a], model, cfg)
        if model is None or not len(own):
            none = np.empty(0, np.int64)
            yield a, b, _Labelled(np.full(n_docs, k), np.zeros(n_docs), np.diff(first), (none, none, none, np.zeros(n_docs + 1, np.int64)))
            continue
        label = viterbi(own, first, cfg.penalty)
        weight = end - start
        doc = np.repeat(np.arange(n_docs), np.diff(first))
        by = np.bincount(doc * k + label, weight, n_docs * k).reshape(n_docs, k)
        alone = np.bincount(doc * k + own.argmax(1), weight, n_docs * k).reshape(n_docs, k)
        pred = by.argmax(1)
        score = (by[np.arange(n_docs), pred] + alone[np.arange(n_docs), pred]) / (2 * np.maximum(by.sum(1), 1))
        no = ~lettered[a:b] | (by.sum(1) == 0)
        head = np.ones(len(label), bool)
        head[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(head)
        last = np.append(at[1:], len(label)) - 1
        spans = (label[at].astype(np.int64), start[at], end[last], np.searchsorted(doc[at], np.arange(n_docs + 1)))
        yield a, b, _Labelled(np.where(no, k, pred), np.where(no, 0.0, score), np.diff(first), spans)
    T.release_memory()


def identify(docs: DataFrame, model: LangModel | None, cfg: LangConfig = LangConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, n_words, spans.

    spans is an array of (lang, start, end): byte offsets in the text's UTF-8 form from a
    span's first letter to its last, in order.  lang_pred is the language of most letters;
    score is the mean of its share of them and the share of letters in words that score
    best for it on their own.  A text that is null or has no letter is ``und`` with score 0,
    as is every text if there was nothing to learn from.  Texts of any length are labelled whole; repeated
    rows and null ids are kept, other columns are not read whatever their names, and an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2^17 floats
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LangModel | None = shared.value
        names = np.array([*(m.langs if m else ()), UNKNOWN], object)
        for batch in batches:
            for a, b, got in _label(batch.column(1), m, cfg):
                lang, start, end, begin = got.spans
                flat = pa.StructArray.from_arrays([pa.array(names[lang], pa.string()), pa.array(start), pa.array(end)], ["lang", "start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names[got.pred], pa.string()), pa.array(got.score), pa.array(got.n_words), spans], schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long, spans array<struct<lang:string,start:long,end:long>>")


def keep_language(docs: DataFrame, cfg: LangConfig = LangConfig(), least_score: float = 0.4, model: LangModel | None = None, text_col: str = "text") -> DataFrame:
    """docs without those whose language is unknown or scores under least_score; each row is judged by its own text.

    A null text goes, repeated rows stay or go together, columns are carried whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_languages(docs, cfg, text_col=text_col))

    def decide(texts: pa.Array) -> np.ndarray:
        m = shared.value
        return np.concatenate([(got.pred < len(m.langs) if m else np.zeros(b - a, bool)) & (got.score >= least_score) for a, b, got in _label(texts, m, cfg)])

    return keep_rows(docs, text_col, decide)
