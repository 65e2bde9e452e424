"""Removal of word passages that occur more than once in the corpus, by repeated-phrase automata.

A window of ``width`` words is repeated if its words also start anywhere else.  Windows are not
all shuffled: each has an anchor, the ``anchor`` consecutive words of it with the least hash, so
equal windows have equal anchors, and a run of windows with one anchor is one group.

1. Anchors are counted, one row a task and anchor.  An anchor that recurs with always the same
   group of windows around it (a copy's inside) is told from one that recurs with different
   ones (a passage's edge); both sets go into a filter of bounded size.
2. Groups of the first kind and single windows of the second are counted exactly, one row a
   task and key; what occurs twice inside a task needs no counting.  The filter may let through
   what does not recur, never the reverse, and decides by anchor, so it cannot change a result.
   What occurs at least twice is a confirmed recurring passage of its document.
3. Documents are dealt into bundles by a hash of id and text.  Each bundle is a shard: its
   confirmed passages are read out of its documents and compiled into one Aho-Corasick automaton,
   and all documents of the bundle stream through it.  It finds every occurrence by the letters
   themselves, not by hashes, and decides what is removed.  A shard's automaton is bounded by the
   bundle's own text, so the work is linear however many phrases the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .scratch import Scratch

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_KINDS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))
_PROBES = 3


@dataclass(frozen=True)
class PassageConfig:
    """width: words of a window.  anchor: words of its anchor.

    filter_bits: greatest size of the filter.  Beyond filter_bits / 16 recurring anchors more and more
    rows that do not recur are counted too; the result stays the same.
    bundle_bytes: text of a bundle.  hold: groups that a task holds before it reports them.
    """

    width: int = 35
    anchor: int = 10
    filter_bits: int = 1 << 27
    bundle_bytes: int = 4_000_000
    partition_bytes: int = 64_000_000
    chunk_bytes: int = 2_000_000
    hold: int = 4_000_000


@dataclass
class Groups:
    """Runs of windows with one anchor: windows begin[g]:begin[g + 1] belong to group g."""

    windows: np.ndarray
    place: np.ndarray
    doc: np.ndarray
    begin: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def _least(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each place, that of the first least hash among it and the span - 1 places after it."""
    n = len(hashes)
    value, at, done = hashes, np.arange(n), 1
    while done < span:
        step = min(done, span - done)
        later = np.minimum(np.arange(n) + step, n - 1)
        better = value[later] < value
        value, at, done = np.where(better, value[later], value), np.where(better, at[later], at), done + step
    return at


def groups(buf: np.ndarray, offsets: np.ndarray, cfg: PassageConfig) -> Groups:
    w = T.split_words(buf, offsets)
    hashes = T.span_hashes(w.buf, w.start, w.end)
    windows, begin = T.windows(hashes, w.first, cfg.width)
    grams, of = T.windows(hashes, w.first, cfg.anchor)
    doc = np.repeat(np.arange(w.n_docs), np.diff(begin))
    place = np.arange(len(windows)) - begin[:-1][doc]
    at = _least(grams, cfg.width - cfg.anchor + 1)[of[:-1][doc] + place] if len(windows) else place
    new = np.flatnonzero(np.diff(at)) + 1 if len(at) else at
    start = np.concatenate([[0], new]).astype(np.int64)[: len(at)]
    anchor = grams[at[start]]
    content = T.mix64(np.add.reduceat(T.mix64(windows), start) + anchor * _GOLD) if len(start) else windows
    return Groups(windows, place, doc, np.append(start, len(windows)), anchor, content)


def _anchor_rows(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """One row an anchor: n = 1 seen once, 2 more often in one content, 3 in several."""
    order = np.lexsort([c, h])
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(h)))
    n = np.where(size == 1, 1, np.where(c[first] == c[first + size - 1], 2, 3)).astype(np.int8)
    return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(c[first].view(np.int64)), pa.array(n)], ["h", "c", "n"])


def recurring_anchors(texts: DataFrame, cfg: PassageConfig) -> DataFrame:
    """h and kind of every anchor seen twice: 0 always with the same windows, 1 with different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            buf, off = T.utf8(batch.column(0))
            for a, b in T.chunks(off, cfg.chunk_bytes):
                g = groups(buf[off[a] : off[b]], off[a : b + 1] - off[a], cfg)
                held.append((g.anchor, g.content))
                size += len(g.anchor)
            if size >= cfg.hold:
                yield _anchor_rows(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield _anchor_rows(*(np.concatenate(x) for x in zip(*held, strict=True)))
        T.release_memory()

    seen = texts.mapInArrow(run, "h long, c long, n byte").groupBy("h").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    return seen.where("n >= 2").select("h", F.when((F.col("most") == 3) | (F.col("lo") != F.col("hi")), 1).otherwise(0).cast("byte").alias("kind"))


def _bits(h: np.ndarray, kind: int, mask: int) -> Iterator[np.ndarray]:
    x = T.mix64(h ^ _KINDS[kind])
    y = T.mix64(x + _GOLD) | np.uint64(1)
    for _ in range(_PROBES):
        yield x & np.uint64(mask)
        x = x + y


@dataclass
class Filter:
    """A Bloom filter of (anchor, kind)."""

    words: np.ndarray

    def holds(self, h: np.ndarray, kind: int) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in _bits(h, kind, 64 * len(self.words) - 1):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def make_filter(anchors: DataFrame, cfg: PassageConfig) -> Filter:
    """The filter of all anchors; its bits are set in tasks and merged by word, so at most filter_bits reach the driver."""
    n = min(cfg.filter_bits, max(1 << 12, 1 << (16 * anchors.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, kind = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            at = np.concatenate([x for k in (0, 1) for x in _bits(h[kind == k], k, n - 1)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])

    table = anchors.select("h", "kind").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(n // 64, np.uint64)
    words[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return Filter(words)


def _nominations(key: np.ndarray, row: np.ndarray, lo: np.ndarray, size: np.ndarray, single: np.ndarray) -> pa.RecordBatch:
    """Rows (key, n, row, lo, size): the first place of each key, to be counted, and those that need no count.

    Keys seen twice here are confirmed: their other places get a key of their own with n = 2, and
    neighbouring single windows among them become one stretch.
    """
    _, first, again, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    other = np.ones(len(key), bool)
    other[first] = False
    at = np.flatnonzero(other)
    joined = np.zeros(len(at), bool)
    joined[1:] = (np.diff(at) == 1) & (row[at][1:] == row[at][:-1]) & (lo[at][1:] == lo[at][:-1] + 1) & single[at][1:] & single[at][:-1]
    head = np.flatnonzero(~joined)
    length = np.diff(np.append(head, len(at)))
    at = at[head]
    own = T.mix64(key[at] + row[at] * _GOLD + lo[at].astype(np.uint64))
    out = [
        np.concatenate([key[first], own]).view(np.int64),
        np.concatenate([np.minimum(n, 2), np.full(len(at), 2)]).astype(np.int8),
        np.concatenate([row[first], row[at]]).view(np.int64),
        np.concatenate([lo[first], lo[at]]).astype(np.int32),
        np.concatenate([size[first], size[at] + length - 1]).astype(np.int32),
    ]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["key", "n", "row", "lo", "size"])


def recurring_passages(rows: DataFrame, found: Filter, cfg: PassageConfig) -> DataFrame:
    """(row, lo, size): stretches of words of a row whose windows all recur, together all of them.

    rows: row and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy().view(np.uint64)
            buf, off = T.utf8(batch.column(1))
            for a, b in T.chunks(off, cfg.chunk_bytes):
                g = groups(buf[off[a] : off[b]], off[a : b + 1] - off[a], cfg)
                edge = found.holds(g.anchor, 1)
                whole = np.flatnonzero(found.holds(g.anchor, 0) & ~edge)
                single = np.flatnonzero(np.repeat(edge, np.diff(g.begin)))
                at = np.concatenate([g.begin[whole], single])
                order = np.argsort(at, kind="stable")
                at = at[order]
                held.append([
                    np.concatenate([g.content[whole], g.windows[single]])[order],
                    ids[a:b][g.doc[at]],
                    g.place[at],
                    np.concatenate([np.diff(g.begin)[whole] + cfg.width - 1, np.full(len(single), cfg.width)])[order],
                    np.concatenate([np.zeros(len(whole), bool), np.ones(len(single), bool)])[order],
                ])
                size += len(at)
            if size >= cfg.hold:
                yield _nominations(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield _nominations(*(np.concatenate(x) for x in zip(*held, strict=True)))
        T.release_memory()

    asked = rows.select("row", "text").mapInArrow(run, "key long, n byte, row long, lo int, size int")
    return asked.withColumn("n", F.sum("n").over(Window.partitionBy("key"))).where("n >= 2").select("row", "lo", "size")


def _stretches(lo: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """The union of stretches of words, as disjoint ones."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate((lo + size)[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return list(zip(lo[new].tolist(), hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)].tolist(), strict=True))


class Bundle:
    """The documents of one bundle and the passages confirmed in them."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.rows: list[int] = []
        self.texts: list[pa.Array] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        kind = batch.column("kind").to_numpy()
        n = int((kind == 0).sum())  # passages come first
        if n:
            self.found.append(tuple(batch.column(c).slice(0, n).to_numpy() for c in ("row", "lo", "size")))
        if n < len(kind):
            self.ids += batch.column("doc_id").slice(n).to_pylist()
            self.rows += batch.column("row").slice(n).to_pylist()
            self.texts.append(batch.column("text").slice(n))

    def removed(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        buf, off = T.utf8(pa.concat_arrays(self.texts))
        w = T.split_words(buf, off)
        chars = np.concatenate([[0], np.cumsum(T.code_points(w.buf, w.start, w.end) + 1)])
        plain = T.join_words(w.buf, w.start, w.end, w.first, np.ones(len(w.start), bool))
        marks = np.zeros(len(w.start) + 1, np.int64)
        machine = self.compile(w, chars, plain)
        if machine is not None:
            for d, text in enumerate(plain.to_pylist()):
                starts = chars[w.first[d] : w.first[d + 1] + 1] - chars[w.first[d]]
                hits = [(end - size + 1, end) for end, size in machine.iter(f" {text} ")]
                if hits:
                    lo, hi = np.searchsorted(starts, np.array(hits).T)
                    np.add.at(marks, w.first[d] + lo, 1)
                    np.add.at(marks, w.first[d] + hi, -1)
        gone = np.cumsum(marks)[:-1] > 0
        kept = T.join_words(w.buf, w.start, w.end, w.first, ~gone)
        edge = np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))
        doc = np.repeat(np.arange(w.n_docs), w.counts)
        inner = w.first[(w.counts > 0).nonzero()[0]]  # a stretch that runs over a document's end is two
        lo = np.union1d(np.flatnonzero(edge == 1), inner[gone[inner]]).astype(np.int64)
        hi = np.union1d(np.flatnonzero(edge == -1), inner[(inner > 0) & gone[inner - 1]]).astype(np.int64)
        spans = pa.StructArray.from_arrays([pa.array(lo - w.first[doc[lo]]), pa.array(hi - lo)], ["start", "length"])
        begin = np.concatenate([[0], np.cumsum(np.bincount(doc[lo], minlength=w.n_docs))]).astype(np.int32)
        counts = [pa.array(w.counts.astype(np.int64)), pa.array(T.segment_sum(gone, w.first).astype(np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64()), *counts, pa.ListArray.from_arrays(pa.array(begin), spans), kept], ["doc_id", "n_words", "n_removed", "removed", "kept"])

    def compile(self, w: T.Words, chars: np.ndarray, plain: pa.Array) -> ahocorasick.Automaton | None:
        """The automaton of the bundle's distinct passages, each between spaces."""
        if not self.found:
            return None
        row, lo, size = (np.concatenate(x) for x in zip(*self.found, strict=True))
        where = {r: d for d, r in enumerate(self.rows)}
        machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        order = np.argsort(row, kind="stable")
        ends = np.flatnonzero(np.append(np.diff(row[order]) != 0, True)) + 1
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            own = order[a:b]
            d = where[int(row[own[0]])]
            text, at = plain[d].as_py(), chars[w.first[d] : w.first[d + 1] + 1] - chars[w.first[d]]
            for x, y in _stretches(lo[own], size[own]):
                machine.add_word(f" {text[at[x] : at[y] - 1]} ")
        machine.make_automaton()
        return machine


def remove_passages(docs: DataFrame, cfg: PassageConfig = PassageConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, removed (start, length in words) and kept text of every row of docs.

    A word goes if a window of cfg.width words that covers it also starts anywhere else, in
    the same text or another; rows alike in id and text are different documents with equal texts, so
    all their windows recur.  Kept words are joined by one space.  A null, empty or wordless text and one
    shorter than a window lose nothing.  Texts are read whole, whatever their length, in memory in
    proportion to one text or one bundle; rows alike in id and text stay in one bundle.
    Other columns are not read whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    found = make_filter(scratch.table(recurring_anchors(rows.select("text"), cfg), "anchors"), cfg)
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bundles = max(1, -(-total // cfg.bundle_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // cfg.partition_bytes))
    passages = recurring_passages(rows, found, cfg)
    bundle = F.pmod("row", F.lit(bundles)).alias("bundle")
    null = F.lit(None)
    both = passages.select(bundle, F.lit(0).alias("kind"), "row", "lo", "size", null.cast("long").alias("doc_id"), null.cast("string").alias("text")).unionByName(
        rows.select(bundle, F.lit(1).alias("kind"), "row", null.cast("int").alias("lo"), null.cast("int").alias("size"), "doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Bundle()
        for batch in batches:
            number = batch.column("bundle").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if number[a] != now:
                        yield from held.removed()
                        now, held = number[a], Bundle()
                    held.add(batch.slice(a, b - a))
        yield from held.removed()
        T.release_memory()

    schema = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,length:long>>, kept string"
    return both.repartition(parts, "bundle").sortWithinPartitions("bundle", "kind").mapInArrow(run, schema)
