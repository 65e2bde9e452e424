"""Packing tokenised documents into sequences by vector best-fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared
piece lengths).  A piece goes, longest first, into the open sequence that scores best
among those with room in every dimension: the least weighted norm of what would remain,
or the largest weighted dot product of demand and room.

Pieces of one length are alike to the scores, so the fit is computed on the histogram of
lengths - at most max_tokens numbers, whatever the corpus - and yields patterns: how many
sequences hold which lengths at which offsets.  That is the global fit, not one per
partition.  A piece finds its place by its rank among pieces of its length: each task of
the tokenizing pass numbers its own, and counts by task and length give the offsets.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textops import release_memory

#: The published split pattern of the byte-level vocabulary (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A place where a long text can be cut without changing its tokens.
_CUT = re.compile(r"(?<=[A-Za-z])(?=[ \n][A-Za-z])")
_SLICE = 1_000_000


@dataclass(frozen=True)
class PackConfig:
    """max_docs and max_cost are the other two capacities; None sets those that max_tokens implies."""

    max_tokens: int = 2048
    max_docs: int | None = None
    max_cost: int | None = None
    score: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    end_id: int = 0

    @property
    def room(self) -> tuple[int, int, int]:
        return self.max_tokens, self.max_docs or self.max_tokens, self.max_cost or self.max_tokens**2


class Encoder:
    """Token ids as the tokenizers library gives them for a byte-level BPE file.

    Ordinary text is encoded by tiktoken from the same vocabulary, which is several times
    as fast; texts that contain a special token's string go through tokenizers itself, and
    so does every text if the file does not split by the published pattern alone.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [a["content"] for a in spec["added_tokens"]]
        split = spec.get("pre_tokenizer") or {}
        known = spec["model"].get("type", "BPE") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.published = known and not spec.get("normalizer") and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges")
        if not self.published:
            return
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def plain(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> array:
        if not self.published or any(s in text for s in self.special):
            return array("I", self.plain.encode(text, add_special_tokens=False).ids)
        if len(text) <= _SLICE:
            return array("I", self.fast.encode_ordinary(text))
        out, at = array("I"), 0
        while at < len(text):
            cut = _CUT.search(text, at + _SLICE)
            to = cut.start() if cut else len(text)
            out.extend(self.fast.encode_ordinary(text[at:to]))
            at = to
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_points(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than most."""
    first = (n - 1) % most + 1
    return [(0, first), *((s, most) for s in range(first, n, most))]


_NARROW = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer: str, cfg: PackConfig = PackConfig(), with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document, numbered by task and length; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(cfg.max_tokens + 1, np.int64)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]
        rows: list[list] = [[] for _ in names]
        held = 0

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)
            for c in rows:
                c.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(cfg.end_id)
                for k, (s, n) in enumerate(cut_points(len(ids), cfg.max_tokens)):
                    own = ids[s : s + n]
                    values = [doc_id, k, s, n, zlib.crc32(own.tobytes()), part, int(seen[n])]
                    seen[n] += 1
                    for c, v in zip(rows, [*values, *[np.frombuffer(own, np.uint32).astype(np.int32)] * with_ids], strict=True):
                        c.append(v)
                    held += n
                if len(rows[0]) >= 8192 or with_ids and held >= 2_000_000:
                    held = 0
                    yield full()
        if rows[0]:
            yield full()
        release_memory()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, _NARROW + ", ids array<int>" * with_ids)


@dataclass
class Fit:
    """Open sequences in the making, grouped: many of one pattern are one entry."""

    cfg: PackConfig
    room: np.ndarray = field(init=False)
    many: np.ndarray = field(init=False)
    pattern: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.room, self.many, self.pattern = np.empty((0, 3)), np.empty(0, np.int64), np.empty(0, np.int64)
        self.steps: list[tuple[int, int, int]] = []  # (the pattern before, length, how many of it)
        self.done: list[tuple[int, int]] = []  # (pattern, sequences)

    def _best(self, need: np.ndarray) -> int:
        fits = np.flatnonzero((self.room >= need).all(1))
        if not len(fits):
            return -1
        scale = np.array(self.cfg.weights) / np.array(self.cfg.room, float) ** 2
        if self.cfg.score == "dot":
            return int(fits[np.argmax((self.room[fits] * need * scale).sum(1))])
        return int(fits[np.argmin(((self.room[fits] - need) ** 2 * scale).sum(1))])

    def _open(self, room: np.ndarray, many: int, pattern: int) -> None:
        self.room = np.vstack([self.room, room])
        self.many, self.pattern = np.append(self.many, many), np.append(self.pattern, pattern)

    def place(self, length: int, count: int) -> None:
        need = np.array([length, 1, length**2], float)
        whole = np.array(self.cfg.room, float)
        while count:
            i = self._best(need)
            room, have, before = (self.room[i], int(self.many[i]), int(self.pattern[i])) if i >= 0 else (whole, count, -1)
            each = min(int((room // need).min()), count)
            take = min(have, count // each)
            self.steps.append((before, length, each))
            self._open(room - each * need, take, len(self.steps) - 1)
            count -= each * take
            if i >= 0:
                self.many[i] -= take
                if not self.many[i]:
                    keep = np.arange(len(self.many)) != i
                    self.room, self.many, self.pattern = self.room[keep], self.many[keep], self.pattern[keep]

    def close(self, shortest: int) -> None:
        """Sets aside what no later piece, none longer than shortest, fits."""
        shut = (self.room < np.array([1, 1, 1])).any(1) if shortest > 0 else np.ones(len(self.many), bool)
        self.done += zip(self.pattern[shut].tolist(), self.many[shut].tolist(), strict=True)
        self.room, self.many, self.pattern = self.room[~shut], self.many[~shut], self.pattern[~shut]


def fit(histogram: dict[int, int], cfg: PackConfig) -> np.ndarray:
    """Ranges of ranks and their places.

    A row is (length, first rank, pieces per sequence, first sequence, offset); rows are in
    order of length and first rank.  Raises ValueError if a piece exceeds a capacity.
    """
    if histogram and any(need > have for need, have in zip((max(histogram), 1, max(histogram) ** 2), cfg.room, strict=True)):
        raise ValueError(f"a piece of {max(histogram)} tokens exceeds a capacity of {cfg.room}")
    state = Fit(cfg)
    for length in sorted(histogram, reverse=True):
        state.place(length, histogram[length])
        state.close(1)
    state.close(0)
    rows, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, many in state.done:
        parts = []
        while pattern >= 0:
            pattern, length, each = state.steps[pattern]
            parts.append((length, each))
        offset = 0
        for length, each in reversed(parts):
            rows.append((length, used[length], each, sequence, offset))
            used[length] += each * many
            offset += length * each
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(table: DataFrame, cfg: PackConfig = PackConfig()) -> DataFrame:
    """A written piece table with sequence_id and offset; part and nth go."""
    counts = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most max_tokens rows
    places = fit(histogram, cfg)
    shared = table.sparkSession.sparkContext.broadcast((places[:, 0] * (1 << 44) + places[:, 1], places))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    ranked = table.join(starts, ["part", "length"]).withColumn("_rank", F.col("_base") + F.col("nth"))
    keep = [c for c in table.columns if c not in ("part", "nth")]
    ranked = ranked.select(*keep, "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, place = shared.value
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            row = place[np.searchsorted(key, length * (1 << 44) + rank, "right") - 1] if len(key) else np.empty((0, 5), np.int64)
            nth, inside = np.divmod(rank - row[:, 1], row[:, 2])
            own = [pa.array(row[:, 3] + nth), pa.array(row[:, 4] + inside * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], [*keep, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank")
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, cfg: PackConfig = PackConfig(), with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    Every row of docs is a document, repeated rows included; a null or empty text is the
    end id alone.  Pieces fill a sequence without gaps from offset 0.  A text of any length
    is tokenised whole, in slices that cut at no token.  Extra columns of docs are not
    carried, and an empty table gives an empty result.
    """
    made = Scratch(docs.sparkSession, "pack").table(pieces(docs, tokenizer, cfg, with_ids, id_col, text_col), "pieces")
    return pack(made, cfg)
