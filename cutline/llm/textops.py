"""Vectorised word handling on Arrow string columns.

Everything here works on the raw UTF-8 buffer of a batch, so the cost per word is a
few numpy operations and no Python object is made for a word.  Words are maximal runs
of bytes other than space and ``\\x09``-``\\x0D``; those separators are ASCII, so byte
boundaries are code point boundaries.
"""

from __future__ import annotations

import contextlib
import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: An odd base of the rolling hashes, and its inverse modulo 2^64.
_BASE = np.uint64(0xD6E8FEB86659FD93)
_UNBASE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (wraps on overflow)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a batch: ``first[d]:first[d + 1]`` are the words of document d."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    upper = (buf >= 65) & (buf <= 90)
    return buf + (upper.view(np.uint8) << 5)


def split_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    return split_spans(buf, offsets, ~((buf == 32) | ((buf >= 9) & (buf <= 13))))


def split_spans(buf: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> Words:
    """Maximal runs of the bytes marked in word, none across documents."""
    n = len(buf)
    if n == 0:
        z = np.zeros(len(offsets), np.int64)
        return Words(buf, offsets, z[:0], z[:0], z)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~word[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~word[1:]
    start = np.flatnonzero(word & (before | edge[:-1]))
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    return Words(buf, offsets, start, end, np.searchsorted(start, offsets))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    size = end - start
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    out[:] = size.astype(np.uint64) * _GOLD + np.uint64(seed)
    live, pos, left = np.arange(len(start)), start, size
    for _ in range(LONG_WORD // 8):
        keep = np.minimum(left, 8).astype(np.uint64)
        lane = lanes[pos] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - keep * np.uint64(8)))
        out[live] = mix64(out[live] ^ lane) * _GOLD
        more = left > 8
        if not more.any():
            break
        live, pos, left = live[more], pos[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(buf[start[i] : end[i]].tobytes(), seed)
    return mix64(out)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def windows(hashes: np.ndarray, first: np.ndarray, width: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word windows of one width, and where those of each document begin.

    Rolling: with running sums H of word hash times BASE^position, a window's polynomial is
    (H[i + width] - H[i]) / BASE^i modulo 2^64, one step a window whatever the width.
    short: a document of 1 to width - 1 words gives one window, its whole sequence.
    """
    count = np.diff(first)
    n = len(hashes)
    made = np.maximum(count - width + 1, 0)
    up, down = _powers(_BASE, n), _powers(_UNBASE, n)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=run[1:])
    size = np.full(len(count), width)
    if short:
        few = (count > 0) & (count < width)
        made[few], size[few] = 1, count[few]
    begin = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], made)
    wide = np.repeat(size, made)
    return mix64((run[at + wide] - run[at]) * down[at] + wide.astype(np.uint64) * _GOLD), begin


def code_points(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points in each byte span."""
    heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return heads[end] - heads[start]


def segment_sum(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of values[begin[i]:begin[i + 1]], empty segments included."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[begin[1:]] - total[begin[:-1]]


def join_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space: words first[d] to first[d + 1] are its own."""
    kept = np.concatenate([[0], np.cumsum(keep)])
    start, size = start[keep], (end - start)[keep] + 1
    upto = np.cumsum(size)
    total = int(upto[-1]) if len(upto) else 0
    source = np.repeat(start - (upto - size), size) + np.arange(total)
    out = buf[np.minimum(source, len(buf) - 1)] if total else np.empty(0, np.uint8)
    out[upto - 1] = 32
    ends = kept[first]
    some = ends[1:] > ends[:-1]
    whole = np.concatenate([[0], upto])[ends]
    out = np.delete(out, whole[1:][some] - 1)  # no space after the last word
    offsets = np.concatenate([[0], np.cumsum(np.diff(whole) - some)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def release_memory() -> None:
    """Gives what a worker has freed back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every libc has it
        ctypes.CDLL(None).malloc_trim(0)


def chunks(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of documents with at most so many bytes together; a longer document is a run of its own."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        out.append((a, min(b, n)))
        a = min(b, n)
    return out
