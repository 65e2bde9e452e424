"""A run-length grammar of a string by recompression, and longest common extensions on it.

Levels alternate: a block level replaces every maximal block of one symbol by one symbol for
(symbol, times), a pair level deals the symbols to a left and a right side by a hash and
replaces every left symbol that a right one follows by one symbol for the pair.  Both look
at nothing but the symbols themselves, so equal stretches are parsed alike but for one
symbol at either end of every level.  That is what makes an extension query cheap: climb
while both places begin a symbol of the next level, stepping over at most one partial pair
or block a level, then descend from the first difference, stepping over at most one equal
child a level.  Queries run as arrays, all of them a level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import textops as T


@dataclass
class Level:
    """symbols of one level; up[i] is the symbol of the next level that holds symbol i, first its first child."""

    symbols: np.ndarray
    up: np.ndarray | None = None
    first: np.ndarray | None = None
    blocks: bool = False


def _pack(symbols: np.ndarray, begin: np.ndarray, many: np.ndarray, key: np.ndarray, used: int) -> tuple[np.ndarray, int]:
    """Symbols of the next level: groups of one keep theirs, others get one for every distinct key."""
    out = symbols[begin]
    if many.any():
        distinct, at = np.unique(key, return_inverse=True)
        out[many] = used + at
        used += len(distinct)
    return out, used


def grammar(symbols: np.ndarray, enough: int = 1) -> list[Level]:
    """Levels from the string up to one of at most `enough` symbols.  symbols: non-negative integers."""
    levels = [Level(symbols.astype(np.int64))]
    used = int(symbols.max()) + 1 if len(symbols) else 0
    seed = 0
    while len(levels[-1].symbols) > max(enough, 1):
        low = levels[-1]
        s = low.symbols
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        if len(begin) < len(s):
            low.blocks = True
            size = np.diff(np.append(begin, len(s)))
            many = size > 1
            new, used = _pack(s, begin, many, s[begin[many]] * (len(s) + 1) + size[many], used)
        else:
            seed += 1
            left = (T.mix64(s.astype(np.uint64) + np.uint64(seed << 40)) & np.uint64(1)).astype(bool)
            pair = np.flatnonzero(left[:-1] & ~left[1:])
            if not len(pair):
                continue
            single = np.ones(len(s), bool)
            single[pair + 1] = False
            begin = np.flatnonzero(single)
            many = np.zeros(len(s), bool)
            many[pair] = True
            new, used = _pack(s, begin, many[begin], s[pair] * used + s[pair + 1], used)
        low.first = np.append(begin, len(s))
        low.up = np.repeat(np.arange(len(begin)), np.diff(low.first))
        levels.append(Level(new))
    return levels


def extensions(levels: list[Level], i: np.ndarray, j: np.ndarray, forward: bool = True) -> np.ndarray:
    """How many symbols are equal from i and j on, or before i and j if not forward.

    i and j differ, and the string holds symbols that occur once, so that every extension ends
    inside: one before the first place asked for and one after the last.
    """
    step = 1 if forward else -1
    a, b = (i, j) if forward else (i - 1, j - 1)
    start, which = a, np.arange(len(a))
    stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at, level in enumerate(levels):
        s, last = level.symbols, at == len(levels) - 1
        same = s[a] == s[b]
        off = [(which[~same], a[~same], b[~same])]
        which, a, b = which[same], a[same], b[same]
        if last:
            while len(which):
                a, b = a + step, b + step
                same = s[a] == s[b]
                off.append((which[~same], a[~same], b[~same]))
                which, a, b = which[same], a[same], b[same]
        elif len(which):
            ua, ub = level.up[a], level.up[b]
            if forward:
                whole = (level.first[ua] == a) & (level.first[ub] == b)
                ra, rb = level.first[ua + 1] - a, level.first[ub + 1] - b
            else:
                whole = (level.first[ua + 1] - 1 == a) & (level.first[ub + 1] - 1 == b)
                ra, rb = a - level.first[ua] + 1, b - level.first[ub] + 1
            # A partial block or pair is stepped over; blocks with unequal rests end the extension here.
            over = np.where(whole, 0, np.minimum(ra, rb)) * step
            a, b = a + over, b + over
            ends = ~whole & (ra != rb)
            off.append((which[ends], a[ends], b[ends]))
            which, a, b = which[~ends], level.up[a[~ends]], level.up[b[~ends]]
        stopped.append(tuple(np.concatenate(x) for x in zip(*off, strict=True)))
    which, a, b = stopped[-1]
    for at in range(len(levels) - 2, -1, -1):
        level = levels[at]
        if len(which):
            ra, rb = level.first[a + 1] - level.first[a], level.first[b + 1] - level.first[b]
            a, b = (level.first[a], level.first[b]) if forward else (level.first[a + 1] - 1, level.first[b + 1] - 1)
            over = np.minimum(ra, rb) if level.blocks else np.ones(len(a), np.int64)
            over = np.where(level.symbols[a] == level.symbols[b], over, 0) * step
            a, b = a + over, b + over
        which, a, b = (np.concatenate(x) for x in zip((which, a, b), stopped[at], strict=True))
    out = np.empty(len(start), np.int64)
    out[which] = (a - start[which]) * step
    return out
