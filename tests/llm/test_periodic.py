"""Grammar, extension queries and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.llm import periodic as P
from cutline.llm import queries
from cutline.llm.recompression import extensions, grammar

DATA = "/root/testdata/sf0.001"


def expand(levels, at, i):
    if at == 0:
        return [levels[0].symbols[i]]
    below = levels[at - 1]
    return [x for c in range(below.first[i], below.first[i + 1]) for x in expand(levels, at - 1, c)]


@pytest.mark.parametrize("seed", range(6))
def test_grammar_and_extensions_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    parts = [np.tile(rng.integers(0, 3, rng.integers(1, 6)), rng.integers(1, 9)) if rng.random() < 0.6 else rng.integers(0, 3, rng.integers(1, 20)) for _ in range(30)]
    body = np.concatenate(parts)
    s = np.concatenate([[100], body, [101]])
    levels = grammar(s, enough=int(rng.integers(1, 12)))
    for at, level in enumerate(levels):
        assert [x for i in range(len(level.symbols)) for x in expand(levels, at, i)] == s.tolist()
    seen = {}
    top = len(levels) - 1
    for i, x in enumerate(levels[top].symbols.tolist()):
        assert seen.setdefault(x, expand(levels, top, i)) == expand(levels, top, i)
    i, j = rng.integers(1, len(s) - 1, (2, 4_000))
    i, j = i[i != j], j[i != j]
    ahead, back = extensions(levels, i, j), extensions(levels, i, j, forward=False)
    for a, b, x, y in zip(i, j, ahead, back, strict=True):
        n = 0
        while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        m = 0
        while min(a, b) - m > 0 and s[a - m - 1] == s[b - m - 1]:
            m += 1
        assert (x, y) == (n, m)


def brute_runs(words, times=4, least=6):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e - i + q
            if length >= max(least, times * q):
                out.setdefault((i, length), q)
            i = e
    return sorted((s, n, q) for (s, n), q in out.items())


def brute(doc_id, text, plant):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op12_periodic_runs"](spark, DATA).collect()
    assert Counter(map(tuple, got)) == Counter(brute(r["doc_id"], r["text"], True) for r in rows)
    assert sum(r["n_runs"] > 0 for r in got) > 5


def test_random_periodic_texts_and_hostile_rows(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        words = []
        while len(words) < rng.randrange(80):
            unit = [rng.choice(["a", "b", "ab", "é", "日本"]) for _ in range(rng.randrange(1, 6))]
            words += (unit * 9)[: rng.randrange(1, 9 * len(unit))]
        rows.append((i, "\n\t ".join(words)))
    rows += [(3, rows[3][1])] * 2 + [(None, rows[4][1]), (None, None), (500, None), (501, ""), (502, " \n\t"), (503, "x"), (504, "a a a a a"), (505, "a a a a a a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("n_words", "runs", "collapsed", "start", "best"):
        df = df.withColumn(c, F.lit("clash"))
    got = P.digest(P.periodic_runs(df, P.RunConfig(chunk_bytes=700, candidates=50))).collect()
    assert Counter(map(tuple, got)) == Counter(brute(i, t, False) for i, t in rows)


def test_very_long_text_and_empty_table(spark):
    long = "one two three " * 60_000 + "end"
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    (row,) = P.periodic_runs(df).collect()
    assert [tuple(r) for r in row["runs"]] == [(0, 180_000, 3)] and row["collapsed"] == "one two three end"
    assert P.periodic_runs(df.limit(0)).collect() == []
