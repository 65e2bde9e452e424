"""Removal of repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.llm import passages as P
from cutline.llm import queries

DATA = "/root/testdata/sf0.001"


def brute(rows, width):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 35)
    got = queries.QUERIES["op13_phrase_automata"](spark, DATA).collect()
    assert Counter(map(tuple, got)) == Counter((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in want.elements())
    assert sum(r["n_removed"] > 0 for r in got) > 10


@pytest.mark.parametrize("cfg", [P.PassageConfig(width=7, anchor=3), P.PassageConfig(width=7, anchor=3, filter_bits=1 << 6, bundle_bytes=900, chunk_bytes=500, hold=40), P.PassageConfig(width=7, anchor=7, bundle_bytes=10**9)])
def test_passages_edges_and_hostile_rows_equal_brute_force(spark, cfg):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)] + ["été", "日本", "a"]
    pieces = [[rng.choice(vocab) for _ in range(rng.randrange(5, 30))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(pieces)
            a, b = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
            words += p[a:b] + [rng.choice(vocab) for _ in range(rng.randrange(6))]
        rows.append((i, " \n".join(words)))
    rows += [(3, rows[3][1])] * 2 + [(None, rows[5][1])] * 2 + [(None, None), (None, None), (900, None), (901, ""), (902, " \n"), (903, "x"), (904, "a " * 30), (905, "b " * 7), (906, "c " * 8), (907, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for c in ("row", "bundle", "kind", "lo", "size", "kept"):
        df = df.withColumn(c, F.lit("clash"))
    got = P.remove_passages(df, cfg).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute(rows, cfg.width)
    texts = dict(rows[:150])
    for r in got:
        assert sum(s["length"] for s in r["removed"]) == r["n_removed"]
        if r["doc_id"] is not None and r["doc_id"] < 150:
            w = texts[r["doc_id"]].split()
            gone = {i for s in r["removed"] for i in range(s["start"], s["start"] + s["length"])}
            assert r["kept"].split() == [x for i, x in enumerate(w) if i not in gone]


def test_every_window_has_the_anchor_of_an_equal_window():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 9, 300).astype(np.uint64)
    for span in (1, 2, 3, 7, 26):
        at = P._least(h, span)
        assert all(at[i] == i + int(np.argmin(h[i : i + span])) for i in range(300 - span + 1))


def test_one_repeated_window_in_a_very_long_text_and_empty_table(spark):
    long = " ".join(f"u{i}" for i in range(200_000))
    twice = " ".join(f"u{i}" for i in range(150_000, 150_035))
    df = spark.createDataFrame([(1, long), (2, "before " + twice + " after"), (3, twice[: twice.rindex(" ")])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.remove_passages(df).collect()}
    assert [tuple(s) for s in got[1]["removed"]] == [(150_000, 35)] and got[2]["kept"] == "before after" and got[3]["n_removed"] == 0
    assert P.remove_passages(df.limit(0)).collect() == []
