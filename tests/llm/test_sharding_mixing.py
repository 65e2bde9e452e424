"""Bounded-load sharding and temperature mixing against plain Python."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cutline.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, shard string"


def docs(spark, n=600):
    rows = [(i, f"word {i % 7} " * (i % 9), f"s{min(i % 11, 4)}", "clash") for i in range(n)]
    return spark.createDataFrame([*rows, (None, "no id", None, "x"), (None, "no id", None, "x"), (5, None, "s1", "again"), (6, "", "empty", "x")], SCHEMA)


def brute_shards(keys, shards, vnodes):
    """Home first, in ring order, then overflow round by round."""
    points = sorted((int(hashlib.md5(f"shard-{s}#{v}".encode()).hexdigest()[:12], 16), s) for s in range(shards) for v in range(vnodes))
    pos = sorted((int(hashlib.md5(str(k).encode()).hexdigest()[:12], 16), k) for k in keys)
    at = [p for p, _ in points]
    cap = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    import bisect

    waiting = defaultdict(list)
    for p, k in pos:
        waiting[bisect.bisect_left(at, p) % len(points)].append(k)
    out = {}
    order = []
    for i in range(len(points)):
        seen = []
        for j in range(len(points)):
            s = points[(i + j) % len(points)][1]
            if s not in seen:
                seen.append(s)
        order.append(seen)
    for r in range(shards):
        for arc in range(len(points)):
            s = order[arc][r]
            while waiting[arc] and cap[s]:
                out[waiting[arc].pop(0)] = s
                cap[s] -= 1
    return out


def test_equals_brute_force(spark):
    keys = list(range(500))
    got = sharding.assign_shards(spark.createDataFrame([(k,) for k in keys], "doc_id long"), "doc_id", 5, vnodes=8, rows_per_segment=1, grid=16).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == brute_shards(keys, 5, 8)


def test_counts_slots_and_edges(spark):
    df = docs(spark)
    out = sharding.assign_shards(df, "doc_id", 8, tie_break=[F.col("text")])
    rows = out.collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert out.columns == ["doc_id", "text", "source", "shard", "slot"]
    assert sharding.assign_shards(df.limit(0), "doc_id", 8).count() == 0


def test_growth_moves_little(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    a = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(df, "doc_id", 8).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(df, "doc_id", 9).collect()}
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.3


def test_hot_keys_are_dealt_into_parts(spark):
    """A third of the rows under one id and a third under none: same places, no large window partition."""
    rows = [(k if k % 3 == 0 else 7 if k % 3 == 1 else None, f"text {k % 1500}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    place = lambda **k: sharding.assign_shards(df, "doc_id", 8, tie_break=[F.col("text")], **k)
    key = lambda r: (str(r["doc_id"]), r["text"], r["shard"], r["slot"])
    split, whole = place(rows_per_segment=100), place(rows_per_segment=10**9)
    assert sorted(map(key, split.collect())) == sorted(map(key, whole.collect()))
    counts = Counter(r["shard"] for r in split.collect())
    assert max(counts.values()) - min(counts.values()) <= 1
    # each hot position is a segment of its own, in twenty parts
    pieces = sharding.segments(sharding.ring_points(8, 128), 4096, (12345,))
    assert [p for p in pieces if p[1] == 12345] == [(12345 // (sharding.RING // 4096), 12345, 12346, pieces[[p[1] for p in pieces].index(12345)][3])]


def test_query_is_native(spark):
    plan = sharding.assign_shards(docs(spark), "doc_id", 8)._jdf.queryExecution().toString()
    plan += mixing.mix_sources(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def weights(tokens, cfg):
    total = sum(tokens.values())
    p = {k: t / total for k, t in tokens.items() if t}

    def w(a):
        z = sum(x**a for x in p.values())
        return {k: x**a / z for k, x in p.items()}

    h = lambda a: -sum(x * math.log(x) for x in w(a).values())
    rep = lambda a: max(w(a)[k] / p[k] for k in p) * cfg.budget
    grid = [i / 20000 for i in range(20001)]
    flat = max((a for a in grid if h(a) >= cfg.entropy * math.log(len(p))), default=0.0)
    tame = min(a for a in grid if rep(a) <= cfg.max_repeats)
    return w(max(flat, tame))


@pytest.mark.parametrize("cfg", [mixing.MixConfig(), mixing.MixConfig(entropy=0.99, max_repeats=1.5), mixing.MixConfig(budget=2.5)])
def test_mixture(spark, cfg):
    df = docs(spark)
    tokens = Counter()
    for r in df.collect():
        tokens[r["source"]] += len((r["text"] or "").split())
    drawn = mixing.mix_sources(df, cfg, epoch_col="epoch").collect()
    got = Counter()
    for r in drawn:
        got[r["source"]] += len((r["text"] or "").split())
    want = weights(tokens, cfg)
    total = sum(tokens.values())
    biggest = max(len((r["text"] or "").split()) for r in df.collect())
    for k, w in want.items():
        assert got[k] == pytest.approx(w * cfg.budget * total, abs=3 * biggest + 2e-3 * total), k
    # full copies first, so no row is more than one copy ahead of another of its source
    per = defaultdict(Counter)
    for r in drawn:
        per[r["source"]][r["doc_id"], r["text"]] += 1
    assert all(max(c.values()) - min(c.values()) <= 2 for k, c in per.items() if k not in (None, "s1"))


def test_mixing_edges(spark):
    df = docs(spark)
    assert mixing.mix_sources(df).columns == df.columns
    assert mixing.mix_sources(df.limit(0)).count() == 0
    one = mixing.mix_sources(df.where("source = 's4'"))
    assert one.count() == df.where("source = 's4'").count()
    empty = spark.createDataFrame([(1, None, "a", "x"), (2, "", "b", "y")], SCHEMA)
    assert mixing.mix_sources(empty).count() == 2


@pytest.mark.parametrize("cfg", [{}, {"entropy": 0.99, "max_repeats": 1.5}, {"budget": 2.5}, {"entropy": 0.2, "max_repeats": 50.0}])
def test_many_sources_take_sums_instead_of_an_array(spark, cfg):
    rows = [(f"s{i}", int(10_000 / (1 + i) ** 1.3) + 1) for i in range(300)] + [("none", 0)]
    counted = spark.createDataFrame(rows, "source string, tokens long")
    plan = lambda **k: sorted(map(tuple, mixing.mixture_plan(counted, mixing.MixConfig(**cfg, **k)).collect()))
    assert plan(broadcast_sources=0) == plan()
