"""Importance resampling against a brute-force version, ranks over many segments, and hostile rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cutline.llm import resampling as R


def features(text, ngrams):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + k]) for k in range(1, ngrams + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, cfg):
    put = lambda texts: Counter(zlib.crc32(f.encode()) % cfg.buckets for t in texts for f in features(t, cfg.ngrams)[1])
    src, dst = put([t for _, t in docs]), put(target)
    s, t = sum(src.values()), sum(dst.values())
    rows = []
    for i, text in docs:
        words, feats = features(text, cfg.ngrams)
        weight = 0
        for f in feats:
            b = zlib.crc32(f.encode()) % cfg.buckets
            weight += math.floor(1000 * math.log((dst[b] + 1) * (s + cfg.buckets) / ((src[b] + 1) * (t + cfg.buckets))))
        h = int(hashlib.sha256(f"{cfg.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words), len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    ranked = sorted((r for r in rows if r[1] >= cfg.least_words), key=lambda r: (-r[4], -(2**63) if r[0] is None else r[0], -r[2]))
    for k, r in enumerate(ranked[: cfg.percent * len(ranked) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, rows))


def test_equals_brute_force_with_hostile_rows(spark):
    rng = random.Random(3)
    words = "The river Mill sea Überfluß été 42 don't x2 日本 a".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(300)]
    docs += [(7, docs[7][1])] * 3 + [(None, docs[8][1])] * 2 + [(400, None), (401, ""), (402, "!!! ..."), (403, "river\x00mill " * 40_000)]
    target = [" ".join(rng.choice(words[:4]) for _ in range(30)) for _ in range(20)] + [None, ""]
    cfg = R.ResampleConfig(ngrams=2, buckets=97, percent=35, least_words=20, seed=5, chunk_bytes=3_000, least_segments=5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for c in ("rank", "score", "segment", "place", "begin", "weight"):
        df = df.withColumn(c, F.lit("clash"))
    got = R.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), cfg)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute(docs, target, cfg)


def test_ranks_over_many_runs_and_segments(spark):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), (F.col("id") % 7).cast("string"), F.lit(" ")), 20).alias("text")).repartition(9)
    target = spark.createDataFrame([("w1 w2 w2",)], "text string")
    cfg = R.ResampleConfig(percent=60, least_segments=40)
    got = R.resample(docs, target, cfg).collect()
    ranked = sorted(got, key=lambda r: (-r["score"], r["doc_id"]))
    assert [r["rank"] for r in ranked] == [*range(1, 2_401), *[None] * 1_600]


def test_splitters_bound_segments_and_leave_out_only_what_is_not_drawn():
    rng = np.random.default_rng(1)
    runs = [np.sort(rng.integers(0, 1_000, rng.integers(50, 400)))[::-1] for _ in range(12)]
    step, drawn = 10, 700
    samples = [(int(s), i, 0, k) for k, r in enumerate(runs) for i, s in enumerate(r) if i % step == step - 1]
    cut = R.splitters(samples, step, drawn, 8)
    rows = sorted(((-int(s), i) for r in runs for i, s in enumerate(r)))
    last = sum(1 for r in rows if r <= (-cut[-1][0], cut[-1][1]))
    assert drawn <= last <= drawn + step * (len(runs) + 1)
    assert len(cut) <= 9


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert R.resample(none, some).collect() == []
    (row,) = R.resample(some, none, R.ResampleConfig(percent=100)).collect()
    assert (row["n_features"], row["rank"]) == (30, 1)


def test_crc_is_that_of_zlib():
    texts = [b"", b"a", b"abcdefgh" * 9, bytes(range(256))]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    got = ~R.crc_extend(np.full(4, 0xFFFFFFFF, np.uint32), buf, end - [len(t) for t in texts], end)
    assert got.tolist() == [zlib.crc32(t) for t in texts]
