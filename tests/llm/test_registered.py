"""Every registered query, and the pipeline stage by stage, on the smallest tables: columns and derived values."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cutline.llm import language, near_dedup, packing, quality, queries

from test_near_dedup import brute
from test_text_models import brute_repetition, held

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def test_op1(spark, texts):
    got = rows(spark, "op1_consistent_hash_shards")
    slots = defaultdict(list)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8)) and len(got) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


@pytest.mark.parametrize("name", ["op2_language_spans", "op8_ftrl_quality"])
def test_op2_op8(spark, texts, name):
    got = rows(spark, name)
    assert Counter(r["doc_id"] for r in got) == Counter(texts.keys())
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    if name.startswith("op8"):
        assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    else:
        assert {r["lang_pred"] for r in got} <= {"en", "de", "fr", "es", "und"}


def test_op3(spark, texts):
    for r in rows(spark, "op3_repetition_rules"):
        want = brute_repetition(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want[:5]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and want[5] <= 0.4 and want[6] <= 0.4 and want[7] <= 0.35 and want[8] <= 0.4)


def test_op4(spark):
    got = defaultdict(list)
    for r in rows(spark, "op4_cross_polytope_search"):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 100 = 0").count()
    assert len(got) == n and all(sorted(x for x, *_ in v) == list(range(1, 11)) for v in got.values())


def test_op6(spark, texts):
    want = brute(list(texts.items()), 4)
    got = rows(spark, "op6_minhash_near_dedup")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_op9(spark):
    got = rows(spark, "op9_wrapper_induction")
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert sorted(map(str, ((r["page_id"], r["url"]) for r in got))) == sorted(map(str, ((r["page_id"], r["url"]) for r in pages)))
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_op10(spark, texts):
    got = defaultdict(list)
    bins = defaultdict(list)
    for r in rows(spark, "op10_vector_best_fit"):
        got[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    encode = packing.Encoder(queries.TOKENIZER)
    for d, t in texts.items():
        ids = [*encode(t or ""), 0]
        at = 0
        for r in sorted(got[d], key=lambda r: r["piece"]):
            own = ids[at : at + r["length"]]
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)))
            at += r["length"]
        assert at == len(ids)
    for b in bins.values():
        assert sum(n for _, n in b) <= 2048
        assert all(o == sum(n for p, n in b if p < o) for o, _ in b)


def test_pipeline_stages(spark):
    """Each stage on the rows its predecessor kept, against the operator's own decision."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "minhash_near_dedup", "temperature_mixing", "best_fit_packing"]
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda d: Counter(r["doc_id"] for r in d.select("doc_id").collect())

    one = stage["language_id"](spark, docs, DATA)
    told = language.identify(docs, language.fit_languages(docs))
    assert ids(one) == ids(told.where("lang_pred <> 'und' and score >= 0.4"))
    two = stage["quality_classifier"](spark, one, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert ids(two) == ids(quality.score_quality(one, quality.fit_quality(one, labels)).where("predicted = 1"))
    three = stage["minhash_near_dedup"](spark, two, DATA)
    kept = brute([(r["doc_id"], r["text"]) for r in two.select("doc_id", "text").collect()], near_dedup.NearConfig().width)
    assert ids(three) == Counter(d for d, (_, c) in kept.items() if d == c)
    four = stage["temperature_mixing"](spark, three, DATA)
    assert set(ids(four)) <= set(ids(three))
    for d in (one, two, three, four):
        assert d.columns == docs.columns
    five = stage["best_fit_packing"](spark, four, DATA)
    assert ids(five.where("piece = 0")) == ids(four)


def test_pipeline_runs_whole(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).head()[0] <= 2048


def test_very_long_texts_repeats_and_clashes(spark):
    """One text of 600,000 words among nulls, empty and repeated rows, with columns named like results."""
    long = "The river runs past an old mill and on to the sea near the town. " * 40_000
    base = [(1, long), (1, long), (2, None), (3, ""), (None, "A short line of plain words."), (None, None), (4, "A short line of plain words.")]
    df = spark.createDataFrame(base, "doc_id long, text string")
    for c in ("score", "kept", "component_id", "n_words", "lang_pred", "sequence_id"):
        df = df.withColumn(c, F.lit("clash"))
    n = 15 * 40_000
    from cutline.llm import mixing, repetition

    got = repetition.repetition(df).collect()
    assert sorted((r["n_words"], r["base_failed"]) for r in got) == sorted([(n, True), (n, True), (0, True), (0, True), (0, True), (6, True), (6, True)])
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lang = language.identify(df, language.fit_languages(docs)).collect()
    assert sorted(r["lang_pred"] for r in lang) == ["en"] * 4 + ["und"] * 3
    model = quality.fit_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    score = quality.score_quality(df, model).collect()
    assert len(score) == 7 and len({r["score"] for r in score if r["doc_id"] == 1}) == 1
    near = near_dedup.near_components(df).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near) == Counter([(1, 15, 1), (1, 15, 1), (2, 0, 2), (3, 0, 3), (None, 2, 4), (None, 0, None), (4, 2, 4)])
    mixed = mixing.mix_sources(df.withColumn("source", F.lit("s")))
    assert mixed.columns == [*df.columns, "source"]
    packed = packing.pack_documents(df, queries.TOKENIZER, with_ids=False)
    assert packed.where("doc_id = 1").agg(F.sum("length")).head()[0] == 2 * (len(packing.Encoder(queries.TOKENIZER)(long)) + 1)
