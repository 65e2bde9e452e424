"""Language, repetition and quality: brute force, held-out accuracy, edges."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.llm import language, quality, repetition
from cutline.llm import textops as T

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_words_and_windows():
    import pyarrow as pa

    texts = ["a bb  ccc", "", None, " x\ty\x0bz", "one", "w" * 700 + " w" + "w" * 699]
    buf, off = T.utf8(pa.array(texts).slice(0, 6))
    w = T.split_words(buf, off)
    assert w.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    h = T.span_hashes(buf, w.start, w.end)
    assert h[-1] == h[-2]
    x, begin = T.windows(h, w.first, 2, short=True)
    assert np.diff(begin).tolist() == [2, 0, 0, 2, 1, 1]


def path_score(scores, labels, penalty):
    return sum(scores[t, s] for t, s in enumerate(labels)) - penalty * sum(a != b for a, b in zip(labels[:-1], labels[1:], strict=True))


def test_viterbi_is_optimal():
    import itertools

    rng = np.random.default_rng(2)
    scores = rng.normal(size=(13, 3)).astype(np.float32)
    first = np.array([0, 6, 6, 13])
    got = language.viterbi(scores, first, 1.5)
    for a, b in ((0, 6), (6, 13)):
        best = max(path_score(scores[a:b], p, 1.5) for p in itertools.product(range(3), repeat=b - a))
        assert path_score(scores[a:b], got[a:b], 1.5) == pytest.approx(best, abs=1e-4)


def test_language_held_out_accuracy_and_spans(spark, documents):
    model = language.fit_languages(documents)
    got = language.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in got if held(r["doc_id"])]
    assert sum(r["lang_pred"] == r["lang"] for r in test) / len(test) > 0.95
    en, de = (documents.where(F.col("lang") == x).orderBy(F.desc("n_chars")).head()["text"][:600] for x in ("en", "de"))
    mixed = spark.createDataFrame([(1, en + " " + de), (2, None), (3, "123 !?"), (4, ""), (None, en)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in language.identify(mixed, model).collect()}
    assert [s["lang"] for s in rows[1]["spans"]] == ["en", "de"]
    assert abs(rows[1]["spans"][0]["end"] - len(en.encode())) < 40
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 and rows[i]["spans"] == [] for i in (2, 3, 4))
    assert rows[None]["lang_pred"] == "en"
    kept = language.keep_language(mixed.withColumn("score", F.lit("clash")), model=model)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1]


def test_language_without_anything_to_learn(spark):
    df = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert language.fit_languages(df) is None
    assert language.identify(df, None).head()["lang_pred"] == "und"
    assert language.identify(df.limit(0), None).count() == 0


def test_scripts_narrow_candidates(spark):
    rows = [(i, t, g) for i in range(40) for t, g in ((f"the cat sat on a mat {i}", "en"), (f"кот сидел на окне {i}", "ru"))]
    df = spark.createDataFrame([(2 * i + j, t, g) for i, (j, t, g) in enumerate(((k % 2, t, g) for k, (_, t, g) in enumerate(rows)))], "doc_id long, text string, lang string")
    model = language.fit_languages(df)
    cyr = model.allowed[language._NAMES.index("Cyrillic")]
    assert dict(zip(model.langs, cyr.tolist(), strict=True)) == {"en": False, "ru": True}
    assert language.identify(spark.createDataFrame([(1, "неведомое")], "doc_id long, text string"), model).head()["lang_pred"] == "ru"


def brute_repetition(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]

    def cover(n):
        c = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        return {j for i in range(len(words) - n + 1) if c[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}

    chars = sum(map(len, words))
    share = lambda n: sum(len(words[j]) for j in cover(n)) / max(chars, 1)
    seen, dup, dup_chars = set(), 0, 0
    for x in lines:
        if x in seen:
            dup += 1
            dup_chars += sum(map(len, WORD.findall(x)))
        seen.add(x)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, len(cover(3)), share(5), share(8), share(12), dup_chars / max(chars, 1)


def test_repetition_equals_brute_force(spark, documents):
    extra = [(10**6, "a b c a b c\na b c a b c\n\n  \na b c"), (10**6 + 1, None), (10**6 + 2, ""), (10**6 + 3, "x\x1cy é é é é\n"), (10**6 + 4, "w " * 300), (10**6 + 5, "\n\n"), (10**6 + 6, "one line\rtwo\none line\rtwo\n")]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cover_5", "cover_8", "cover_12", "cover_lines"]
    for r in repetition.repetition(df).collect():
        want = brute_repetition(text[r["doc_id"]])
        assert [r[n] for n in names] == pytest.approx(list(want)), r["doc_id"]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert repetition.repetition(df.limit(0)).count() == 0


def test_quality_held_out(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    cfg = quality.QualityConfig()
    model = quality.fit_quality(documents, labels, cfg)
    got = quality.score_quality(documents, model, cfg).join(labels, "doc_id").collect()
    test = [(r["score"], r["quality"]) for r in got if held(r["doc_id"])]
    good, bad = [s for s, q in test if q == 1], [s for s, q in test if q == 0]
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good]) > 0.9
    again = quality.fit_quality(documents.repartition(3), labels.repartition(2), cfg)
    assert np.allclose(model.weights, again.weights)


def test_quality_scores_are_sparse_dot_products(spark):
    """The batched score equals the dot product with the vector that training uses."""
    import pandas as pd
    import pyarrow as pa

    cfg = quality.QualityConfig(bits=10)
    rng = np.random.default_rng(0)
    model = quality.QualityModel(rng.normal(size=1024).astype(np.float32), 0.3)
    texts = ["One two, THREE three!!", "", "x", "é é é ##"]
    buf, off = T.utf8(pa.array(texts))
    w = np.append(model.weights, 0.3)
    want = [1 / (1 + np.exp(-(w[i] @ x))) for i, x in quality._vectors(pd.Series(texts), cfg)]
    assert quality.scores(buf, off, model, cfg) == pytest.approx(want, abs=1e-6)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "a b", "x"), (None, "a", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    assert [r["score"] for r in quality.score_quality(docs, model).collect()] == [0.5] * 3
    assert quality.keep_quality(docs, labels).columns == docs.columns
    assert quality.score_quality(docs.limit(0), model).count() == 0
