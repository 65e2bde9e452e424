"""The pipeline drops what the classifier predicts as label 0."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np

from cutline.llm import quality


def test_keep_quality_decides_as_predicted(monkeypatch):
    monkeypatch.setattr(quality, "fit_quality", lambda *a: None)
    monkeypatch.setattr(quality, "_score_column", lambda *a: np.array([0.2, 0.3, 0.5, 0.69, 0.7, 0.9]))
    monkeypatch.setattr(quality, "keep_rows", lambda docs, column, keep: keep(None))
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda m: SimpleNamespace(value=m))))
    assert quality.keep_quality(docs, None).tolist() == [False, False, False, False, True, True]


def test_trainers_without_rows_do_not_dilute_the_weights(spark):
    """Two labelled texts reach one or two of four trainers; as many copies of them reach all four."""
    import numpy as np
    import pandas as pd

    from cutline.llm import quality

    fit = lambda ids: quality.fit_quality(
        spark.createDataFrame([(i, "good words of the river" if i % 2 else "BAD $$$ junk") for i in ids], "doc_id long, text string"),
        spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int"),
    )
    from zlib import crc32

    free = [i for i in range(400) if crc32(str(i).encode()) % 4 != 2]
    ones, twos = [i for i in free if i % 2], [i for i in free if not i % 2]
    few, many = fit([ones[0]]), fit([*ones[:40], *twos[:40]])
    assert np.abs(few.weights).max() > 0.05
    single = quality.ftrl(quality._vectors(pd.Series(["good words of the river"]), quality.QualityConfig()), np.array([1]), quality.QualityConfig())
    assert np.abs(few.weights).max() == np.abs(single[:-1].astype(np.float32)).max()
    assert np.isfinite(many.weights).all()


def test_a_repeated_id_is_learned_from_once(spark):
    from cutline.llm import language

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    one = docs.where("lang = 'en' AND crc32(cast(doc_id AS string)) % 4 <> 2").limit(1)
    hot = docs.unionByName(one.selectExpr("doc_id", "text", "lang", "explode(sequence(1, 3000)) n").drop("n"))
    a, b = language.fit_languages(docs), language.fit_languages(hot)
    assert all((x == y).all() if hasattr(x, "all") else x == y for x, y in zip(vars(a).values(), vars(b).values(), strict=True))
