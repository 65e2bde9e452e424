"""Columns named like the operators' own helpers, empty tables and null texts, through operators and pipeline."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cutline.llm import chat, language, mixing, near_dedup, quality, sharding

DATA = "/root/testdata/sf0.001"


def helpers(module):
    """Every name that the operator's source could use for a column."""
    text = Path(module.__file__).read_text()
    names = set(re.findall(r"""["']([A-Za-z_][A-Za-z0-9_]{1,20})["']""", text)) | set(re.findall(r"""["'](_[a-z0-9_]+)["']""", text))
    names |= {w for line in re.findall(r'"([a-z_0-9]+ (?:int|long|string|double|binary|boolean)[^"]*)"', text) for w in re.findall(r"([a-z_0-9]+) (?:int|long|string|double|binary|boolean)", line)}
    return sorted(names - {"doc_id", "text", "source", "lang", "n_chars", "left", "inner", "long", "string"})


def rows(spark):
    line = "The river runs past an old mill and on to the sea near the town where {} people live. "
    data = [(i, " ".join(line.format(i % 3) for _ in range(3)), "en", f"s{i % 2}") for i in range(30)] + [(40, None, None, None), (41, "", "en", "s0"), (None, "a b c", None, "s1"), (None, None, None, None)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(3)


def clashing(df, module):
    for i, c in enumerate(helpers(module)):
        df = df.withColumn(c, F.concat(F.lit(f"{i}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return df


def counted(df):
    return Counter(tuple(sorted((c, str(r[c])) for c in df.columns)) for r in df.collect())


@pytest.mark.parametrize("module", [near_dedup, mixing, sharding])
def test_every_helper_name_is_carried(spark, module):
    run = {
        near_dedup: near_dedup.near_dedup, mixing: lambda d: mixing.mix_sources(d, epoch_col="epoch_"),
        sharding: lambda d: sharding.assign_shards(d, "doc_id", 3, tie_break=[F.xxhash64("text")], names=("shard_", "slot_")),
    }[module]
    plain = rows(spark)
    more = clashing(plain, module)
    got, want = run(more), run(plain)
    assert [c for c in got.columns if c in more.columns] == more.columns
    assert counted(got.select(want.columns)) == counted(want)
    extra = helpers(module)
    assert len(extra) > 10
    for r in got.collect():
        assert all(r[c] == f"{i}-{'none' if r['doc_id'] is None else r['doc_id']}" for i, c in enumerate(extra))


def test_broadcast_and_join_leave_out_the_same_rows(spark):
    df = rows(spark)
    a, b = near_dedup.near_dedup(df), near_dedup.near_dedup(df, near_dedup.NearConfig(broadcast_rows=0))
    assert counted(a) == counted(b) and a.count() < df.count()


def test_filters_and_stages_on_empty_null_and_clashing_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = language.fit_languages(docs)
    odd = docs.limit(20).unionByName(spark.createDataFrame([(9_000, None, None, None, None), (9_001, "", "en", "s", 0), (None, "x", None, None, 1)], docs.schema)).withColumn("score", F.lit("kept")).withColumn("_row", F.lit(1))
    for out in (language.keep_language(odd, model=model), quality.keep_quality(odd, labels)):
        assert out.columns == odd.columns and not {r["doc_id"] for r in out.collect()} & {9_000}
        assert all(r["score"] == "kept" for r in out.collect())
    none = docs.limit(0)
    assert language.keep_language(none).count() == 0 and quality.keep_quality(none, labels).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0
    nulls = docs.limit(4).withColumn("text", F.lit(None).cast("string"))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, nulls, DATA).count()


def test_pipeline_runs_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_very_long_turn_and_an_empty_conversation_table(spark):
    long = "word <|im_end|> \\ " * 60_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1)).withColumn("t", F.lit(2))
    (row,) = chat.digest(chat.expand(df)).collect()
    assert (row["n_turns"], row["loss_chars"]) == (2, len(long))
    assert chat.digest(chat.expand(df.limit(0))).count() == 0
