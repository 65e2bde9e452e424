"""Where tables between steps go, and when a shared one is made anew."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from cutline.sources import staging


def test_a_cluster_needs_a_shared_folder():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.place(cluster, "x")


def test_a_changed_source_is_staged_again(spark, tmp_path):
    at = str(tmp_path)
    spark.range(3).write.parquet(f"{at}/t.parquet")
    made = []

    def build():
        made.append(1)
        return spark.read.parquet(f"{at}/t.parquet")

    assert staging.once(spark, "n", at, build).count() == staging.once(spark, "n", at, build).count() == 3 and len(made) == 1
    spark.range(5).write.mode("append").parquet(f"{at}/t.parquet")
    assert staging.once(spark, "n", at, build).count() == 8 and len(made) == 2
