"""The models' fixed configurations."""

from __future__ import annotations

from cutline.operators import models
from cutline.plans import q_models


def test_trees_take_every_configuration_as_it_is(spark, monkeypatch):
    real, asked = models.fit_trees, []

    def one_tree(df, numeric, label, **how):
        asked.append((label, how.get("config"), how.get("trees")))
        return real(df, numeric, label, **how | {"trees": 1})

    monkeypatch.setattr(models, "fit_trees", one_tree)
    assert sorted(r["config"] for r in q_models.trees_forward(spark, "/root/testdata/sf0.001").collect()) == [0, 1, 2]
    assert sorted(asked) == sorted((y, k, None) for y in ("label", "tds") for k in range(3))
    asked.clear()
    assert {r["config"] for r in q_models.importance(spark, "/root/testdata/sf0.001").collect()} == {0, 1, 2}
    assert asked == [("label", k, None) for k in range(3)]
