"""Generalised linear models for many groups, season prefixes and families of fields at once.

Every model is fitted by Newton's method, and one scan of the rows serves a step of all
of them: a task adds up X'WX, X'r and the loss of each model over its rows, Spark adds up the
tasks, and the driver solves systems of a few unknowns.  So the number of scans is that of
the slowest model's steps, whatever the number of models.  A step that does not lower a
model's loss is halved.  Fields are imputed by medians, flagged and scaled as their
own model's rows tell; medians are exact and found in bands, never on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import staging
from ..sources.ship import ship_package
from . import metrics

@dataclass(frozen=True)
class Spec:
    """families: name to numeric fields.  by: a model for each group of it.  uptos: a model for each, of the seasons up to it.

    link: logistic or poisson.  ridge: weight of half the squared coefficients, beside the sum of the losses (logistic)
    or their mean (poisson); the intercept is free.  Groups with fewer rows or positives are not fitted.
    """

    families: dict[str, list[str]]
    label: str
    categorical: tuple[str, ...] = ()
    by: str | None = None
    season: str | None = None
    uptos: tuple[int, ...] = ()
    link: str = "logistic"
    ridge: float = 1.0
    min_rows: int = 1
    min_positives: int = 0
    steps: int = 60
    tolerance: float = 1e-9
    most_models: int = 5_000

    @property
    def numeric(self) -> list[str]:
        return sorted({f for fs in self.families.values() for f in fs})


@dataclass
class Model:
    """One model: its group, last season, family, and coefficients of (1, scaled fields, scaled flags, categories)."""

    cell: int
    group: object
    upto: int | None
    family: str
    rows: int
    beta: np.ndarray
    best: float = np.inf
    step: np.ndarray | None = None
    moments: tuple[np.ndarray, np.ndarray] | None = None
    done: bool = False


@dataclass
class Fitted:
    spec: Spec
    models: list[Model]
    levels: dict[str, list[str]]
    medians: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    scans: int = 0
    refused: set = field(default_factory=set)

    def terms(self, family: str) -> list[str]:
        fs = self.spec.families[family]
        return ["intercept", *fs, *(f"{f}__missing" for f in fs), *(f"{c}={x}" for c in self.spec.categorical for x in self.levels[c])]

    def table(self, df: DataFrame) -> DataFrame:
        """grp, upto, family, term and coefficient, on the scaled fields."""
        rows = [(None if m.group is None else str(m.group), m.upto, m.family, t, float(b)) for m in self.models for t, b in zip(self.terms(m.family), m.beta, strict=True)]
        return df.sparkSession.createDataFrame(rows, "grp string, upto long, family string, term string, coefficient double")

    def score(self, df: DataFrame, family: str, out: str) -> DataFrame:
        """df with the chance or mean of the model of its group and of the seasons before its own; null where there is none.

        The models join as a broadcast table of at most most_models rows.
        """
        s, fs = self.spec, self.spec.families[family]
        names = s.numeric
        at = [names.index(f) for f in fs]
        own = [m for m in self.models if m.family == family]
        rows = []
        for m in own:
            scale = lambda x: np.divide(1.0, x, out=np.zeros_like(x), where=x > 0)
            cols = [*at, *(len(names) + i for i in at)]
            rows.append((None if m.group is None else str(m.group), m.upto, m.beta.tolist(), self.medians[m.cell][at].tolist(), self.means[m.cell][cols].tolist(), scale(self.deviations[m.cell][cols]).tolist()))
        models = df.sparkSession.createDataFrame(rows, "_grp string, _upto long, _b array<double>, _med array<double>, _mean array<double>, _inv array<double>")
        key = F.lit(True)
        if s.by:
            key = key & (F.col(s.by).cast("string") == F.col("_grp"))
        if s.uptos:
            last = F.greatest(*(F.when(F.col(s.season) > u, F.lit(u)) for u in s.uptos), F.lit(None).cast("int")) if len(s.uptos) > 1 else F.when(F.col(s.season) > s.uptos[0], F.lit(s.uptos[0]))
            key = key & (last == F.col("_upto"))
        joined = df.join(F.broadcast(models), key, "left")
        eta = F.col("_b")[0]
        k = len(fs)
        for i, f in enumerate(fs):
            eta = eta + F.col("_b")[1 + i] * (F.coalesce(F.col(f).cast("double"), F.col("_med")[i]) - F.col("_mean")[i]) * F.col("_inv")[i]
            eta = eta + F.col("_b")[1 + k + i] * (F.col(f).isNull().cast("double") - F.col("_mean")[k + i]) * F.col("_inv")[k + i]
        j = 1 + 2 * k
        for c in s.categorical:
            for x in self.levels[c]:
                eta = eta + F.col("_b")[j] * (F.coalesce(F.col(c), F.lit("Unknown")) == x).cast("double")
                j += 1
        value = 1 / (1 + F.exp(-eta)) if s.link == "logistic" else F.exp(eta)
        return joined.withColumn(out, value).drop("_grp", "_upto", "_b", "_med", "_mean", "_inv")


def _medians(rows: DataFrame, fields: list[str], cells: list[tuple[object, int | None]]) -> dict[tuple[int, str], float]:
    """The median of every cell and field with a value: the middle one, or the mean of the middle two."""
    found = metrics.order_statistics(rows, fields, lambda n: [(n - 1) // 2, n // 2], lambda batch: _members(batch, cells), len(cells))
    return {(i, fields[j]): (min(v.values()) + max(v.values())) / 2 for (i, j), v in found.items()}


def prefix_medians(rows: DataFrame, fields: list[str], cells: DataFrame) -> DataFrame:
    """(cell, field, median) of every cell and field with a value.

    rows: _g, _s and the fields.  cells: cell, _g (null: any) and _upto (null: any); a cell holds the rows of its group up to its season.
    """
    told = cells.collect()  # one row a model
    found = _medians(rows, fields, [(c["_g"], c["_upto"]) for c in told])
    return rows.sparkSession.createDataFrame([(told[i]["cell"], f, float(m)) for (i, f), m in found.items()], "cell int, field string, median double")


def _columns(batch: pa.RecordBatch, spec: Spec, levels: dict[str, list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers with NaN for null, one-hot categories, and labels."""
    n = batch.num_rows
    num = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in spec.numeric]) if spec.numeric else np.empty((n, 0))
    hot = [np.asarray(batch.column(c)) == x for c in spec.categorical for x in levels[c]]
    return num, np.column_stack(hot).astype(float) if hot else np.empty((n, 0)), batch.column("_y").to_numpy(zero_copy_only=False).astype(float)


def _sums(rows: DataFrame, width: int, run) -> dict[int, np.ndarray]:
    """Sums over all tasks of the arrays that run yields by model or cell."""
    t = rows.mapInArrow(run, "id int, v array<double>").groupBy("id").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(width))).alias("v"))
    return {r["id"]: np.array(r["v"]) for r in t.collect()}


def _emit(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["id", "v"])


def _members(batch: pa.RecordBatch, cells: list[tuple[object, int | None]]) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, its rows in the batch) for cells that have some."""
    g, s = np.asarray(batch.column("_g")), batch.column("_s").to_numpy(zero_copy_only=False)
    for i, (group, upto) in enumerate(cells):
        own = np.ones(batch.num_rows, bool) if group is None else g == group
        own = own if upto is None else own & (s <= upto)
        if own.any():
            yield i, np.flatnonzero(own)


def fit(df: DataFrame, spec: Spec) -> Fitted:
    """All models of the spec on df.  Rows without a label are left out, null categories are Unknown; a null group or season is in no model.

    A field without any value in a model is 0 there, as its flag tells, and constant columns get no weight.
    """
    spark = df.sparkSession
    ship_package(spark)
    cols = [(F.col(spec.by).cast("string") if spec.by else F.lit("")).alias("_g"), (F.col(spec.season) if spec.uptos else F.lit(0)).cast("long").alias("_s"), F.col(spec.label).cast("double").alias("_y")]
    rows = df.select(*cols, *(F.col(f).cast("double").alias(f) for f in spec.numeric), *(F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c) for c in spec.categorical))
    rows = staging.stage(rows.where("_y IS NOT NULL AND _g IS NOT NULL AND _s IS NOT NULL"), "newton")

    sizes: dict[tuple, tuple[int, float]] = {}
    uptos = spec.uptos or (None,)
    counted = rows.groupBy("_g", "_s").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("y")).limit(spec.most_models * 8 + 1).collect()
    if len(counted) > spec.most_models * 8:
        raise ValueError("more groups and seasons than models that may be fitted at once")
    for r in counted:
        for u in uptos:
            if u is None or r["_s"] <= u:
                n, y = sizes.get((r["_g"], u), (0, 0.0))
                sizes[r["_g"], u] = (n + r["n"], y + r["y"])
    fine = sorted(k for k, (n, y) in sizes.items() if n >= spec.min_rows and y >= spec.min_positives)
    if len(fine) * len(spec.families) > spec.most_models:
        raise ValueError(f"{len(fine) * len(spec.families)} models; most_models is {spec.most_models}")
    cells = [(g if spec.by else None, u) for g, u in fine]
    levels = {c: sorted(r[0] for r in rows.select(c).distinct().limit(1_001).collect()) for c in spec.categorical}
    if any(len(x) > 1_000 for x in levels.values()):
        raise ValueError("a category of more than 1,000 values")
    k = len(spec.numeric)
    out = Fitted(spec, [], levels, np.zeros((len(cells), k)), np.zeros((len(cells), 2 * k)), np.zeros((len(cells), 2 * k)), refused={g for g, _ in sizes if all((g, u) not in set(fine) for u in uptos)})
    if not cells:
        return out
    if k:
        for (i, f), m in _medians(rows, spec.numeric, cells).items():
            out.medians[i, spec.numeric.index(f)] = m
    medians = out.medians

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums and squares of every column, less the median."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            num = _columns(batch, spec, levels)[0]
            for i, own in _members(batch, cells):
                gap = np.isnan(num[own])
                x = np.column_stack([np.where(gap, 0.0, num[own] - medians[i]), gap])
                total[i] = total.get(i, 0.0) + np.concatenate([x.sum(0), (x * x).sum(0)])
        yield from _emit(total)

    for i, v in (_sums(rows, 4 * k, spread) if k else {}).items():
        n = sizes[fine[i]][0]
        mean = v[: 2 * k] / n
        out.means[i] = mean + np.concatenate([medians[i], np.zeros(k)])
        out.deviations[i] = np.sqrt(np.maximum(v[2 * k :] - n * mean * mean, 0) / max(n - 1, 1))
        out.deviations[i][out.deviations[i] < 1e-12 * (1 + np.abs(out.means[i]))] = 0.0

    for i, (g, u) in enumerate(cells):
        n, y = sizes[fine[i]]
        share = min(max(y / n, 1e-6), 1 - 1e-6) if spec.link == "logistic" else max(y / n, 1e-6)
        for name in spec.families:
            beta = np.zeros(len(out.terms(name)))
            beta[0] = np.log(share / (1 - share)) if spec.link == "logistic" else np.log(share)
            out.models.append(Model(i, g, u, name, n, beta))
    _newton(rows, out, cells)
    return out


def _newton(rows: DataFrame, out: Fitted, cells: list[tuple[object, int | None]]) -> None:
    spec, levels, k = out.spec, out.levels, len(out.spec.numeric)
    most = max(len(m.beta) for m in out.models)
    width = most * most + most + 1
    medians, means, inverse = out.medians, out.means, np.divide(1.0, out.deviations, out=np.zeros_like(out.deviations), where=out.deviations > 0)
    pick = {name: [spec.numeric.index(f) for f in fs] for name, fs in spec.families.items()}
    logistic = spec.link == "logistic"
    while live := [(j, m) for j, m in enumerate(out.models) if not m.done]:
        if out.scans >= spec.steps:
            raise RuntimeError(f"{len(live)} models did not converge in {spec.steps} steps")
        by_cell: dict[int, list[tuple[int, list[int], np.ndarray]]] = {}
        for j, m in live:
            by_cell.setdefault(m.cell, []).append((j, pick[m.family], m.beta if m.step is None else m.beta + m.step))

        def moments(batches: Iterator[pa.RecordBatch], by_cell=by_cell) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                num, hot, y = _columns(batch, spec, levels)
                for i, own in _members(batch, cells):
                    if i not in by_cell:
                        continue
                    gap = np.isnan(num[own])
                    scaled = (np.column_stack([np.where(gap, medians[i], num[own]), gap]) - means[i]) * inverse[i]
                    for j, at, beta in by_cell[i]:
                        x = np.column_stack([np.ones(len(own)), scaled[:, [*at, *(k + a for a in at)]], hot[own]])
                        eta, t = x @ beta, y[own]
                        if logistic:
                            p = 1 / (1 + np.exp(-eta))
                            weight, loss = p * (1 - p), np.sum(np.logaddexp(0, eta) - t * eta)
                        else:
                            p = np.exp(np.minimum(eta, 50.0))
                            weight, loss = p, np.sum(p - t * eta)
                        v = np.zeros(width)
                        n = len(beta)
                        v[: n * n] = (x.T @ (x * weight[:, None])).ravel()
                        v[most * most : most * most + n] = x.T @ (t - p)
                        v[-1] = loss
                        total[j] = total.get(j, 0.0) + v
            yield from _emit(total)

        got = _sums(rows, width, moments)
        out.scans += 1
        for j, m in live:
            n = len(m.beta)
            tried = m.beta if m.step is None else m.beta + m.step
            h, g, loss = got[j][: n * n].reshape(n, n), got[j][most * most : most * most + n], got[j][-1]
            ridge = np.diag([0.0, *[spec.ridge * (1 if logistic else m.rows)] * (n - 1)])
            loss += 0.5 * tried @ ridge @ tried
            if m.step is None or loss <= m.best + 1e-12 * abs(m.best):
                m.beta, m.best = tried, loss
                m.step = np.linalg.lstsq(h + ridge, g - ridge @ tried, rcond=None)[0]
            else:
                m.step = m.step / 2
            m.done = bool(np.abs(m.step).max() < spec.tolerance)
