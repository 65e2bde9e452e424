"""Boosted trees by histograms of gradients: counts under Poisson loss, labels under logistic loss, and squares.

Fields are cut into bins by exact quantiles, missing values the least bin of their own or filled by
medians beside a flag.  Gradients of rows that agree in all bins depend on their number and their label's sum only, so
rows are added up by bins once and trees grow on those cells: however many rows there are, a level
of a tree is one scan of the cells, in which every task adds up gradient, Hessian and rows by (node, field,
bin), and only those sums and the chosen splits reach the driver: at most 2^depth * fields * bins numbers a task.
Margins of the trees so far are written every ``refresh`` trees, so a scan evaluates few of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import staging
from ..sources.ship import ship_package
from . import metrics


@dataclass(frozen=True)
class BoostConfig:
    trees: int = 160
    rate: float = 0.035
    depth: int = 3
    leaves: int = 7
    least_rows: int = 60
    l2: float = 4.0
    bins: int = 64
    refresh: int = 20


#: Values that differ by less, as a share, are equal: sums of one thing in another order.
SAME = 1e-12


@dataclass
class Tree:
    """split[node] is (field, greatest bin that goes left); nodes 2 i + 1 and 2 i + 2 follow node i; value[node] is a leaf's."""

    split: dict[int, tuple[int, int]] = field(default_factory=dict)
    gain: dict[int, float] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node of each row, as far as there are splits."""
        at = np.zeros(len(bins), np.int64)
        for node in sorted(self.split):
            f, cut = self.split[node]
            own = at == node
            at[own] = 2 * node + 1 + (bins[own, f] > cut)
        return at

    def margins(self, bins: np.ndarray) -> np.ndarray:
        most = max(self.value) + 1
        table = np.zeros(most)
        table[list(self.value)] = list(self.value.values())
        return table[self.nodes(bins)]


@dataclass
class CountTrees:
    fields: list[str]
    cuts: list[list[float]]
    start: float
    trees: list[Tree]
    medians: list[float] | None = None

    @property
    def names(self) -> list[str]:
        """What is cut into bins: the fields, and their flags where they are filled."""
        return self.fields if self.medians is None else [*self.fields, *(f"{f}__missing" for f in self.fields)]

    def margin(self) -> Column:
        """The sum of the trees as a column of the fields."""
        fields, cuts, start, trees, medians = self.fields, self.cuts, self.start, self.trees, self.medians

        @F.arrow_udf("double")
        def run(*cols: pa.Array) -> pa.Array:
            bins = codes(cols, cuts, medians)
            return pa.array(start + sum((t.margins(bins) for t in trees), np.zeros(len(bins))))

        return run(*(F.col(f).cast("double") for f in fields))

    def mean(self) -> Column:
        """The expected count as a column."""
        return F.exp(self.margin())

    def gains(self) -> dict[str, float]:
        """Total gain of the splits on each field."""
        out = dict.fromkeys(self.names, 0.0)
        for t in self.trees:
            for node, (f, _) in t.split.items():
                out[self.names[f]] += t.gain[node]
        return out


def quantile_cuts(df: DataFrame, fields: list[str], bins: int) -> list[list[float]]:
    """Distinct values at the positions floor(q (n - 1)) of each field, q = 1/bins to 1 - 1/bins; exact, by counts in bands."""
    ship_package(df.sparkSession)
    at = lambda n: [math.floor((n - 1) * (b / bins)) for b in range(1, bins)]
    found = metrics.order_statistics(df, fields, at)
    return [_distinct(sorted(set(found.get((0, i), {}).values()))) for i in range(len(fields))]


def _distinct(values: list[float]) -> list[float]:
    out: list[float] = []
    for x in values:
        if not out or x > out[-1] + SAME * abs(out[-1]):
            out.append(x)
    return out


def codes(cols: Sequence[pa.Array], cuts: list[list[float]], medians: list[float] | None) -> np.ndarray:
    """The bins of rows: 0 missing, then 1 + cuts below the value; with medians cuts below the filled value, then the flags."""
    out, flags = [], []
    for i, (col, c) in enumerate(zip(cols, cuts, strict=True)):
        gap, c = np.asarray(col.is_null()), np.asarray(c, float)
        x = col.to_numpy(zero_copy_only=False).astype(float)
        below = np.searchsorted(c + SAME * np.abs(c), np.where(gap, medians[i] if medians else 0.0, x), side="left")
        out.append(np.where(gap, 0, 1 + below) if medians is None else below)
        flags.append(gap.astype(np.int64))
    return np.column_stack(out if medians is None else [*out, *flags]).astype(np.int32)


def cells(df: DataFrame, fields: list[str], labels: list[str], cuts: list[list[float]], medians: list[float] | None = None) -> DataFrame:
    """bins, and for each label {label}_n, its rows, and {label}_s, their sum: one row for all rows of the same bins, written once."""
    ship_package(df.sparkSession)
    width = len(fields) * (1 if medians is None else 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = codes([batch.column(f) for f in fields], cuts, medians)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bins.size + 1, width, np.int32)), pa.array(bins.ravel()))
            yield pa.RecordBatch.from_arrays([flat, *(batch.column(f"_l{i}") for i in range(len(labels)))], ["bins", *(f"_l{i}" for i in range(len(labels)))])

    rows = df.select(*(F.col(f).cast("double").alias(f) for f in fields), *(F.col(y).cast("double").alias(f"_l{i}") for i, y in enumerate(labels)))
    made = rows.mapInArrow(run, "bins array<int>, " + ", ".join(f"_l{i} double" for i in range(len(labels))))
    sums = [c for i, y in enumerate(labels) for c in (F.count(f"_l{i}").cast("double").alias(f"{y}_n"), F.coalesce(F.sum(f"_l{i}"), F.lit(0.0)).alias(f"{y}_s"))]
    return staging.stage(made.groupBy("bins").agg(*sums), "boost")


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return batch.column("bins").flatten().to_numpy().reshape(-1, n)


def _gradients(loss: str, margin: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradient and Hessian over the n rows of each cell, whose labels sum to s.

    logistic and squares are those of Spark's boosted trees: labels of plus and minus one under 2 log(1 + exp(-2 y f)), and
    squares of the difference; a leaf is the mean of the negative gradient, so rows stand for the Hessian.
    """
    if loss == "poisson":
        mu = np.exp(margin) * n
        return mu - s, mu
    if loss == "logistic":
        return 4 * (n - s) / (1 + np.exp(-2 * margin)) - 4 * s / (1 + np.exp(2 * margin)), n
    return 2 * (margin * n - s), n


def _histogram(rows: DataFrame, model: CountTrees, done: int, tree: Tree, level: list[int], cfg: BoostConfig, loss: str) -> np.ndarray:
    """(node, field, bin, gradient | Hessian | rows) of a level's nodes."""
    n, width = len(model.names), cfg.bins + 1
    recent, start, slot = model.trees[done:], model.start, {x: i for i, x in enumerate(level)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(level) * n * width))
        for batch in batches:
            bins = _matrix(batch, n)
            margin = start + batch.column("_m").to_numpy() + sum((t.margins(bins) for t in recent), np.zeros(len(bins)))
            count = batch.column("_n").to_numpy()
            g, hess = _gradients(loss, margin, count, batch.column("_y").to_numpy())
            at = tree.nodes(bins)
            where = np.array([slot.get(int(x), -1) for x in range(int(at.max(initial=0)) + 1)])[at]
            own = where >= 0
            for f in range(n):
                key = (where[own] * n + f) * width + bins[own, f]
                for k, v in enumerate((g, hess, count)):
                    total[k] += np.bincount(key, v[own], total.shape[1])
        some = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(t)) for x, t in ((some, pa.int64()), *((total[k][some], pa.float64()) for k in range(3)))], ["i", "g", "h", "n"])

    out = np.zeros((len(level) * n * width, 3))
    for r in rows.mapInArrow(run, "i array<long>, g array<double>, h array<double>, n array<double>").collect():  # one row a task
        np.add.at(out, np.array(r["i"], np.int64), np.array([r["g"], r["h"], r["n"]]).reshape(3, -1).T)
    return out.reshape(len(level), n, width, 3)


def best_split(h: np.ndarray, cfg: BoostConfig) -> tuple[float, int, int] | None:
    """(gain, field, bin) of a node's histogram: the greatest gain to nine digits, of the first field and bin that have it."""
    left = np.cumsum(h, axis=1)
    whole = left[:, -1:]
    right = whole - left
    score = lambda x: np.divide(x[..., 0] ** 2, x[..., 1] + cfg.l2, out=np.zeros(x.shape[:-1]), where=x[..., 1] + cfg.l2 > 0)
    gain = np.round(score(left) + score(right) - score(whole), 9)
    gain[(left[..., 2] < cfg.least_rows) | (right[..., 2] < cfg.least_rows)] = -np.inf
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > 0 else None


def fit_counts(df: DataFrame, fields: list[str], label: str, cfg: BoostConfig = BoostConfig()) -> CountTrees:
    """Trees of a count under Poisson loss; rows without a label are left out.

    Trees grow by level; where a full level has more than cfg.leaves leaves, the splits of least gain on
    it are taken back.  A table without rows, or a label that is zero throughout, gives a constant.
    """
    cuts = quantile_cuts(df.where(F.col(label).isNotNull()), fields, cfg.bins)
    rows = cells(df.where(F.col(label).isNotNull()), fields, [label], cuts)
    whole = rows.agg(F.sum(f"{label}_s") / F.nullif(F.sum(f"{label}_n"), F.lit(0.0))).head()[0] or 1e-9
    return _grow(rows, label, CountTrees(fields, cuts, float(np.log(whole)), []), cfg, "poisson")


def fit_cells(rows: DataFrame, fields: list[str], label: str, cuts: list[list[float]], medians: list[float], cfg: BoostConfig, loss: str) -> CountTrees:
    """Trees as Spark's own boosting grows them, on cells: the first is fitted to the label itself, the others to gradients at cfg.rate.

    loss: logistic or squares.  Every tree counts, one without a split too.
    """
    return _grow(rows, label, CountTrees(fields, cuts, 0.0, [], medians), cfg, loss)


def _grow(rows: DataFrame, label: str, model: CountTrees, cfg: BoostConfig, loss: str) -> CountTrees:
    rows = rows.where(F.col(f"{label}_n") > 0).select("bins", F.col(f"{label}_n").alias("_n"), F.col(f"{label}_s").alias("_y"), F.lit(0.0).alias("_m"))
    done = 0
    for round_ in range(cfg.trees):
        # Half of the gradient at zero is the label: so the first tree of the other losses.
        rate = 0.5 if loss != "poisson" and not round_ else cfg.rate
        leaf = lambda part, rate=rate: -rate * part[0] / (part[1] + cfg.l2) if part[1] + cfg.l2 > 0 else 0.0
        tree, level = Tree(), [0]
        for depth in range(cfg.depth):
            hist = _histogram(rows, model, done, tree, level, cfg, loss)
            for i, node in enumerate(level):
                tree.value[node] = leaf(hist[i, 0].sum(0))
            found = {node: s for i, node in enumerate(level) if (s := best_split(hist[i], cfg))}
            room = cfg.leaves - len(tree.value) if depth else cfg.leaves - 1
            kept = sorted(found, key=lambda x: (-found[x][0], x))[: max(room, 0)]
            for node in kept:
                gain, f, b = found[node]
                tree.split[node], tree.gain[node] = (f, b), gain / 4 if loss != "poisson" and not round_ else gain
                own = hist[level.index(node), f]
                del tree.value[node]
                for child, part in ((2 * node + 1, own[: b + 1].sum(0)), (2 * node + 2, own[b + 1 :].sum(0))):
                    tree.value[child] = leaf(part)
            level = [c for node in kept for c in (2 * node + 1, 2 * node + 2)]
            if not level:
                break
        if not tree.split and loss == "poisson":
            break
        model.trees.append(tree)
        if len(model.trees) - done >= cfg.refresh and len(model.trees) < cfg.trees:
            rows, done = _refreshed(rows, model, done), len(model.trees)
    return model


def _refreshed(rows: DataFrame, model: CountTrees, done: int) -> DataFrame:
    """rows with the margins of all trees, written."""
    n, recent = len(model.names), model.trees[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _matrix(batch, n)
            margin = batch.column("_m").to_numpy() + sum((t.margins(bins) for t in recent), np.zeros(len(bins)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bins", "_n", "_y")), pa.array(margin)], ["bins", "_n", "_y", "_m"])

    return staging.stage(rows.mapInArrow(run, rows.schema), "boost")
