"""Season-forward models on Spark ML, calibration, allocation and diagnostics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..sources.ship import ship_package
from . import boosting, metrics, newton

#: (trees, rate, depth, least rows of a leaf): fixed configurations of the challengers.
TREES = [(100, 0.03, 3, 120), (140, 0.025, 3, 100), (120, 0.03, 4, 80)]


def encode(numeric: list[str], medians: dict[str, float], categorical: list[str] = (), scale: bool = True) -> Pipeline:
    """Median impute, missing flags, one-hot categories, scale: one features vector.

    Medians are constants of the pipeline.  Flags are plain columns made by with_flags; a column that never lacks a value gives a
    constant flag that the scaler sets to zero.
    """
    filled = ", ".join(f"coalesce(`{c}`, {medians[c]!r}D) AS `{c}__i`" for c in numeric)
    steps: list = [SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")]
    for c in categorical:
        steps.append(StringIndexer(inputCol=c, outputCol=f"{c}__x", handleInvalid="keep"))
        steps.append(OneHotEncoder(inputCol=f"{c}__x", outputCol=f"{c}__h", dropLast=False))
    names = [f"{c}__i" for c in numeric] + [f"{c}__missing" for c in numeric]
    steps.append(VectorAssembler(inputCols=names, outputCol="_num" if scale else "_raw"))
    if scale:
        steps.append(StandardScaler(inputCol="_num", outputCol="_raw", withMean=True, withStd=True))
    steps.append(VectorAssembler(inputCols=["_raw", *(f"{c}__h" for c in categorical)], outputCol="features"))
    return Pipeline(stages=steps)


def with_flags(df: DataFrame, numeric: list[str], categorical: list[str] = ()) -> DataFrame:
    """df with missing flags; numeric columns as doubles, categories without nulls."""
    out = df.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in numeric} | {c: F.col(c).cast("double") for c in numeric})
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("Unknown")) for c in categorical}) if categorical else out


def forward(df: DataFrame, season: str, fit_upto: int, score: int) -> tuple[DataFrame, DataFrame]:
    """Rows to fit on, strictly before the season to score, and those to score."""
    if fit_upto >= score:
        raise ValueError("the scored season must come after the fitted ones")
    return df.where(F.col(season) <= fit_upto), df.where(F.col(season) == score)


def medians(df: DataFrame, numeric: list[str]) -> dict[str, float]:
    """Exact medians of columns, found in bands of their values; 0 for a column without any value."""
    ship_package(df.sparkSession)
    found = metrics.order_statistics(df, numeric, lambda n: [(n - 1) // 2, n // 2]) if numeric else {}
    middle = lambda v: min(v.values()) + 0.5 * (max(v.values()) - min(v.values()))
    return {c: middle(found[0, i]) if (0, i) in found else 0.0 for i, c in enumerate(numeric)}


def _fit(df: DataFrame, numeric: list[str], categorical: list[str], estimator) -> PipelineModel:
    flagged = with_flags(df, numeric, categorical)
    return Pipeline(stages=[encode(numeric, medians(flagged, numeric), categorical), estimator]).fit(flagged)


def fit_logistic(df: DataFrame, numeric: list[str], label: str, categorical: list[str] = (), c: float = 1.0) -> PipelineModel:
    """L2 logistic regression with inverse strength c, as a sum of losses would weigh it."""
    n = max(df.count(), 1)
    return _fit(df, numeric, categorical, LogisticRegression(labelCol=label, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200))


def fit_poisson(df: DataFrame, numeric: list[str], label: str, categorical: list[str] = (), alpha: float = 0.15) -> PipelineModel:
    """Log-link Poisson regression with ridge alpha on the mean loss."""
    mean = df.agg(F.avg(label)).head()[0] or 1.0
    return _fit(df, numeric, categorical, GeneralizedLinearRegression(labelCol=label, family="poisson", link="log", regParam=alpha / mean))


@dataclass
class TreeRows:
    """Rows added up by the bins of their fields, from which trees of several labels and configurations are fitted."""

    cells: DataFrame
    cuts: list[list[float]]
    medians: list[float]


def tree_rows(df: DataFrame, numeric: list[str], labels: list[str], counts: list[str] = (), bins: int = 32) -> TreeRows:
    """df for fit_trees, with labels and, as log1p, counts.  Work on it does not grow with the rows."""
    cuts, mid = boosting.quantile_cuts(df, numeric, bins), medians(df, numeric)
    logs = df.withColumns({f"{c}__log": F.log1p(c) for c in counts}) if counts else df
    filled = [mid[c] for c in numeric]
    return TreeRows(boosting.cells(logs, numeric, [*labels, *(f"{c}__log" for c in counts)], cuts, filled), cuts, filled)


def fit_trees(df: DataFrame | TreeRows, numeric: list[str], label: str, categorical: list[str] = (), config: int = 0, counts: bool = False, trees: int | None = None, seed: int = 1729) -> PipelineModel | boosting.CountTrees:
    """Boosted trees; for counts a regression of log1p.  With categories Spark's own, else the same losses on tree_rows."""
    n, rate, depth, leaf = TREES[config]
    if categorical:
        common = {"labelCol": label, "maxIter": trees or n, "stepSize": rate, "maxDepth": depth, "minInstancesPerNode": leaf, "seed": seed}
        if not counts:
            return _fit(df, numeric, categorical, GBTClassifier(**common))
        common["labelCol"] = "_log"
        return _fit(df.withColumn("_log", F.log1p(label)), numeric, categorical, GBTRegressor(**common))
    rows = df if isinstance(df, TreeRows) else tree_rows(df, numeric, [] if counts else [label], [label] if counts else [])
    cfg = boosting.BoostConfig(trees=trees or n, rate=rate, depth=depth, leaves=2**depth, least_rows=leaf, l2=0.0, bins=32, refresh=5)
    return boosting.fit_cells(rows.cells, numeric, f"{label}__log" if counts else label, rows.cuts, rows.medians, cfg, "squares" if counts else "logistic")


def score_probability(model: PipelineModel | boosting.CountTrees, df: DataFrame, numeric: list[str], categorical: list[str] = (), out: str = "p") -> DataFrame:
    if isinstance(model, boosting.CountTrees):
        return df.withColumn(out, model.margin()).withColumn(out, 1 / (1 + F.exp(-2 * F.col(out))))
    made = model.transform(with_flags(df, numeric, categorical))
    return made.withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)


def score_mean(model: PipelineModel | boosting.CountTrees, df: DataFrame, numeric: list[str], categorical: list[str] = (), out: str = "mu", log: bool = False) -> DataFrame:
    if isinstance(model, boosting.CountTrees):
        made = df.withColumn(out, model.margin())
        return made.withColumn(out, F.expm1(out)) if log else made
    made = model.transform(with_flags(df, numeric, categorical))
    return made.withColumn(out, F.expm1("prediction") if log else F.col("prediction")).select(*df.columns, out)


def season_scores(df: DataFrame, season: str, seasons: list[int], fields: list[str], label: str, categorical: tuple[str, ...] = (), link: str = "logistic", ridge: float = 1.0, out: str = "p") -> DataFrame:
    """Rows of the seasons, each scored by a model of the seasons before its own, with fit_upto; all models are fitted together."""
    uptos = tuple(sorted(s - 1 for s in seasons))
    fitted = newton.fit(df.where(F.col(season) <= uptos[-1]), newton.Spec({"all": fields}, label, categorical, season=season, uptos=uptos, link=link, ridge=ridge))
    test = df.where(F.col(season).isin([int(s) for s in seasons]))
    return fitted.score(test, "all", out).withColumn("fit_upto", F.col(season) - 1)


def group_models(train: DataFrame, test: DataFrame, by: str, numeric: list[str], label: str, min_rows: int = 500, min_positives: int = 50, least_c: float = 1.0) -> DataFrame:
    """test with p and status: one model for each group that has rows and positives enough, else null and insufficient.

    All groups are fitted together, by as many scans as the slowest needs.
    """
    fitted = newton.fit(train, newton.Spec({"all": numeric}, label, by=by, ridge=1.0 / least_c, min_rows=min_rows, min_positives=min_positives))
    return fitted.score(test, "all", "p").withColumn("status", F.when(F.col("p").isNotNull(), "fitted").otherwise("insufficient"))


def ablation(train: DataFrame, test: DataFrame, families: dict[str, list[str]], label: str) -> DataFrame:
    """family, n_fields, n, log_loss, brier of one logistic model for each family of fields, on the same rows.

    The families are fitted together and score the rows in one scan.
    """
    fitted = newton.fit(train, newton.Spec(families, label))
    out = test
    for name in families:
        out = fitted.score(out, name, f"_p_{name}")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("family"), F.lit(len(fs)).alias("n_fields"), F.col(f"_p_{n}").alias("p")) for n, fs in families.items())))
    return metrics.probability_metrics(out.select(label, each.alias("v")).select(label, "v.*"), "p", label, ["family", "n_fields"])


def sanity_ratios(scored: DataFrame, by: list[str], axis: str, near: float, far: float, p: str = "p") -> DataFrame:
    """by, ratio of the score near to the score far along an axis, and whether it never rises from near to far."""
    w = Window.partitionBy(*by).orderBy(axis)
    t = scored.withColumn("_fall", F.coalesce(F.col(p) <= F.lag(p).over(w), F.lit(True)))
    at = lambda x: F.max(F.when(F.col(axis) == x, F.col(p)))
    return t.groupBy(*by).agg((at(near) / at(far)).alias("near_far_ratio"), F.bool_and("_fall").alias("monotonic"))


def platt(df: DataFrame, p: str, y: str) -> tuple[float, float]:
    """(intercept, slope) of the label on the logit."""
    model = Pipeline(stages=[VectorAssembler(inputCols=["_l"], outputCol="_f"), LogisticRegression(labelCol=y, featuresCol="_f", regParam=0.0, standardization=False, maxIter=500, tol=1e-12)])
    lr = model.fit(df.withColumn("_l", dist.logit(F.col(p)))).stages[-1]
    return float(lr.intercept), float(lr.coefficients[0])


def apply_platt(p: Column, fitted: tuple[float, float]) -> Column:
    return dist.sigmoid(F.lit(fitted[0]) + F.lit(fitted[1]) * dist.logit(p))


def calibrate_if_better(fit_on: DataFrame, check_on: DataFrame, p: str, y: str) -> tuple[tuple[float, float], bool]:
    """A sigmoid of one period, accepted only if on another both scores improve and the calibration error does not grow."""
    fitted = platt(fit_on, p, y)
    both = check_on.withColumn("_q", apply_platt(F.col(p), fitted))
    new, old = (metrics.ece(metrics.reliability(both, c, y, metrics.PLAYER_BINS)).head()["ece"] for c in ("_q", p))
    row = both.agg(metrics.log_loss(F.col("_q"), F.col(y)).alias("a"), metrics.log_loss(F.col(p), F.col(y)).alias("b"), metrics.brier(F.col("_q"), F.col(y)).alias("c"), metrics.brier(F.col(p), F.col(y)).alias("d")).head()
    return fitted, row["a"] is not None and row["a"] < row["b"] and row["c"] < row["d"] and (new or 0.0) <= (old or 0.0)


def allocate(df: DataFrame, group: list[str], weights: dict[str, float], expected: Column) -> DataFrame:
    """df with score, share, lambda and p: the group's expectation dealt by a weighted mean of the shares at hand.

    A null share leaves the mean, and a member without any scores 1; a group in which every
    score is zero is dealt equally.
    """
    top, low = F.lit(0.0), F.lit(0.0)
    for c, w in weights.items():
        top = top + F.coalesce(F.col(c) * w, F.lit(0.0))
        low = low + F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0)
    w = Window.partitionBy(*group)
    out = df.withColumn("score", F.coalesce(F.try_divide(top, low), F.lit(1.0)))
    total, n = F.sum("score").over(w), F.count(F.lit(1)).over(w)
    out = out.withColumn("share", F.when(total > 0, F.col("score") / total).otherwise(F.lit(1.0) / n))
    return out.withColumn("lambda", F.col("share") * expected).withColumn("p", dist.poisson_at_least_one(F.col("lambda")))


def coherence(df: DataFrame, group: list[str], member: str, whole: str, eps: float = 1e-7) -> DataFrame:
    """One row: how far the sums of members lie from their group's value, and how many groups differ by more than eps."""
    gap = df.groupBy(*group).agg(F.abs(F.sum(member) - F.first(whole)).alias("gap"))
    return gap.agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"), F.avg((F.col("gap") > 0.5).cast("double")).alias("above_half"), F.count_if(F.col("gap") > eps).alias("incoherent"))


def project_simplex(x: np.ndarray) -> np.ndarray:
    """The nearest point with non-negative entries that sum to one."""
    u = np.sort(x)[::-1]
    k = np.arange(1, len(x) + 1)
    top = np.flatnonzero(u - (np.cumsum(u) - 1) / k > 0)[-1]
    return np.maximum(x - (np.cumsum(u)[top] - 1) / (top + 1), 0)


def _quadratic_on_simplex(w: np.ndarray, g: np.ndarray, h: np.ndarray, steps: int = 500) -> np.ndarray:
    """The point of the simplex that minimises g (x - w) + (x - w) h (x - w) / 2, by projected gradient."""
    rate, x = 1.0 / max(float(np.linalg.eigvalsh(h)[-1]), 1e-12), w
    for _ in range(steps):
        new = project_simplex(x - rate * (g + h @ (x - w)))
        if np.abs(new - x).max() < 1e-14:
            break
        x = new
    return x


def allocation_loss(df: DataFrame, group: list[str], fields: list[str], expected: str, y: str, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Brier score of allocate() with these weights, its gradient, and the Gauss-Newton matrix of the weights.

    One scan: a member's chance depends on its group's total score and on that total's
    derivatives, so both are sums over the group, and what reaches the driver is their sums over all rows.
    """
    k = len(fields)
    out = allocate(df, group, {f: float(x) for f, x in zip(fields, w, strict=True)}, F.col(expected))
    by = Window.partitionBy(*group)
    usable = sum((F.when(F.col(f).isNotNull(), F.lit(float(x))).otherwise(0.0) for f, x in zip(fields, w, strict=True)), F.lit(0.0))
    out = out.withColumn("_u", usable).withColumn("_t", F.sum("score").over(by))
    own = lambda f: F.when((F.col("_u") > 0) & F.col(f).isNotNull() & (F.col("_t") > 0), (F.col(f) - F.col("score")) / F.col("_u")).otherwise(0.0)
    out = out.withColumns({f"_d{i}": own(f) for i, f in enumerate(fields)})
    slope = F.exp(-F.col("lambda")) * F.col(expected)
    out = out.withColumns({f"_j{i}": F.when(F.col("_t") > 0, slope * (F.col(f"_d{i}") - F.col("share") * F.sum(f"_d{i}").over(by)) / F.col("_t")).otherwise(0.0) for i in range(k)})
    miss = F.col("p") - F.col(y)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = out.agg(
        F.avg(miss * miss).alias("loss"), *(F.avg(2 * miss * F.col(f"_j{i}")).alias(f"g{i}") for i in range(k)), *(F.avg(2 * F.col(f"_j{i}") * F.col(f"_j{j}")).alias(f"h{i}_{j}") for i, j in pairs)
    ).head()
    g, h = np.array([row[f"g{i}"] for i in range(k)], float), np.zeros((k, k))
    for i, j in pairs:
        h[i, j] = h[j, i] = row[f"h{i}_{j}"]
    return float(row["loss"]), g, h


def fit_simplex(df: DataFrame, group: list[str], fields: list[str], expected: str, y: str, tolerance: float = 1e-7, most: int = 60) -> tuple[np.ndarray, float, int]:
    """Weights on the simplex that minimise the Brier score of allocate()'s chances: (weights, loss, scans).

    Damped Gauss-Newton steps projected on the simplex; a step that does not lower the loss is
    tried again with more damping.  It ends where a projected gradient step moves no weight
    by more than the tolerance, and fails if that takes more than `most` scans.  The frame should be a written table:
    every step scans it once.
    """
    if not df.take(1):
        raise ValueError("no rows to fit on")
    w = np.full(len(fields), 1.0 / len(fields))
    loss, g, h = allocation_loss(df, group, fields, expected, y, w)
    damping, scans = 1e-6, 1
    while True:
        scale = max(float(np.trace(h)) / len(w), 1e-12)
        new = _quadratic_on_simplex(w, g, h + damping * scale * np.eye(len(w)))
        if np.abs(new - w).max() <= tolerance:
            return w, loss, scans
        if scans >= most:
            raise RuntimeError(f"no convergence in {most} scans")
        tried = allocation_loss(df, group, fields, expected, y, new)
        scans += 1
        if tried[0] < loss:
            w, damping = new, damping / 8
            loss, g, h = tried
        else:
            damping = max(damping * 16, 1e-3)


def wald(df: DataFrame, features: list[str], y: str, coefficients: list[float], intercept: float, ridge: float = 0.0) -> list[tuple[str, float, float, float]]:
    """(name, coefficient, standard error, z), from the Fisher information summed by Spark."""
    x = [F.lit(1.0), *(F.col(f) for f in features)]
    eta = F.lit(float(intercept))
    for f, c in zip(features, coefficients, strict=True):
        eta = eta + F.col(f) * float(c)
    w = dist.sigmoid(eta) * (F.lit(1.0) - dist.sigmoid(eta))
    k = len(x)
    row = df.agg(*(F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k))).head()
    h = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            h[i, j] = h[j, i] = row[f"h{i}_{j}"]
    h[1:, 1:] += ridge * np.eye(k - 1)
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    return [(n, float(b), float(s), float(b / s)) for n, b, s in zip(["intercept", *features], [intercept, *coefficients], se, strict=True)]


def correlated_pairs(df: DataFrame, fields: list[str], least: float = 0.85, top: int = 12) -> DataFrame:
    """Pairs of fields whose correlation is at least so strong, the strongest first."""
    clean = VectorAssembler(inputCols=fields, outputCol="_v").transform(df.dropna(subset=fields).select(*(F.col(f).cast("double").alias(f) for f in fields)))
    mat = Correlation.corr(clean, "_v").head()[0].toArray()
    rows = [(a, b, float(mat[i, j])) for i, a in enumerate(fields) for j, b in enumerate(fields) if i < j and abs(mat[i, j]) >= least]
    spark = df.sparkSession
    return spark.createDataFrame(rows, "left string, right string, corr double").orderBy(F.desc(F.abs("corr")), "left", "right").limit(top)
