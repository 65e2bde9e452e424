"""Probability and count metrics, reliability, ranking scores and cluster bootstrap."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ship import ship_package

PLAY_BINS = [0.0, 0.01, 0.02, 0.05, 0.10, 0.20, 0.35, 0.50, 1.0]
PLAYER_BINS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 1.01]
LINE_BINS = [0.0, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 1.01]
COUNT_BINS = [float("-inf"), 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, float("inf")]


def clip(p: Column, eps: float = 1e-6) -> Column:
    return F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p))


def log_loss(p: Column, y: Column, eps: float = 1e-6) -> Column:
    c = clip(p, eps)
    return F.avg(F.when(y == 1, -F.log(c)).otherwise(-F.log(F.lit(1.0) - c)))


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def probability_metrics(df: DataFrame, p: str, y: str, by: list[str] | None = None, eps: float = 1e-6) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), log_loss(F.col(p), F.col(y), eps).alias("log_loss"), brier(F.col(p), F.col(y)).alias("brier"))


def bins(df: DataFrame, edges: list[float]) -> DataFrame:
    """A bin dimension: bin, lo, hi, last."""
    rows = [(i, lo, hi, i == len(edges) - 2) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    return df.sparkSession.createDataFrame(rows, "bin int, lo double, hi double, last boolean")


def reliability(df: DataFrame, p: str, y: str, edges: list[float], closed: str = "left") -> DataFrame:
    """bin, lo, hi, n, mean_p, mean_y; empty bins stay.  Bins are [lo, hi), the last closed; or (lo, hi]."""
    v = F.col(p)
    # Rows find their bin first and are summed by it; only sums meet the dimension.
    dim = bins(df, edges)
    index = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        inside = (v >= lo) & ((v <= hi) if i == len(edges) - 2 else (v < hi)) if closed == "left" else (v > lo) & (v <= hi)
        index = F.when(inside, i).otherwise(index)
    sums = df.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))
    return dim.join(sums, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean_p", "mean_y")


def ece(table: DataFrame) -> DataFrame:
    """Expected calibration error and greatest gap of a reliability table."""
    gap = F.abs(F.col("mean_p") - F.col("mean_y"))
    return table.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("max_gap"))


#: Bands of the score range in which running sums are taken apart.
SCORE_BANDS = 4096


def _running(df: DataFrame, p: str, y: str, descending: bool = False) -> DataFrame:
    """Distinct scores with pos, neg and the sums of both before them in score order.

    Rows are summed by score, and sums run inside narrow bands of the score; only band
    totals, at most SCORE_BANDS of them, meet in one task.  Scores are probabilities.
    """
    t = df.groupBy(F.col(p).alias("p")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    band = F.greatest(F.lit(0), F.least(F.lit(SCORE_BANDS - 1), F.floor(F.col("p") * SCORE_BANDS)))
    t = t.withColumn("band", (F.lit(SCORE_BANDS - 1) - band if descending else band).cast("int"))
    order = F.desc("p") if descending else F.col("p")
    inside = Window.partitionBy("band").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    bands = t.groupBy("band").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    earlier = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    bands = bands.select("band", *(F.coalesce(F.sum(c).over(earlier), zero).alias(f"{c}_bands") for c in ("pos", "neg")))
    t = t.join(F.broadcast(bands), "band")
    return t.withColumns({f"{c}_before": F.col(f"{c}_bands") + F.coalesce(F.sum(c).over(inside), zero) for c in ("pos", "neg")})


def auc(df: DataFrame, p: str, y: str) -> DataFrame:
    """Mann-Whitney with half credit for ties, from counts by distinct score."""
    t = _running(df, p, y).withColumn("score", F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return t.agg((F.sum("score") / (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def average_precision(df: DataFrame, p: str, y: str) -> DataFrame:
    """Sum over distinct thresholds of recall gained times precision there."""
    t = _running(df, p, y, descending=True).withColumn("tp", F.col("pos_before") + F.col("pos"))
    seen = F.col("tp") + F.col("neg_before") + F.col("neg")
    return t.agg((F.sum(F.col("pos") * F.col("tp") / seen) / F.sum("pos").cast("double")).alias("average_precision"))


def count_metrics(df: DataFrame, mu: str, y: str, by: list[str] | None = None) -> DataFrame:
    m, v = F.greatest(F.col(mu), F.lit(1e-9)), F.col(y).cast("double")
    dev = F.when(v > 0, v * F.log(v / m)).otherwise(F.lit(0.0)) - (v - m)
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(v - m)).alias("mae"), F.sqrt(F.avg((v - m) * (v - m))).alias("rmse"),
        F.avg(m - v).alias("bias"), (F.avg(dev) * 2).alias("deviance"),
    )


def dispersion(df: DataFrame, mu: str, y: str) -> DataFrame:
    v, m = F.col(y).cast("double"), F.col(mu)
    out = df.agg((F.var_samp(v) / F.avg(v)).alias("var_over_mean"), F.avg((v - m) * (v - m) / m).alias("pearson"))
    return out.withColumn("overdispersed", (F.col("var_over_mean") > 1.2) & (F.col("pearson") > 1.2))


def nb_alpha(df: DataFrame, mu: str, y: str) -> DataFrame:
    """Method of moments: variance of values against the mean of means."""
    mean = F.avg(mu)
    return df.agg(F.greatest(F.lit(0.0), (F.var_samp(F.col(y).cast("double")) - mean) / (mean * mean)).alias("alpha"))


#: Modulus of the integer arithmetic of draws.
_MODULUS = 2_147_483_647


def _mixed(x):
    """A round of a quadratic map; linear ones would draw the clusters of a replicate from a lattice."""
    return (x * ((x + 48_271) % _MODULUS) + 11) % _MODULUS


def draw(df: DataFrame, out: str, rep: Column, k: Column, n: Column, seed: int = 1729) -> DataFrame:
    """df with the index in [0, n) of the k-th draw of a replicate, by integer arithmetic any engine can repeat."""
    df = df.withColumn(out, (rep * 1_000_003 + k * 7_919 + seed) % _MODULUS)
    for _ in range(3):  # a column each, so that no round is written out twice
        df = df.withColumn(out, _mixed(F.col(out)))
    return df.withColumn(out, F.col(out) % n)


def cluster_bootstrap(df: DataFrame, cluster: str, numerator: Column, denominator: Column, replicates: int = 2000, seed: int = 1729) -> DataFrame:
    """replicate, stat: ratio of sums over clusters drawn with replacement.

    Rows are summed by cluster first, so the size is replicates x clusters, whatever the rows.
    """
    sums = df.groupBy(cluster).agg(numerator.alias("num"), denominator.alias("den"))
    sums = sums.withColumn("at", F.row_number().over(Window.orderBy(cluster)) - 1).select("at", "num", "den")
    n = sums.count()
    spark = df.sparkSession
    draws = spark.range(replicates * n).select(F.expr(f"id div {max(n, 1)}").alias("replicate"), (F.col("id") % max(n, 1)).alias("k"))
    draws = draw(draws, "at", F.col("replicate"), F.col("k"), F.lit(max(n, 1)), seed).withColumn("at", F.col("at").cast("int"))
    return draws.join(sums, "at").groupBy("replicate").agg((F.sum("num") / F.sum("den")).alias("stat"))


#: Where the counts of a Poisson draw of mean 1 begin below the modulus.
POISSON_CUTS = [math.floor(_MODULUS * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def poisson_bootstrap(df: DataFrame, cluster: str, numerator: Column, denominator: Column, replicates: int = 2000, seed: int = 1729) -> DataFrame:
    """replicate, stat: ratio of sums over clusters that each count as often as a Poisson draw of mean 1.

    For many clusters: draws with replacement are such counts given their total, which a ratio
    leaves out.  A draw is integer arithmetic on the replicate and a hash of the cluster, so clusters need no
    numbers, and a task keeps two sums a replicate whatever the number of clusters.
    """
    ship_package(df.sparkSession)
    number = F.conv(F.substring(F.md5(F.col(cluster).cast("string")), 1, 7), 16, 10).cast("long")
    sums = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(numerator.cast("double").alias("num"), denominator.cast("double").alias("den")).select(number.alias("c"), "num", "den")
    cuts = np.array(POISSON_CUTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, replicates))
        rep = np.arange(replicates, dtype=np.int64)[:, None]
        for batch in batches:
            c = batch.column(0).to_numpy()
            both = np.stack([batch.column(i).fill_null(0.0).to_numpy(zero_copy_only=False) for i in (1, 2)])
            step = max(1, 1_000_000 // replicates)
            for a in range(0, len(c), step):
                x = _mixed(_mixed(_mixed((rep * 1_000_003 + c[None, a : a + step] * 7_919 + seed) % _MODULUS)))
                total += both[:, a : a + step] @ np.searchsorted(cuts, x, "right").T
        yield pa.RecordBatch.from_arrays([pa.array(rep[:, 0]), pa.array(total[0]), pa.array(total[1])], ["replicate", "num", "den"])

    return sums.mapInArrow(run, "replicate long, num double, den double").groupBy("replicate").agg((F.sum("num") / F.sum("den")).alias("stat"))


def interval(reps: DataFrame, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    return reps.agg(F.count(F.lit(1)).alias("replicates"), F.percentile("stat", F.lit(lo)).alias("lo"), F.percentile("stat", F.lit(hi)).alias("hi"))


#: Ranges of values in which positions are counted apart.
VALUE_BANDS = 64


def _positions(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distinct values of each group with the first and last position they hold, from 0, and the group's size.

    Values are counted first.  Approximate quantiles cut a group into bands, positions run
    inside a band, and only band totals meet, so no task holds a group.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*by, F.lit(0)).alias("_g"), F.col(value).alias("_x"))
    cuts = rows.groupBy("_g").agg(F.percentile_approx("_x", [i / VALUE_BANDS for i in range(1, VALUE_BANDS)], 10_000).alias("_cuts"), F.count(F.lit(1)).alias("_size"))
    t = rows.groupBy("_g", "_x").agg(F.count(F.lit(1)).alias("_n")).join(cuts, "_g")
    t = t.withColumn("_band", F.size(F.filter("_cuts", lambda c: c < F.col("_x")))).drop("_cuts")
    bands = t.groupBy("_g", "_band").agg(F.sum("_n").alias("_b"))
    earlier = Window.partitionBy("_g").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("_g", "_band", F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_g", "_band").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    lo = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    t = t.join(bands, ["_g", "_band"]).withColumn("_lo", lo).withColumn("_hi", F.col("_lo") + F.col("_n") - 1)
    return t.select(*(F.col(f"_g.{c}").alias(c) for c in by), F.col("_x").alias(value), F.col("_lo").alias("first_at"), F.col("_hi").alias("last_at"), F.col("_size").alias("size"))


def order_statistics(df: DataFrame, fields: list[str], positions: Callable[[int], list[int]], members: Callable | None = None, cells: int = 1) -> dict[tuple[int, int], dict[int, float]]:
    """For (cell, number of a field): exact values at the positions that positions(number of values) names, from 0 in order of value.

    members: gives (cell, its rows) of an Arrow batch; without it all rows are cell 0.  Approximate quantiles
    cut a field into bands, one scan counts them, another looks into the bands that hold a position: only band
    counts and the values asked for reach the driver, and a small share of the values is exchanged.
    """
    ship_package(df.sparkSession)
    k, bands = len(fields), max(128, min(2048, 200_000 // max(cells, 1)))
    cuts = df.agg(*(F.percentile_approx(F.col(f).cast("double"), [i / bands for i in range(1, bands)], 10_000).alias(f"c{i}") for i, f in enumerate(fields))).head()
    edges = [np.unique(np.array(c if c is not None else [], float)) for c in cuts]

    def banded(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The first slot of a cell and field, bands and values."""
        for cell, own in members(batch) if members else [(0, slice(None))]:
            for i, f in enumerate(fields):
                col = batch.column(f)
                x = col.to_numpy(zero_copy_only=False).astype(float)[own][~np.asarray(col.is_null())[own]]
                yield (cell * k + i) * bands, np.searchsorted(edges[i], x, side="left"), x

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells * k * bands, np.int64)
        for batch in batches:
            for first, band, _ in banded(batch):
                total[first : first + bands] += np.bincount(band, minlength=bands)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    rows = df.select(*(c for c in ("_g", "_s") if members), *(F.col(f).cast("double").alias(f) for f in fields))
    counts = np.zeros(cells * k * bands, np.int64)
    for r in rows.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r["slot"]] = r["n"]
    ends = np.cumsum(counts.reshape(cells * k, bands), axis=1)
    asked = [(g, g * bands + int(np.searchsorted(ends[g], p, side="right")), int(p)) for g in range(cells * k) if ends[g, -1] for p in sorted(set(positions(int(ends[g, -1]))))]
    out: dict[tuple[int, int], dict[int, float]] = {}
    if not asked:
        return out
    wanted = np.isin(np.arange(len(counts)), [slot for _, slot, _ in asked])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, band, x in banded(batch):
                own = wanted[first + band]
                yield pa.RecordBatch.from_arrays([pa.array(first + band[own]), pa.array(x[own])], ["slot", "x"])

    run = Window.partitionBy("slot").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    t = rows.mapInArrow(pick, "slot long, x double").groupBy("slot", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("last", F.sum("n").over(run) - 1)
    inside = [(slot, p, p - int(ends[g, slot % bands] - counts[slot])) for g, slot, p in asked]
    told = df.sparkSession.createDataFrame(inside, "slot long, position long, at long")
    hit = t.join(F.broadcast(told), "slot").where((F.col("last") - F.col("n") < F.col("at")) & (F.col("at") <= F.col("last")))
    for r in hit.select("slot", "position", "x").collect():  # one row a position
        out.setdefault(divmod(r["slot"] // bands, k), {})[r["position"]] = r["x"]
    return out


def quantiles(df: DataFrame, value: str, qs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles by name, interpolated between neighbours; nulls are left out."""
    t, v = _positions(df, value, by or []), F.col(value).cast("double")

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("first_at") <= position) & (position <= F.col("last_at")), v))

    def one(q: float) -> Column:
        p = (F.col("size") - 1) * F.lit(float(q))
        part = F.max(p - F.floor(p))
        return at(F.floor(p)) + part * (at(F.ceil(p)) - at(F.floor(p)))

    return t.groupBy(*(by or [])).agg(*(one(q).alias(n) for n, q in qs.items()))


def upper_median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The value at position floor(n / 2) from 0, by group."""
    middle = F.floor(F.col("size") / 2)
    return _positions(df, value, by).where((F.col("first_at") <= middle) & (middle <= F.col("last_at"))).select(*by, F.col(value).alias("upper_median"))


def promotion(df: DataFrame, base: str, challenger: str, y: str, *, slope: float | None, cluster: str, position: str, segment: str, material: float = 0.005, position_worse: float = 0.010, segment_worse: float = 0.005, ece_worse: float = 0.010, replicates: int = 2000) -> DataFrame:
    """One row: six gates that a challenger must pass, and whether it does.

    slope is the challenger's calibration slope, of models.platt.
    """
    label = F.col(y)
    worse = log_loss(F.col(challenger), label) - log_loss(F.col(base), label)
    sets = df.groupingSets([[position], [segment], []], position, segment).agg(worse.alias("d"), F.grouping_id().alias("g"))
    own = lambda g: F.when(F.col("g") == g, F.col("d"))
    cuts = sets.agg(F.max(own(3)).alias("all"), F.max(own(1)).alias("position"), F.max(own(2)).alias("segment"), F.count_if((F.col("g") == 2) & (F.col("d") < 0)).alias("better"))
    one = lambda c: F.when(label == 1, -F.log(clip(F.col(c)))).otherwise(-F.log(F.lit(1.0) - clip(F.col(c))))
    reps = cluster_bootstrap(df, cluster, F.sum(one(challenger) - one(base)), F.count(F.lit(1)).cast("double"), replicates)
    gaps = [ece(reliability(df, c, y, PLAYER_BINS)).select(F.col("ece").alias(n)) for c, n in ((base, "ece_base"), (challenger, "ece_new"))]
    row = cuts.crossJoin(F.broadcast(interval(reps).select("hi"))).crossJoin(F.broadcast(gaps[0])).crossJoin(F.broadcast(gaps[1]))  # one row each
    gates = {
        "material_log_loss": F.col("all") <= -material, "bootstrap_below_zero": F.col("hi") < 0, "ece": F.col("ece_new") <= F.col("ece_base") + ece_worse,
        "slope": F.lit(slope is not None and 0.8 <= slope <= 1.2), "position": F.col("position") <= position_worse, "chronology": (F.col("better") >= 2) & (F.col("segment") <= segment_worse),
    }
    every = F.lit(True)
    for c in gates.values():
        every = every & c
    return row.select(*(c.alias(n) for n, c in gates.items()), every.alias("promoted"))


def finite_mean(value: Column) -> Column:
    v = value.cast("double")
    return F.avg(F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v))


def best_method(scores: DataFrame, name: str, order: list[str], eligible: list[str] | None = None) -> DataFrame:
    """The method of least score among those eligible."""
    pool = scores.where(F.col(name).isin(eligible)) if eligible else scores
    return pool.agg(F.min_by(F.col(name), F.struct(*order, name)).alias("selected"))


def blends(df: DataFrame, scores: list[str], y: str, weights: dict[str, tuple[float, ...]], eps: float = 1e-6) -> DataFrame:
    """name, n, log_loss, brier, weights and chosen of registered convex blends; all in one scan.

    Weights must be non-negative and sum to one; ties go to the first name.
    """
    for name, w in weights.items():
        if len(w) != len(scores) or min(w) < 0 or abs(sum(w) - 1) > 1e-9:
            raise ValueError(f"{name} is no convex blend of {len(scores)} scores")
    told = F.array(*(F.struct(F.lit(n).alias("name"), F.array(*(F.lit(float(x)) for x in w)).alias("weights")) for n, w in weights.items()))
    long = df.select(y, *scores, F.explode(told).alias("b"))
    q = F.lit(0.0)
    for i, s in enumerate(scores):
        q = q + F.col(s) * F.col("b.weights")[i]
    out = probability_metrics(long.select(F.col(y), "b.name", "b.weights", q.alias("q")), "q", y, ["name", "weights"], eps)
    best = out.agg(F.min_by("name", F.struct("log_loss", "name")).alias("_best"))  # one row
    return out.join(F.broadcast(best)).select("name", "n", "log_loss", "brier", "weights", (F.col("name") == F.col("_best")).alias("chosen"))


def registry_audit(stored: DataFrame, rebuilt: DataFrame, eps: float = 1e-9) -> DataFrame:
    """One row of violation counts: a stored registry (name, log_loss, fit_upto, scored, chosen, weights) against its rebuild."""
    b = rebuilt.select("name", F.col("log_loss").alias("_ll"), F.col("weights").alias("_w"), F.col("chosen").alias("_best"))
    both = stored.join(b, "name", "full")
    off = F.coalesce(F.abs(F.col("log_loss") - F.col("_ll")) > eps, F.lit(True))
    return both.agg(
        F.count("log_loss").alias("rows"), F.count_if(off).alias("log_loss_differs"), F.count_if(F.col("fit_upto") >= F.col("scored")).alias("not_forward"),
        F.count_if(F.col("chosen") & ~F.coalesce("_best", F.lit(False))).alias("chosen_not_best"), F.count_if(~F.col("weights").eqNullSafe(F.col("_w"))).alias("weights_differ"),
    )
