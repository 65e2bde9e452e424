"""Distributions, probability and count metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..operators import metrics as m
from . import views as v
from .registry import big, query, r6

_MEAN = """SELECT event_id, ln(1 + "value") m, (user_id % 6) + 0.5 line FROM events"""
_COUNTS = """SELECT entity, season, n y, avg(n) OVER (PARTITION BY entity ORDER BY season ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) mu FROM (SELECT entity, season, count(*) n FROM v_game GROUP BY 1, 2)"""


def _means(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "events").select("event_id", F.log1p("value").alias("m"), ((F.col("user_id") % 6) + 0.5).alias("line"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each customer-year and the mean of the three years before."""
    w = Window.partitionBy("entity").orderBy("season").rowsBetween(-3, -1)
    n = v.games(spark, d).groupBy("entity", "season").agg(F.count(F.lit(1)).alias("y"))
    return n.withColumn("mu", F.avg("y").over(w)).where("mu IS NOT NULL")


@query(v.sql("SELECT event_id, round(1 - exp(-m), 6) p1, round(1 - exp(-m) * (1 + m), 6) p2 FROM a", ("a", _MEAN)))
def poisson_cols(spark: SparkSession, d: str) -> DataFrame:
    x = _means(spark, d)
    return x.select("event_id", r6(dist.poisson_at_least_one(F.col("m")), "p1"), r6(dist.poisson_at_least_two(F.col("m")), "p2"))


@query(v.sql("SELECT event_id, round(exp(-m), 6) p0, round(exp(-m) * m, 6) p1, round(exp(-m) * m * m / 2, 6) p2, round(exp(-m) * m * m * m / 6, 6) p3, round(greatest(0, 1 - exp(-m) * (1 + m + m * m / 2 + m * m * m / 6)), 6) p4 FROM a", ("a", _MEAN)))
def count_distribution(spark: SparkSession, d: str) -> DataFrame:
    x = _means(spark, d)
    return x.select("event_id", *(r6(c, f"p{k}") for k, c in enumerate(dist.poisson_masses(F.col("m")))))


@query(v.sql("""SELECT event_id, round(1 - u - p, 6) over_, round(u, 6) under_, round(p, 6) push FROM a, LATERAL (SELECT coalesce(sum(q) FILTER (k < l), 0) u, coalesce(sum(q) FILTER (k = l), 0) p FROM (SELECT k, floor(line) l, exp(-m) * pow(m, k) / exp(lgamma(k + 1)) q FROM range(0, 8) t(k)) GROUP BY l) z""", ("a", _MEAN)))
def over_under_push(spark: SparkSession, d: str) -> DataFrame:
    """Chances around an integer line."""
    x = _means(spark, d).withColumn("o", dist.line_chances(F.col("m"), F.lit(0.0), F.floor("line").cast("double")))
    return x.select("event_id", r6("o.over", "over_"), r6("o.under", "under_"), r6("o.push", "push"))


@query(v.sql("""SELECT event_id, round(u, 6) under_ FROM a, LATERAL (SELECT sum(exp(lgamma(k + r) - lgamma(r) - lgamma(k + 1) + r * ln(r / (r + m)) + k * ln(m / (r + m)))) u FROM (SELECT k, 1 / 0.9206 r FROM range(0, 7) t(k) WHERE k < line)) z WHERE m > 0""", ("a", _MEAN)))
def nb_distribution(spark: SparkSession, d: str) -> DataFrame:
    x = _means(spark, d).where("m > 0").withColumn("o", dist.line_chances(F.col("m"), F.lit(0.9206), F.col("line")))
    return x.select("event_id", r6("o.under", "under_"))


_FAR = """SELECT event_id, 40 + event_id % 40 m, 55.5 + event_id % 31 - (event_id % 2) * 0.5 line FROM events"""


@query(v.sql("""SELECT event_id, round(1 - u - p, 6) poisson_over, round(p, 6) poisson_push, round(1 - nu - np, 6) nb_over, round(np, 6) nb_push FROM a JOIN (SELECT m, line, sum(q) FILTER (k < line) u, coalesce(sum(q) FILTER (k = line), 0) p, sum(nq) FILTER (k < line) nu, coalesce(sum(nq) FILTER (k = line), 0) np
    FROM (SELECT m, line, k, exp(k * ln(m) - m - lgamma(k + 1)) q, exp(lgamma(k + r) - lgamma(r) - lgamma(k + 1) + r * ln(r / (r + m)) + k * ln(m / (r + m))) nq FROM (SELECT DISTINCT m, line, 1 / 0.3::DOUBLE r FROM a), range(0, 100) t(k)) GROUP BY 1, 2) USING (m, line)""", ("a", _FAR)))
def far_lines(spark: SparkSession, d: str) -> DataFrame:
    """Means of forty and more against lines up to eighty-six, some of them integers."""
    e = v.table(spark, d, "events").select("event_id", (F.col("event_id") % 40 + 40).cast("double").alias("m"), (F.lit(55.5) + F.col("event_id") % 31 - (F.col("event_id") % 2) * 0.5).alias("line"))
    e = e.withColumns({"a": dist.line_chances(F.col("m"), F.lit(0.0), F.col("line")), "b": dist.line_chances(F.col("m"), F.lit(0.3), F.col("line"))})
    return e.select("event_id", r6("a.over", "poisson_over"), r6("a.push", "poisson_push"), r6("b.over", "nb_over"), r6("b.push", "nb_push"))


@query(v.sql("""SELECT entity, season::BIGINT season, round(sum(mass) FILTER (greatest(0, round_even(mu + r, 0)) > floor(mu)), 6) over_, round(coalesce(sum(mass) FILTER (greatest(0, round_even(mu + r, 0)) = floor(mu)), 0), 6) push FROM (SELECT * FROM c WHERE mu IS NOT NULL),
    (SELECT r, count(*) * 1.0::DOUBLE / sum(count(*)) OVER () mass FROM (SELECT floor((y - mu) / 0.25::DOUBLE) * 0.25::DOUBLE r FROM c WHERE mu IS NOT NULL) GROUP BY 1) h GROUP BY 1, 2""", ("c", _COUNTS)))
def residual_lines(spark: SparkSession, d: str) -> DataFrame:
    """The residual method behind the same interface: every mean with the residuals of all rows."""
    c = _counts(spark, d).withColumn("y", F.col("y").cast("double"))
    x = c.join(F.broadcast(dist.residual_histogram(c, "y", "mu")))  # one row, its bins counted
    x = x.withColumn("o", dist.residual_chances(F.col("residuals"), F.col("mu"), F.floor("mu").cast("double")))
    return x.select("entity", big("season"), r6("o.over", "over_"), r6("o.push", "push"))


@query(v.sql("SELECT event_id, round(ln(x / (1 - x)), 6) logit, round(1 / (1 + exp(-ln(x / (1 - x)))), 6) back FROM (SELECT event_id, least(1 - 1e-6, greatest(1e-6, (event_id % 101) / 100.0::DOUBLE)) x FROM events)"))
def logit_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    """Logits of clipped probabilities, 0 and 1 among them, and back."""
    e = v.table(spark, d, "events").withColumn("l", dist.logit((F.col("event_id") % 101) / 100.0))
    return e.select("event_id", r6("l", "logit"), r6(dist.sigmoid(F.col("l")), "back"))


@query(v.sql("SELECT residual::BIGINT residual, count(*) n, round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (), 6) mass FROM (SELECT y - floor(mu) residual FROM c WHERE mu IS NOT NULL) GROUP BY 1", ("c", _COUNTS)))
def residual_distribution(spark: SparkSession, d: str) -> DataFrame:
    """The residual histogram in full: a bounded number of bins, no thinning."""
    r = _counts(spark, d).groupBy((F.col("y") - F.floor("mu")).cast("long").alias("residual")).agg(F.count(F.lit(1)).alias("n"))
    total = r.agg(F.sum("n").alias("t"))
    return r.join(F.broadcast(total)).select("residual", "n", r6(F.col("n") / F.col("t"), "mass"))


@query(v.sql("SELECT round(greatest(0, (var_samp(y) - avg(mu)) / (avg(mu) * avg(mu))), 6) alpha FROM c WHERE mu IS NOT NULL", ("c", _COUNTS)))
def nb_alpha(spark: SparkSession, d: str) -> DataFrame:
    return m.nb_alpha(_counts(spark, d), "mu", "y").select(r6("alpha"))


@query(v.sql("SELECT round(var_samp(y) / avg(y), 6) var_over_mean, round(avg((y - mu) * (y - mu) / mu), 6) pearson, var_samp(y) / avg(y) > 1.2 AND avg((y - mu) * (y - mu) / mu) > 1.2 overdispersed FROM c WHERE mu IS NOT NULL", ("c", _COUNTS)))
def dispersion(spark: SparkSession, d: str) -> DataFrame:
    return m.dispersion(_counts(spark, d), "mu", "y").select(r6("var_over_mean"), r6("pearson"), "overdispersed")


_MIXED = "x"
for _ in range(3):
    _MIXED = f"(({_MIXED}) * ((({_MIXED}) + 48271) % 2147483647) + 11) % 2147483647"


@query(v.sql(f"""SELECT count(*) replicates, round(quantile_cont(stat, 0.025), 6) lo, round(quantile_cont(stat, 0.975), 6) hi FROM (SELECT r, sum(num) / sum(den) stat FROM (SELECT r, {_MIXED} % n AS "at" FROM (SELECT r, n, (r * 1000003 + k * 7919 + 1729) % 2147483647 x FROM (SELECT count(*) n FROM k), range(0, 2000) a(r), range(0, (SELECT count(*) FROM k)) b(k))) JOIN k USING ("at") GROUP BY 1)""",
    ("k", """SELECT row_number() OVER (ORDER BY "cluster") - 1 AS "at", sum(p - y) num, count(*) * 1.0::DOUBLE den FROM v_scored GROUP BY "cluster" """)))
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    reps = m.cluster_bootstrap(v.scored(spark, d), "cluster", F.sum(F.col("p") - F.col("y")), F.count(F.lit(1)).cast("double"))
    return m.interval(reps).select("replicates", r6("lo"), r6("hi"))


_TIMES = " + ".join(f"(x >= {t})::INT" for t in m.POISSON_CUTS)


@query(v.sql(f"""SELECT count(*) replicates, round(quantile_cont(stat, 0.025), 6) lo, round(quantile_cont(stat, 0.975), 6) hi FROM (SELECT r, sum(num * k) / sum(den * k) stat FROM
    (SELECT r, num, den, {_TIMES} k FROM (SELECT r, num, den, {_MIXED} x FROM (SELECT r, num, den, (r * 1000003 + c * 7919 + 1729) % 2147483647 x FROM range(0, 2000) a(r), (SELECT ('0x' || substr(md5("cluster"::VARCHAR), 1, 7))::BIGINT c, sum(p - y) num, count(*)::DOUBLE den FROM v_scored GROUP BY 1, "cluster")))) GROUP BY 1)"""))
def poisson_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """The interval of the mean difference over clusters, for any number of them."""
    reps = m.poisson_bootstrap(v.scored(spark, d), "cluster", F.sum(F.col("p") - F.col("y")), F.count(F.lit(1)))
    return m.interval(reps).select("replicates", r6("lo"), r6("hi"))


@query(v.sql("""SELECT seg, "value" upper_median FROM (SELECT seg, "value", row_number() OVER (PARTITION BY seg ORDER BY "value") - 1 r, count(*) OVER (PARTITION BY seg) n FROM v_scored) WHERE r = n // 2"""))
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return m.upper_median(v.scored(spark, d), "value", ["seg"])


@query(v.sql("""SELECT seg, round(avg(ln(1 + "value")) FILTER (event_id % 7 <> 0), 6) finite_mean FROM v_scored GROUP BY 1"""))
def finite_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean of what is finite: some values are made NaN first."""
    x = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.log1p("value"))
    return v.scored(spark, d).withColumn("x", x).groupBy("seg").agg(r6(m.finite_mean(F.col("x")), "finite_mean"))


_LL = "avg(CASE WHEN y = 1 THEN -ln(least(1 - 1e-6, greatest(1e-6, {0}))) ELSE -ln(1 - least(1 - 1e-6, greatest(1e-6, {0}))) END)"
_BR = "avg(({0} - y) * ({0} - y))"


@query(v.sql(f"SELECT seg, count(*) n, round({_LL.format('p')}, 6) log_loss, round({_BR.format('p')}, 6) brier FROM v_scored GROUP BY 1"))
def log_loss_brier(spark: SparkSession, d: str) -> DataFrame:
    return m.probability_metrics(v.scored(spark, d), "p", "y", ["seg"]).select("seg", "n", r6("log_loss"), r6("brier"))


BINS = ", ".join(f"({i}, {a}, {b}, {'true' if i == len(m.PLAYER_BINS) - 2 else 'false'})" for i, (a, b) in enumerate(zip(m.PLAYER_BINS[:-1], m.PLAYER_BINS[1:], strict=True)))
_REL = f"""SELECT b.bin, lo, hi, count(p) n, avg(p) mp, avg(y) my FROM (VALUES {BINS}) b(bin, lo, hi, last) LEFT JOIN v_scored ON p >= lo AND (p < hi OR last AND p <= hi) GROUP BY 1, 2, 3"""


@query(v.sql("SELECT bin::BIGINT bin, lo::DOUBLE lo, hi::DOUBLE hi, n, round(mp, 6) mean_p, round(my, 6) mean_y FROM r", ("r", _REL)))
def reliability_table(spark: SparkSession, d: str) -> DataFrame:
    return m.reliability(v.scored(spark, d), "p", "y", m.PLAYER_BINS).select(big("bin"), "lo", "hi", "n", r6("mean_p"), r6("mean_y"))


_SETS = " UNION ALL ".join(f"SELECT '{name}' name, count(*) n, sum(x) s FROM (SELECT {col} x FROM v_scored) WHERE x >= {lo} AND (x < {hi} OR {'true' if i == len(e) - 2 else 'false'} AND x <= {hi})" + f" /* {i} */"
    for name, col, e in (("play", "p2", m.PLAY_BINS), ("player", "p2", m.PLAYER_BINS), ("line", "p2", m.LINE_BINS), ("count", "ln(1 + \"value\")", [-1e300, *m.COUNT_BINS[1:-1], 1e300])) for i, (lo, hi) in enumerate(zip(e[:-1], e[1:], strict=True)))


@query(v.sql(f"SELECT name, count(*) bins, count(*) FILTER (n = 0) empty_bins, sum(n)::BIGINT n, max(n) largest FROM ({_SETS}) GROUP BY 1"))
def bin_sets(spark: SparkSession, d: str) -> DataFrame:
    """The four bin sets over one table, empty bins kept."""
    s = v.scored(spark, d).withColumn("mu", F.log1p("value"))
    out = None
    for name, col, edges in (("play", "p2", m.PLAY_BINS), ("player", "p2", m.PLAYER_BINS), ("line", "p2", m.LINE_BINS), ("count", "mu", m.COUNT_BINS)):
        t = m.reliability(s, col, "y", edges).agg(F.count(F.lit(1)).alias("bins"), F.count_if(F.col("n") == 0).alias("empty_bins"), F.sum("n").alias("n"), F.max("n").alias("largest")).withColumn("name", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


@query(v.sql("SELECT round(sum(n * abs(mp - my)) / sum(n), 6) ece, round(max(abs(mp - my)), 6) max_gap FROM r", ("r", _REL)))
def ece(spark: SparkSession, d: str) -> DataFrame:
    return m.ece(m.reliability(v.scored(spark, d), "p", "y", m.PLAYER_BINS)).select(r6("ece"), r6("max_gap"))


@query(v.sql("SELECT round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 6) auc FROM (SELECT y, rank() OVER (ORDER BY p2) + (count(*) OVER (PARTITION BY p2) - 1) / 2.0::DOUBLE rk FROM v_scored)"))
def auc_exact(spark: SparkSession, d: str) -> DataFrame:
    return m.auc(v.scored(spark, d), "p2", "y").select(r6("auc"))


@query(v.sql("SELECT round(sum(pos * tp * 1.0::DOUBLE / seen) / sum(pos), 6) average_precision FROM (SELECT pos, sum(pos) OVER w tp, sum(n) OVER w seen FROM (SELECT p2, sum(y) pos, count(*) n FROM v_scored GROUP BY 1) WINDOW w AS (ORDER BY p2 DESC ROWS UNBOUNDED PRECEDING))"))
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return m.average_precision(v.scored(spark, d), "p2", "y").select(r6("average_precision"))


@query(v.sql("SELECT season::BIGINT season, count(*) n, round(avg(abs(y - mu)), 6) mae, round(sqrt(avg((y - mu) * (y - mu))), 6) rmse, round(avg(mu - y), 6) bias, round(2 * avg(y * ln(y / mu) - (y - mu)), 6) deviance FROM c WHERE mu IS NOT NULL GROUP BY 1", ("c", _COUNTS)))
def count_metrics(spark: SparkSession, d: str) -> DataFrame:
    return m.count_metrics(_counts(spark, d), "mu", "y", ["season"]).select(big("season"), "n", r6("mae"), r6("rmse"), r6("bias"), r6("deviance"))


@query(v.sql(f"""SELECT seg::DOUBLE seg, n, round(b - a, 6) log_loss_delta, round(bb - ba, 6) brier_delta FROM (SELECT seg, count(*) n, {_LL.format('p')} a, {_LL.format('p2')} b, {_BR.format('p')} ba, {_BR.format('p2')} bb FROM v_scored GROUP BY GROUPING SETS ((seg), ()))"""))
def segment_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Challenger minus base by segment and over all, in one scan by grouping sets."""
    s = v.scored(spark, d)
    y = F.col("y")
    out = s.groupingSets([["seg"], []], "seg").agg(
        F.count(F.lit(1)).alias("n"), (m.log_loss(F.col("p2"), y) - m.log_loss(F.col("p"), y)).alias("log_loss_delta"), (m.brier(F.col("p2"), y) - m.brier(F.col("p"), y)).alias("brier_delta")
    )
    return out.select(F.col("seg").cast("double").alias("seg"), "n", r6("log_loss_delta"), r6("brier_delta"))


_ONE = "CASE WHEN y = 1 THEN -ln(least(1 - 1e-6, greatest(1e-6, {0}))) ELSE -ln(1 - least(1 - 1e-6, greatest(1e-6, {0}))) END"
_PART = """CASE WHEN month("at") <> 1 OR day("at") > 21 THEN 'late' WHEN day("at") <= 10 THEN 'early' ELSE 'middle' END"""
#: Newton steps of a label on the logit of a score: intercept a and slope b.
PLATT = """RECURSIVE {name} AS (SELECT 0 i, 0.0::DOUBLE a, 1.0::DOUBLE b UNION ALL SELECT i + 1, a + (s2 * g0 - s1 * g1) / (s0 * s2 - s1 * s1), b + (s0 * g1 - s1 * g0) / (s0 * s2 - s1 * s1) FROM
    (SELECT i, a, b, sum(q * (1 - q)) s0, sum(q * (1 - q) * l) s1, sum(q * (1 - q) * l * l) s2, sum(y - q) g0, sum((y - q) * l) g1 FROM (SELECT i, a, b, l, y, 1 / (1 + exp(-(a + b * l))) q FROM {name}, (SELECT y, ln(least(1 - 1e-6, greatest(1e-6, {p})) / (1 - least(1 - 1e-6, greatest(1e-6, {p})))) l FROM {rows})) GROUP BY 1, 2, 3) WHERE i < 25)"""


def platt_sql(name: str, p: str, rows: str, body: str, *more: tuple[str, str]) -> str:
    """body with the fitted steps of a score under a name, in front of the views it needs."""
    text = v.sql(body + f" /* {rows} */", *more)
    return text.replace("WITH ", "WITH RECURSIVE ", 1).replace(") " + body, "), " + PLATT.format(name=name, p=p, rows=rows).removeprefix("RECURSIVE ") + " " + body, 1)


def _ece_sql(p: str) -> str:
    return f"(SELECT sum(n * abs(mp - my)) / sum(n) FROM (SELECT count({p}) n, avg({p}) mp, avg(y) my FROM (VALUES {BINS}) b(bin, lo, hi, last) LEFT JOIN v_scored ON {p} >= lo AND ({p} < hi OR last AND {p} <= hi) GROUP BY bin))"


@query(platt_sql("fit", "p2", "v_scored", f"""SELECT *, material_log_loss AND bootstrap_below_zero AND ece AND slope AND "position" AND chronology promoted FROM (SELECT dl <= -0.005 material_log_loss, (SELECT quantile_cont(stat, 0.975) FROM reps) < 0 bootstrap_below_zero, {_ece_sql("p2")} <= {_ece_sql("p")} + 0.010 ece,
    (SELECT b BETWEEN 0.8 AND 1.2 FROM fit WHERE i = 25) slope, worst_position <= 0.010 AS "position", better >= 2 AND worst_segment <= 0.005 chronology FROM
    (SELECT max(x) FILTER (g = 3) dl, max(x) FILTER (g = 1) worst_position, max(x) FILTER (g = 2) worst_segment, count(*) FILTER (g = 2 AND x < 0) better FROM (SELECT avg({_ONE.format("p2")}) - avg({_ONE.format("p")}) x, grouping(seg, part) g FROM (SELECT *, {_PART} part FROM v_scored) GROUP BY GROUPING SETS ((seg), (part), ()))))""",
    ("k", f"""SELECT row_number() OVER (ORDER BY "cluster") - 1 AS "at", sum({_ONE.format("p2")} - {_ONE.format("p")}) num, count(*) * 1.0::DOUBLE den FROM v_scored GROUP BY "cluster" """),
    ("reps", f"""SELECT r, sum(num) / sum(den) stat FROM (SELECT r, {_MIXED} % n AS "at" FROM (SELECT r, n, (r * 1000003 + k * 7919 + 1729) % 2147483647 x FROM (SELECT count(*) n FROM k), range(0, 2000) a(r), range(0, (SELECT count(*) FROM k)) b(k))) JOIN k USING ("at") GROUP BY 1""")))
def promotion_gates(spark: SparkSession, d: str) -> DataFrame:
    """Six gates: material gain, bootstrap, calibration error, slope, positions and chronology."""
    from ..operators import models

    day, month = F.dayofmonth("at"), F.month("at")
    s = v.scored(spark, d).withColumn("part", F.when((month != 1) | (day > 21), "late").when(day <= 10, "early").otherwise("middle"))
    return m.promotion(s, "p", "p2", "y", slope=models.platt(s, "p2", "y")[1], cluster="cluster", position="seg", segment="part")


@query(v.sql(f"""SELECT arg_min(name, (ll, br, name)) selected FROM (SELECT 'base' name, {_LL.format('p')} ll, {_BR.format('p')} br FROM v_scored UNION ALL SELECT 'challenger', {_LL.format('p2')}, {_BR.format('p2')} FROM v_scored)"""))
def method_argmin(spark: SparkSession, d: str) -> DataFrame:
    s = v.scored(spark, d)
    long = s.select("y", F.explode(F.array(F.struct(F.lit("base").alias("name"), F.col("p").alias("q")), F.struct(F.lit("challenger").alias("name"), F.col("p2").alias("q")))).alias("x")).select("y", "x.name", "x.q")
    return m.best_method(m.probability_metrics(long, "q", "y", ["name"]), "name", ["log_loss", "brier"])


@query(v.sql("""SELECT hit::BIGINT hit, count(*) n, round(avg(over_), 6) mean_over FROM (SELECT (y > floor(mu))::INT hit, 1 - (SELECT sum(exp(-mu) * pow(mu, k) / exp(lgamma(k + 1))) FROM range(0, 40) t(k) WHERE k <= floor(mu)) over_ FROM c WHERE mu IS NOT NULL) GROUP BY 1""", ("c", _COUNTS)))
def line_proxy_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Chance of exceeding floor(mean) against how often it happens."""
    c = _counts(spark, d).withColumn("o", dist.line_chances(F.col("mu"), F.lit(0.0), F.floor("mu").cast("double"))["over"]).withColumn("hit", (F.col("y") > F.floor("mu")).cast("long"))
    return c.groupBy("hit").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("o"), "mean_over"))


@query(v.sql("""SELECT arg_min(w, (ll, w)) weight, round(min(ll), 6) log_loss FROM (SELECT w, avg(CASE WHEN y = 1 THEN -ln(least(1 - 1e-6, greatest(1e-6, w * p + (1 - w) * p2))) ELSE -ln(1 - least(1 - 1e-6, greatest(1e-6, w * p + (1 - w) * p2))) END) ll
    FROM v_scored, (VALUES (1.0::DOUBLE), (0.75::DOUBLE), (0.5::DOUBLE), (0.25::DOUBLE)) b(w) GROUP BY 1)"""))
def blend_select(spark: SparkSession, d: str) -> DataFrame:
    """The convex blend of two scores with the least log loss; all blends in one scan."""
    s = v.scored(spark, d).select("p", "p2", "y", F.explode(F.array(*(F.lit(w) for w in (1.0, 0.75, 0.5, 0.25)))).alias("w"))
    t = m.probability_metrics(s.withColumn("q", F.col("w") * F.col("p") + (F.lit(1.0) - F.col("w")) * F.col("p2")), "q", "y", ["w"])
    return t.agg(F.min_by("w", F.struct("log_loss", "w")).alias("weight"), r6(F.min("log_loss"), "log_loss"))


@query(v.sql("""SELECT count(*) n, round(median(age), 6) median_age, round(quantile_cont(age, 0.9), 6) p90_age, round(max(age), 6) max_age FROM (SELECT date_diff('microsecond', quote_time, cutoff) / 1e6 age FROM v_eligible)"""))
def quote_age_summary(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import timing

    q = v.eligible_quotes(spark, d).withColumn("age", timing.seconds_between(F.col("quote_time"), F.col("cutoff")))
    at = m.quantiles(q, "age", {"median_age": 0.5, "p90_age": 0.9}).select(r6("median_age"), r6("p90_age"))
    return q.agg(F.count(F.lit(1)).alias("n"), r6(F.max("age"), "max_age")).join(F.broadcast(at))  # one row each
