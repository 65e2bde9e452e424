"""Season-forward models on orders and plays.  Fits by Newton's method have SQL of the same steps; boosted trees have none."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..operators import boosting, lag, metrics, models
from ..sources import staging
from . import views as v
from .newton_sql import fit, recursive
from .q_lag import DAY, HIST
from .q_stats import BINS, PLATT, platt_sql
from .registry import big, query, r6

FIELDS = ["last3_metric", "last8_metric", "ewma_metric", "last5_share"]
USAGE = ["last5_carries", "last5_targets", "last8_carries", "last8_targets"]
VALUE = ["last5_all_value", "last8_all_value", "last5_share", "ewma_all_value"]
RATE = ["last8_hit"]
TEAM = ["team_metric", "last3_metric"]
#: Families of fields: rate, value, usage and rate, usage and value, and both with the team, without and with rate.
FAMILIES = {"A": RATE, "B": VALUE, "C": USAGE + RATE, "D": USAGE + VALUE, "E": TEAM + USAGE + VALUE, "F": TEAM + USAGE + VALUE + RATE}

OWN = sorted({*FIELDS, *USAGE, *VALUE, *RATE})


def frame(spark: SparkSession, d: str) -> DataFrame:
    """Lagged features with labels: whether an order scores, and how often.  Written once an application."""
    return staging.once(spark, "features", d, lambda: _frame(spark, d))


def _frame(spark: SparkSession, d: str) -> DataFrame:
    g = v.player_games(spark, d).withColumn("hit", (F.coalesce("tds", F.lit(0)) > 0).cast("double"))
    t = v.games(spark, d).select("game_id", "entity", "grp", "season", "priority", "kickoff", "prediction_time")
    metrics_ = ["metric", "carries", "targets", "all_value", "hit"]
    own = lag.prefix_features(g, t, ["entity"], metrics=metrics_, shares={"share": ("td_value", "all_value")}, windows={"last3": 3, "last5": 5, "last8": 8}, null_policy="skip", only=OWN)
    days = v.games(spark, d).groupBy("grp", "kickoff").agg(F.avg("metric").alias("metric")).withColumn("available_at", F.col("kickoff") + F.expr("INTERVAL 1 DAY")).withColumn("day_id", F.date_format("kickoff", "yyyyMMdd").cast("long"))
    team = lag.prefix_features(days, t.select("game_id", "grp", "prediction_time"), ["grp"], row_id="day_id", metrics=["metric"], windows={"team": 5}, with_ewma=False).select("game_id", "team_metric")
    lab = g.select("game_id", F.col("hit").alias("label"), F.coalesce("tds", F.lit(0)).cast("double").alias("tds"))
    return own.join(team, "game_id").join(lab, "game_id")


def _seasons(df: DataFrame) -> tuple[int, int]:
    lo, hi = df.agg(F.min("season"), F.max("season")).head()
    return lo, hi


#: The frame in SQL: every feature of the models, with labels.
_H = HIST.replace("h.tds, t.kickoff", "h.tds, h.carries, h.targets, t.kickoff")
_EW = "sum({0} * pow(0.5::DOUBLE, (rn - 1) / 3.0::DOUBLE)) / sum(pow(0.5::DOUBLE, (rn - 1) / 3.0::DOUBLE)) FILTER ({0} IS NOT NULL)"
_OWN = f"""SELECT game_id, avg(metric) FILTER (rn <= 3) last3_metric, avg(metric) FILTER (rn <= 8) last8_metric, {_EW.format("metric")} ewma_metric, avg(carries) FILTER (rn <= 5) last5_carries, avg(targets) FILTER (rn <= 5) last5_targets,
    avg(carries) FILTER (rn <= 8) last8_carries, avg(targets) FILTER (rn <= 8) last8_targets, avg(all_value) FILTER (rn <= 5) last5_all_value, avg(all_value) FILTER (rn <= 8) last8_all_value, {_EW.format("all_value")} ewma_all_value,
    avg((coalesce(tds, 0) > 0)::INT) FILTER (rn <= 8) last8_hit, CASE WHEN sum(all_value) FILTER (rn <= 5) > 0 THEN sum(td_value) FILTER (rn <= 5) / sum(all_value) FILTER (rn <= 5) END last5_share FROM h GROUP BY 1"""
_TEAM = """SELECT s.game_id, avg(y.metric) team_metric FROM (SELECT t.game_id, t.grp, max(rn) top FROM v_game t JOIN day_rank r ON r.grp = t.grp AND r.available_at < t.prediction_time GROUP BY 1, 2) s JOIN day_rank y ON y.grp = s.grp AND y.rn BETWEEN s.top - 4 AND s.top GROUP BY 1"""
_FRAME = [("h", _H), ("own", _OWN), ("day_rank", "SELECT *, row_number() OVER (PARTITION BY grp ORDER BY kickoff) rn FROM (" + DAY + ")"), ("team", _TEAM),
    ("f", "SELECT g.game_id, g.season, g.priority, own.* EXCLUDE (game_id), team_metric, (coalesce(g.tds, 0) > 0)::INT label, coalesce(g.tds, 0)::DOUBLE tds FROM v_player_game g LEFT JOIN own USING (game_id) LEFT JOIN team USING (game_id)")]
_LAST = "(SELECT max(season) FROM f)"
_SCORES = "count(*) n, round(avg(CASE WHEN label = 1 THEN -ln(least(1 - 1e-6, greatest(1e-6, p))) ELSE -ln(1 - least(1 - 1e-6, greatest(1e-6, p))) END), 6) log_loss, round(avg((p - label) * (p - label)), 6) brier"
_PRIORITIES = [f"coalesce(priority, 'Unknown') = '{x}'" for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]


def _scored(table: DataFrame, *by: str) -> DataFrame:
    return table.select(*by, "n", r6("log_loss"), r6("brier"))


@query(recursive(v.sql(f"SELECT season::BIGINT season, (season - 1)::BIGINT fit_upto, {_SCORES} FROM fit_scored GROUP BY 1, 2", *_FRAME,
    ("train", "SELECT s.season model, f.*, label y FROM f JOIN (SELECT DISTINCT season FROM f) s ON f.season < s.season WHERE s.season >= (SELECT min(season) FROM f) + 2"),
    ("test", "SELECT season model, * FROM f"), *fit("fit", "train", "test", FIELDS, hot=_PRIORITIES))))
def logistic_forward(spark: SparkSession, d: str) -> DataFrame:
    """Every season but the first two, each scored by a model of those before it."""
    f = frame(spark, d)
    lo, hi = _seasons(f)
    out = models.season_scores(f, "season", list(range(lo + 2, hi + 1)), FIELDS, "label", ("priority",))
    return _scored(metrics.probability_metrics(out, "p", "label", ["season", "fit_upto"]), big("season"), big("fit_upto"))


@query(recursive(v.sql("""SELECT season::BIGINT season, count(*) n, round(avg(abs(tds - p)), 6) mae, round(sqrt(avg((tds - p) * (tds - p))), 6) rmse, round(avg(p - tds), 6) bias, round(2 * avg(CASE WHEN tds > 0 THEN tds * ln(tds / p) ELSE 0 END - (tds - p)), 6) deviance FROM fit_scored GROUP BY 1""", *_FRAME,
    ("train", f"SELECT 1 model, *, tds y FROM f WHERE season < {_LAST}"), ("test", f"SELECT 1 model, * FROM f WHERE season = {_LAST}"), *fit("fit", "train", "test", FIELDS, link="poisson", ridge="0.15::DOUBLE * count(*)"))))
def poisson_forward(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the last season by a log-linear model of those before, with the ridge on the mean loss."""
    f = frame(spark, d)
    _, hi = _seasons(f)
    out = models.season_scores(f, "season", [hi], FIELDS, "tds", link="poisson", ridge=0.15, out="mu")
    return metrics.count_metrics(out, "mu", "tds", ["season"]).select(big("season"), "n", *(r6(c) for c in ("mae", "rmse", "bias", "deviance")))


@query()
def trees_forward(spark: SparkSession, d: str) -> DataFrame:
    """Both challengers in each of their configurations, scored on the last season."""
    f = frame(spark, d)
    _, hi = _seasons(f)
    train, test = models.forward(f, "season", hi - 1, hi)
    ready, ks = models.tree_rows(train, FIELDS, ["label"], ["tds"]), range(len(models.TREES))
    with ThreadPoolExecutor(6) as pool:  # their scans are short: all six fits share the cluster
        chance = [pool.submit(models.fit_trees, ready, FIELDS, "label", config=k) for k in ks]
        count = [pool.submit(models.fit_trees, ready, FIELDS, "tds", config=k, counts=True) for k in ks]
    rows = None
    for k in ks:
        p = models.score_probability(chance[k].result(), test, FIELDS)
        c = models.score_mean(count[k].result(), p, FIELDS, log=True)
        a = metrics.probability_metrics(c, "p", "label")
        one = a.join(F.broadcast(metrics.count_metrics(c, "mu", "tds").select("mae", "deviance"))).withColumn("config", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(recursive(v.sql(f"SELECT priority, CASE WHEN p IS NULL THEN 'insufficient' ELSE 'fitted' END status, {_SCORES} FROM (SELECT f.*, p FROM f LEFT JOIN (SELECT game_id, p FROM fit_scored) USING (game_id) WHERE season = {_LAST}) GROUP BY 1, 2", *_FRAME,
    ("train", f"SELECT priority model, *, label y FROM f WHERE season < {_LAST} AND priority IN (SELECT priority FROM f WHERE season < {_LAST} GROUP BY 1 HAVING count(*) >= 500 AND sum(label) >= 50)"),
    ("test", f"SELECT priority model, * FROM f WHERE season = {_LAST}"), *fit("fit", "train", "test", FIELDS))))
def group_models(spark: SparkSession, d: str) -> DataFrame:
    """One model per priority where there are rows and positives enough."""
    f = frame(spark, d)
    _, hi = _seasons(f)
    train, test = models.forward(f, "season", hi - 1, hi)
    out = models.group_models(train, test, "priority", FIELDS, "label")
    return _scored(metrics.probability_metrics(out, "p", "label", ["priority", "status"]), "priority", "status")


@query(recursive(v.sql(" UNION ALL ".join(f"SELECT '{k}' family, {len(fs)} n_fields, {_SCORES} FROM fit{k}_scored" for k, fs in FAMILIES.items()), *_FRAME,
    ("train", f"SELECT 1 model, *, label y FROM f WHERE season < {_LAST}"), ("test", f"SELECT 1 model, * FROM f WHERE season = {_LAST}"), *(part for k, fs in FAMILIES.items() for part in fit(f"fit{k}", "train", "test", fs)))))
def family_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Six families of fields, scored on the same last season: a registry of their scores."""
    f = frame(spark, d)
    _, hi = _seasons(f)
    train, test = models.forward(f, "season", hi - 1, hi)
    return _scored(models.ablation(train, test, FAMILIES, "label"), "family", "n_fields")


#: The first count tree in SQL: exact cuts, then a level at a time the best split of every node by sums over bins.
_BOOST = boosting.BoostConfig(trees=1, bins=16)


def _first_tree() -> list[tuple[str, str]]:
    k, c = len(FIELDS), _BOOST
    cut = "list_sort(list_distinct(list_transform(range(1, {b}), lambda i: s[floor((len(s) - 1) * (i / {b}.0::DOUBLE))::BIGINT + 1])))"
    parts = [
        ("train", f"SELECT * FROM f WHERE season < {_LAST}"),
        ("cut", "SELECT [" + ", ".join(cut.format(b=c.bins).replace("(s)", f"(s{i})").replace("s[", f"s{i}[") for i in range(k)) + "] cuts, m FROM (SELECT " + ", ".join(f"list_sort(list({x}) FILTER ({x} IS NOT NULL)) s{i}" for i, x in enumerate(FIELDS)) + ", avg(tds) m FROM train)"),
        ("rows0", "SELECT m - tds g, m h, [" + ", ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 + len(list_filter(cuts[{i + 1}], lambda z: z < {x})) END" for i, x in enumerate(FIELDS)) + "] bins, 0 node FROM train, cut"),
    ]
    for d in range(c.depth):
        leaves = " - ".join([str(c.leaves - 1), *(f"(SELECT count(*) FROM kept{e})" for e in range(d))])
        score = lambda g, h: f"{g} * {g} / ({h} + {c.l2})"
        parts += [
            (f"bin{d}", f"SELECT node, field, bins[field] bin, sum(g) g, sum(h) h, count(*) n FROM rows{d}, range(1, {k + 1}) r(field) WHERE node >= 0 GROUP BY 1, 2, 3"),
            (f"run{d}", f"SELECT node, field, bin, sum(g) OVER w lg, sum(h) OVER w lh, sum(n) OVER w ln, sum(g) OVER p g, sum(h) OVER p h, sum(n) OVER p n FROM bin{d} WINDOW p AS (PARTITION BY node, field), w AS (PARTITION BY node, field ORDER BY bin ROWS UNBOUNDED PRECEDING)"),
            (f"best{d}", f"SELECT node, field, bin, round({score('lg', 'lh')} + {score('(g - lg)', '(h - lh)')} - {score('g', 'h')}, 9) gain FROM run{d} WHERE ln >= {c.least_rows} AND n - ln >= {c.least_rows} QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, field, bin) = 1"),
            (f"kept{d}", f"SELECT * FROM best{d} WHERE gain > 0 QUALIFY row_number() OVER (ORDER BY gain DESC, node) <= {leaves}"),
            (f"rows{d + 1}", f"SELECT g, h, bins, CASE WHEN k.node IS NULL THEN -1 ELSE 2 * r.node + 1 + (bins[field] > bin)::INT END node FROM rows{d} r LEFT JOIN kept{d} k USING (node)"),
        ]
    return parts


@query(v.sql("SELECT node::BIGINT node, [" + ", ".join(f"'{x}'" for x in FIELDS) + "][field] field, round(CASE WHEN bin > 0 THEN cuts[field][bin] END, 6) cut, round(gain, 4) gain FROM (" + " UNION ALL ".join(f"SELECT * FROM kept{d}" for d in range(_BOOST.depth)) + "), cut", *_FRAME, *_first_tree()))
def count_trees_first(spark: SparkSession, d: str) -> DataFrame:
    """The splits of the first tree of counts under Poisson loss."""
    f = frame(spark, d)
    _, hi = _seasons(f)
    model = boosting.fit_counts(models.forward(f, "season", hi - 1, hi)[0], FIELDS, "tds", _BOOST)
    rows = [(node, FIELDS[i], round(model.cuts[i][b - 1], 6) if b else None, round(t.gain[node], 4)) for t in model.trees for node, (i, b) in t.split.items()]
    return spark.createDataFrame(rows, "node long, field string, cut double, gain double")


@query()
def count_boosting(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the last season by boosted trees under Poisson loss, fitted on those before."""
    f = frame(spark, d)
    _, hi = _seasons(f)
    train, test = models.forward(f, "season", hi - 1, hi)
    model = boosting.fit_counts(train, FIELDS, "tds", boosting.BoostConfig(trees=30, rate=0.15))
    return metrics.count_metrics(test.withColumn("mu", model.mean()), "mu", "tds", ["season"])


_HALF = """SELECT *, "at" < (SELECT min(ts) + to_microseconds(CAST(date_diff('microsecond', min(ts), max(ts)) AS BIGINT) // 2) FROM events) first_half FROM v_scored"""
_CAL = "1 / (1 + exp(-(a + b * ln(least(1 - 1e-6, greatest(1e-6, p2)) / (1 - least(1 - 1e-6, greatest(1e-6, p2)))))))"
_L = "avg(CASE WHEN y = 1 THEN -ln(least(1 - 1e-6, greatest(1e-6, {0}))) ELSE -ln(1 - least(1 - 1e-6, greatest(1e-6, {0}))) END)"


def _ece_of(score: str) -> str:
    return f"(SELECT sum(n * abs(mp - my)) / sum(n) FROM (SELECT count(z) n, avg(z) mp, avg(y) my FROM (VALUES {BINS}) v(bin, lo, hi, last) LEFT JOIN (SELECT y, {score} z FROM half, (SELECT a, b FROM fit WHERE i = 25) WHERE NOT first_half) ON z >= lo AND (z < hi OR last AND z <= hi) GROUP BY bin))"


@query(platt_sql("fit", "p2", "early", f"""SELECT (SELECT count(*) FROM v_scored) AS rows, round(a, 4) intercept, round(b, 4) slope, l1 < l0 AND b1 < b0 AND {_ece_of(_CAL)} <= {_ece_of("p2")} accepted FROM (SELECT a, b, {_L.format(_CAL)} l1, {_L.format("p2")} l0, avg(({_CAL} - y) * ({_CAL} - y)) b1, avg((p2 - y) * (p2 - y)) b0 FROM half, (SELECT a, b FROM fit WHERE i = 25) WHERE NOT first_half GROUP BY 1, 2)""", ("half", _HALF), ("early", "SELECT * FROM half WHERE first_half")))
def platt_accept(spark: SparkSession, d: str) -> DataFrame:
    """A sigmoid fitted on one half in time, accepted only if it helps on the other."""
    s = v.scored(spark, d).withColumn("_us", F.unix_micros(F.col("at").cast("timestamp")))
    lo, hi = s.agg(F.min("_us"), F.max("_us")).head()
    mid = (lo or 0) + ((hi or 0) - (lo or 0)) // 2
    fitted, ok = models.calibrate_if_better(s.where(F.col("_us") < mid), s.where(F.col("_us") >= mid), "p2", "y")
    return s.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(round(fitted[0], 4)).alias("intercept"), F.lit(round(fitted[1], 4)).alias("slope"), F.lit(ok).alias("accepted"))


@query(platt_sql("fit", "p", "v_scored", "SELECT 'p' score, round(a, 4) intercept, round(b, 4) slope FROM fit WHERE i = 25 UNION ALL SELECT 'p2', round(a, 4), round(b, 4) FROM fit2 WHERE i = 25").replace("SELECT 'p' score", PLATT.format(name="fit2", p="p2", rows="v_scored").removeprefix("RECURSIVE ").join([", ", " "]) + "SELECT 'p' score", 1).replace(") , fit2", "), fit2"))
def calibration_slope(spark: SparkSession, d: str) -> DataFrame:
    """Intercept and slope of the label on each score's logit."""
    s = v.scored(spark, d)
    rows = [(name, *(round(x, 4) for x in models.platt(s, name, "y"))) for name in ("p", "p2")]
    return spark.createDataFrame(rows, "score string, intercept double, slope double")


#: Members of one season's orders with three families of shares, some of them missing, a label and what their order expects.
_MEMBERS = """SELECT game_id, a / nullif(sum(a) OVER w, 0) a, b / nullif(sum(b) OVER w, 0) b, c / nullif(sum(c) OVER w, 0) c, y, 0.5::DOUBLE * count(*) OVER w e FROM (SELECT game_id, actor, sum("value") FILTER (kind IS NOT NULL) a, sum(air)::DOUBLE b,
    sum(quantity) FILTER (line <> 7)::DOUBLE c, max(("value" * 60 + coalesce(air, part % 60) + (quantity - 25) * tax * 20 > 65)::INT) y FROM v_plays GROUP BY 1, 2) JOIN (SELECT game_id FROM v_game WHERE season = 1995) USING (game_id) WINDOW w AS (PARTITION BY game_id)"""
_TRIED = """SELECT x, z, avg((1 - exp(-e * share) - y) * (1 - exp(-e * share) - y)) loss FROM (SELECT *, CASE WHEN sum(raw) OVER w > 0 THEN raw / sum(raw) OVER w ELSE 1.0::DOUBLE / count(*) OVER w END share FROM
    (SELECT x, z, game_id, e, y, coalesce((x * coalesce(a, 0) + z * coalesce(b, 0) + (1 - x - z) * coalesce(c, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE x END + CASE WHEN b IS NULL THEN 0 ELSE z END + CASE WHEN c IS NULL THEN 0 ELSE 1 - x - z END, 0), 1) raw FROM members, {0}) WINDOW w AS (PARTITION BY x, z, game_id)) GROUP BY 1, 2"""


def _zoom(levels: int = 8) -> list[tuple[str, str]]:
    """Parts of a search for the best weights: grids of 7 x 7 points, each a third as wide as the one before, around its best."""
    parts, step = [("try0", "SELECT i / 10.0::DOUBLE x, j / 10.0::DOUBLE z FROM range(1, 10) a(i), range(1, 10) b(j) WHERE i + j < 10")], 0.1
    for k in range(levels):
        parts.append((f"best{k}", f"SELECT x, z, loss FROM ({_TRIED.format(f'try{k}')}) ORDER BY loss LIMIT 1"))
        step /= 3
        parts.append((f"try{k + 1}", f"SELECT x + i * {step}::DOUBLE x, z + j * {step}::DOUBLE z FROM best{k}, range(-3, 4) a(i), range(-3, 4) b(j) WHERE x + i * {step} >= 0 AND z + j * {step} >= 0 AND x + i * {step} + z + j * {step} <= 1"))
    return parts[:-1]


@query(v.sql("SELECT 'a' field, round(x, 3) weight, round(loss, 8) loss FROM best7 UNION ALL SELECT 'b', round(z, 3), round(loss, 8) FROM best7 UNION ALL SELECT 'c', round(1 - x - z, 3), round(loss, 8) FROM best7", ("members", _MEMBERS), *_zoom()))
def simplex_fit(spark: SparkSession, d: str) -> DataFrame:
    """Weights of three families of shares by which an order's expectation is dealt best to its members, fitted on one season."""
    members = staging.stage(allocation_members(spark, d), "members")
    w, loss, _ = models.fit_simplex(members, ["game_id"], ["a", "b", "c"], "e", "y")
    return spark.createDataFrame([(f, round(float(x), 3), round(loss, 8)) for f, x in zip("abc", w, strict=True)], "field string, weight double, loss double")


def allocation_members(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.col("value") * 60 + F.coalesce("air", F.col("part") % 60) + (F.col("quantity") - 25) * F.col("tax") * 20 > 65).cast("double")
    p = v.plays(spark, d).join(v.games(spark, d).where("season = 1995").select("game_id"), "game_id")
    s = p.groupBy("game_id", "actor").agg(F.sum(F.when(F.col("kind").isNotNull(), F.col("value"))).alias("a"), F.sum("air").cast("double").alias("b"), F.sum(F.when(F.col("line") != 7, F.col("quantity"))).cast("double").alias("c"), F.max(hit).alias("y"))
    w = Window.partitionBy("game_id")
    return s.withColumns({x: F.try_divide(F.col(x), F.sum(x).over(w)) for x in "abc"} | {"e": 0.5 * F.count(F.lit(1)).over(w)})


@query()
def importance(spark: SparkSession, d: str) -> DataFrame:
    """Standardised coefficients and the tree gains of each configuration, the largest first."""
    f = frame(spark, d)
    names = [*FIELDS, *(f"{x}__missing" for x in FIELDS)]
    lr = models.fit_logistic(f, FIELDS, "label").stages[-1]
    ready, rows = models.tree_rows(f, FIELDS, ["label"]), []
    with ThreadPoolExecutor(3) as pool:
        fits = [pool.submit(models.fit_trees, ready, FIELDS, "label", config=k) for k in range(len(models.TREES))]
    for k, fit_ in enumerate(fits):
        gain = fit_.result().gains()
        whole = sum(gain.values()) or 1.0
        rows += [(n, float(c), k, gain[n] / whole) for n, c in zip(names, lr.coefficients.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, coefficient double, config int, gain double").orderBy(F.desc(F.abs("coefficient")), "feature", "config")


_ROWS = """SELECT y, ln(least(1 - 1e-6, greatest(1e-6, p2)) / (1 - least(1 - 1e-6, greatest(1e-6, p2)))) u, (p - p2) * 10.0::DOUBLE w FROM v_scored"""
#: Cofactors of the Fisher information of (1, u, w), and its determinant.
_COF = """h11 * h22 - h12 * h12 c00, h02 * h12 - h01 * h22 c01, h01 * h12 - h02 * h11 c02, h00 * h22 - h02 * h02 c11, h01 * h02 - h00 * h12 c12, h00 * h11 - h01 * h01 c22, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) det"""
_STEP = f"""SELECT i, a, b, c, {_COF}, g0, g1, g2 FROM (SELECT i, a, b, c, sum(k) h00, sum(k * u) h01, sum(k * w) h02, sum(k * u * u) h11, sum(k * u * w) h12, sum(k * w * w) h22, sum(y - q) g0, sum((y - q) * u) g1, sum((y - q) * w) g2
    FROM (SELECT *, q * (1 - q) k FROM (SELECT i, a, b, c, y, u, w, 1 / (1 + exp(-(a + b * u + c * w))) q FROM fit, x)) GROUP BY 1, 2, 3, 4)"""


@query(v.sql("SELECT 1 AS one FROM v_scored").split(" SELECT 1 AS one")[0].replace("WITH ", "WITH RECURSIVE ", 1) + f""", x AS ({_ROWS}), fit AS (SELECT 0 i, 0.0::DOUBLE a, 1.0::DOUBLE b, 0.0::DOUBLE c UNION ALL SELECT i + 1, a + (c00 * g0 + c01 * g1 + c02 * g2) / det, b + (c01 * g0 + c11 * g1 + c12 * g2) / det, c + (c02 * g0 + c12 * g1 + c22 * g2) / det FROM ({_STEP}) WHERE i < 25),
    info AS ({_STEP.replace("FROM fit, x", "FROM (SELECT * FROM fit WHERE i = 25) fit, x")}) SELECT term, round(k, 4) coefficient, round(se, 4) se, round(k / se, 2) z FROM (SELECT 'intercept' term, a k, sqrt(c00 / det) se FROM info UNION ALL SELECT 'market', b, sqrt(c11 / det) FROM info UNION ALL SELECT 'gap', c, sqrt(c22 / det) FROM info)""")
def residual_test(spark: SparkSession, d: str) -> DataFrame:
    """Whether a model adds to the market: the label on the market's logit and the scaled difference."""
    s = v.scored(spark, d).withColumn("market", dist.logit(F.col("p2"))).withColumn("gap", (F.col("p") - F.col("p2")) * 10.0)
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=["market", "gap"], outputCol="features").transform(s)
    m = LogisticRegression(labelCol="y", regParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(x)
    out = models.wald(s, ["market", "gap"], "y", m.coefficients.toArray().tolist(), m.intercept)
    return spark.createDataFrame([(n, round(b, 4), round(e, 4), round(z, 2)) for n, b, e, z in out], "term string, coefficient double, se double, z double")


_FEATURES = """SELECT game_id, avg(metric) FILTER (rn <= 3) last3_metric, avg(metric) FILTER (rn <= 8) last8_metric, sum(metric * pow(0.5::DOUBLE, (rn - 1) / 3.0::DOUBLE)) / sum(pow(0.5::DOUBLE, (rn - 1) / 3.0::DOUBLE)) ewma_metric,
    CASE WHEN sum(all_value) FILTER (rn <= 5) > 0 THEN sum(td_value) FILTER (rn <= 5) / sum(all_value) FILTER (rn <= 5) END last5_share FROM h GROUP BY 1"""
_CORR = " UNION ALL ".join(f"SELECT '{a}' \"left\", '{b}' \"right\", corr({a}, {b}) c FROM f WHERE last5_share IS NOT NULL" for i, a in enumerate(FIELDS) for b in FIELDS[i + 1 :])


@query(v.sql(f'SELECT "left", "right", round(c, 6) corr FROM ({_CORR}) WHERE abs(c) >= 0.5', ("h", HIST), ("f", _FEATURES)))
def corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of fields that say the same."""
    return models.correlated_pairs(frame(spark, d), FIELDS, least=0.5).select("left", "right", r6("corr"))


@query()
def scenario_grid(spark: SparkSession, d: str) -> DataFrame:
    """A grid of contexts scored by a model of the plays, with the ratio of near to far of each kind and whether scores only fall with distance."""
    p = v.plays(spark, d).where("kind IS NOT NULL").select(F.col("yardline").cast("double").alias("yard"), F.col("air").cast("double").alias("air"), "kind", F.col("td").cast("double").alias("label"))
    m = models.fit_logistic(p, ["yard", "air"], "label", ["kind"])
    grid = p.select("kind").distinct().select("kind", F.explode(F.array(*(F.lit(float(x)) for x in (1, 5, 20, 60)))).alias("yard")).withColumn("air", F.lit(10.0))
    scored = models.score_probability(m, grid, ["yard", "air"], ["kind"])
    return scored.join(models.sanity_ratios(scored, ["kind"], "yard", 1.0, 60.0), "kind")
