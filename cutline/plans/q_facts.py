"""Facts of plays and games: classification, counts, roll-ups, coverage, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist
from ..operators import aggregates as agg
from ..operators import joins
from . import views as v
from .registry import big, query, r6

_CLASS = """SELECT game_id, actor, kind, td, CASE WHEN tax = 0 THEN 'void' WHEN quantity = 1 THEN 'kneel' WHEN kind IS NULL THEN 'no_type' WHEN td = 1 AND line = 6 THEN 'lateral' WHEN td = 1 AND part % 10 = 0 THEN 'other_scorer' END reason FROM v_plays"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    p = v.plays(spark, d)
    scorer = F.when(F.col("part") % 10 != 0, F.col("actor"))
    c = agg.classify(F.col("kind"), void=F.col("tax") == 0, kneel=F.col("quantity") == 1, actor=F.col("actor"), scored=F.col("td"), scorer=scorer, lateral=F.col("line") == 6)
    return p.select("game_id", "part", "line", c.alias("c"))


@query(v.sql("""SELECT CASE WHEN reason IS NULL THEN kind END "type", CASE WHEN reason IS NULL THEN td END::DOUBLE AS label, reason, count(*) n, count(DISTINCT CASE WHEN reason IS NULL THEN actor END) actors FROM c GROUP BY 1, 2, 3""", ("c", _CLASS)))
def classify_opportunities(spark: SparkSession, d: str) -> DataFrame:
    c = _classified(spark, d)
    return c.groupBy(F.col("c.type").alias("type"), F.col("c.label").cast("double").alias("label"), F.col("c.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c.actor").alias("actors"))


@query(v.sql("""SELECT count(*) FILTER (reason = 'void') void, count(*) FILTER (reason = 'lateral') AS "lateral", count(*) FILTER (reason = 'other_scorer') other_scorer, count(*) FILTER (reason IS NULL) kept FROM c""", ("c", _CLASS)))
def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("c.reason")
    return _classified(spark, d).agg(*(F.count_if(r == x).alias(x) for x in ("void", "lateral", "other_scorer")), F.count_if(r.isNull()).alias("kept"))


@query(v.sql("""SELECT game_id, part, actor, line::BIGINT line, yardline::BIGINT yard, round(ln(1 + yardline), 6) log_yard, (yardline <= 20)::BIGINT inside_20, (yardline <= 5)::BIGINT inside_5, (air - yardline)::DOUBLE past_line, (air >= yardline)::INT::DOUBLE end_zone_target, coalesce(kind, 'Unknown') category FROM v_plays"""))
def context_projection(spark: SparkSession, d: str) -> DataFrame:
    c = agg.play_context(F.col("yardline"), F.col("air"), F.col("kind"))
    return v.plays(spark, d).select("game_id", "part", "actor", big("line"), big(c["yard"], "yard"), r6(c["log_yard"], "log_yard"), big(c["inside_20"], "inside_20"), big(c["inside_5"], "inside_5"), c["past_line"].cast("double").alias("past_line"), c["end_zone_target"].cast("double").alias("end_zone_target"), c["category"].alias("category"))


@query(v.sql("""SELECT game_id, count(*) FILTER (kind = 'rushing' AND yardline <= 20) red_zone_carries, count(*) FILTER (kind = 'rushing' AND yardline <= 10) inside_10_carries, count(*) FILTER (kind = 'rushing' AND yardline <= 5) inside_5_carries,
    count(*) FILTER (kind IS NOT NULL AND yardline <= 5) goal_line, count(*) FILTER (kind = 'receiving' AND yardline <= 20) red_zone_targets, CASE WHEN count(*) FILTER (kind = 'receiving' AND air IS NULL) = 0 THEN count(*) FILTER (kind = 'receiving' AND air >= yardline) END::DOUBLE end_zone_targets FROM v_plays GROUP BY 1"""))
def zone_counts(spark: SparkSession, d: str) -> DataFrame:
    return agg.zone_counts(v.plays(spark, d), ["game_id"]).withColumn("end_zone_targets", F.col("end_zone_targets").cast("double"))


@query(v.sql("""SELECT actor, round(count(*) FILTER (near AND scored) * 1.0::DOUBLE / nullif(count(*) FILTER (near), 0), 6) rate, count(*) FILTER (near) trips, count(*) FILTER (near AND scored) conversions FROM
    (SELECT actor, game_id, bool_or(yardline <= 20) near, bool_or(td = 1) scored FROM v_plays GROUP BY 1, 2) GROUP BY 1"""))
def drive_two_level(spark: SparkSession, d: str) -> DataFrame:
    """Any-near and any-score per drive, then trips and conversions."""
    out = agg.drive_conversion(v.plays(spark, d), ["actor"], "game_id", near=F.col("yardline") <= 20, scored=F.col("td") == 1)
    return out.select("actor", "trips", "conversions", r6("rate"))


@query(v.sql("""SELECT actor, count(*) plays, round(avg("value"), 6) mean_value, round(avg("value") FILTER (kind = 'rushing'), 6) rush_value, round(avg("value") FILTER (kind = 'receiving'), 6) catch_value, round(avg(("value" >= 0.8)::INT), 6) explosive_rate,
    sum(td)::BIGINT tds, (count(DISTINCT drive) + max((drive IS NULL)::INT))::BIGINT drives FROM v_plays GROUP BY 1"""))
def efficiency_conditional(spark: SparkSession, d: str) -> DataFrame:
    out = agg.efficiency(v.plays(spark, d), ["actor"], kind="kind", value="value", td="td", drive="drive", explosive=0.8)
    return out.select("actor", "plays", r6("mean_value"), r6("rush_value"), r6("catch_value"), r6("explosive_rate"), "tds", big("drives"))


_ROLL = """SELECT actor % 10 grp, actor, coalesce(sum("value") FILTER (kind = 'rushing'), 0) rv, coalesce(sum("value") FILTER (kind = 'receiving'), 0) cv, sum("value") tv, count(*) FILTER (kind = 'rushing') rushes, count(*) FILTER (kind = 'receiving') targets FROM v_plays GROUP BY 1, 2"""


@query(v.sql("""SELECT grp, actor, round(rv, 4) rushing_value, round(CASE WHEN sum(rv) OVER w > 0 THEN rv / sum(rv) OVER w END, 6) rushing_share, round(CASE WHEN sum(tv) OVER w > 0 THEN tv / sum(tv) OVER w END, 6) total_share, round(rv / nullif(rushes, 0), 6) value_per_rush,
    round(cv / nullif(targets, 0), 6) value_per_target FROM r WINDOW w AS (PARTITION BY grp)""", ("r", _ROLL)))
def value_rollup_shares(spark: SparkSession, d: str) -> DataFrame:
    p = v.plays(spark, d).withColumn("grp", F.col("actor") % 10)
    out = agg.value_rollup(p, group=["grp"], member="actor", kind="kind", value="value")
    return out.select("grp", "actor", F.round("rushing_value", 4).alias("rushing_value"), r6("rushing_share"), r6("total_share"), r6("value_per_rush"), r6("value_per_target"))


@query(v.sql("""SELECT game_id, round(ln(1 + sum("value")), 6) team_value, round(ln(1 + sum("value") FILTER (yardline <= 20)), 6) red_zone_value FROM v_plays WHERE kind IS NOT NULL GROUP BY 1"""))
def team_value(spark: SparkSession, d: str) -> DataFrame:
    p = v.plays(spark, d).where("kind IS NOT NULL")
    return agg.team_value(p, ["game_id"], "value", F.col("yardline") <= 20).select("game_id", r6("team_value"), r6("near_value", "red_zone_value"))


@query(v.sql("""SELECT game_id, coalesce(tds, 0)::BIGINT tds, (coalesce(tds, 0) > 0)::BIGINT label FROM v_player_game"""))
def label_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return agg.labels(v.player_games(spark, d), ["game_id"], F.col("tds")).select("game_id", F.col("n").alias("tds"), "label")


@query("""SELECT l_suppkey, round_even(median(l_quantity / l_tax), 0) inferred_total FROM lineitem WHERE l_tax > 0 GROUP BY 1""")
def inferred_total(spark: SparkSession, d: str) -> DataFrame:
    return agg.inferred_total(v.table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_tax")


@query("""SELECT o_orderkey, last_line::BIGINT last_line, last_line = o_orderkey % 7 + 1 complete FROM orders JOIN (SELECT l_orderkey, arg_max(l_linenumber, (l_shipdate, l_partkey, l_suppkey, l_linenumber)) last_line FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    """The last known value of each group against what the schedule says."""
    plan = v.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("planned"))
    lines = v.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = agg.completeness(lines, plan, ["o_orderkey"], "l_linenumber", ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"], "planned")
    return out.select("o_orderkey", big("last", "last_line"), "complete")


_DIFF = "SELECT actor, count(DISTINCT game_id) games, round(sum(td - 0.15::DOUBLE), 9) diff FROM v_plays GROUP BY 1"


@query(v.sql("""SELECT actor, games, round(diff, 4) diff, 'over' side FROM (SELECT * FROM s ORDER BY diff DESC, actor LIMIT 8) UNION ALL SELECT actor, games, round(diff, 4), 'under' FROM (SELECT * FROM s ORDER BY diff, actor LIMIT 8)""", ("s", _DIFF)))
def over_under_performers(spark: SparkSession, d: str) -> DataFrame:
    """Actual minus expected by actor: the eight furthest above and below."""
    return agg.performers(v.plays(spark, d), "actor", "game_id", F.col("td") - 0.15).select("actor", big("games"), F.round("diff", 4).alias("diff"), "side")


@query(v.sql("""SELECT season::BIGINT season, "column", present, (n - present) missing, round(present * 100.0::DOUBLE / n, 4) pct FROM (SELECT season, count(*) n, count(carries) carries, count(td_value) td_value, count(metric) metric FROM v_player_game GROUP BY 1)
    UNPIVOT (present FOR "column" IN (carries, td_value, metric))"""))
def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    return agg.coverage(v.player_games(spark, d), ["season"], ["carries", "td_value", "metric"]).withColumn("season", big("season"))


@query(v.sql("""SELECT count(*) FILTER (b.game_id IS NULL) only_left, count(*) FILTER (a.game_id IS NULL) only_right, count(*) FILTER (a.game_id IS NOT NULL AND b.game_id IS NOT NULL) AS "both", count(*) FILTER (abs(a.v - b.v) > 0.5) AS different FROM (SELECT game_id, sum("value") v FROM v_plays WHERE line <= 6 GROUP BY 1) a
    FULL JOIN (SELECT game_id, sum("value") v FROM v_plays WHERE line >= 2 GROUP BY 1) b ON a.game_id = b.game_id"""))
def full_outer_reconcile(spark: SparkSession, d: str) -> DataFrame:
    p = v.plays(spark, d)
    total = lambda c: p.where(c).groupBy("game_id").agg(F.sum("value").alias("v"))
    return joins.reconcile(total("line <= 6"), total("line >= 2"), ["game_id"], "v", 0.5)


@query("""SELECT l_orderkey, l_linenumber::BIGINT l_linenumber, count(*) n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return agg.duplicate_keys(v.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumn("l_linenumber", big("l_linenumber"))


@query("""SELECT *, only_left = 0 AND only_right = 0 AS equal FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) only_left, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) only_right)""")
def set_equality(spark: SparkSession, d: str) -> DataFrame:
    return agg.set_equality(v.table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")))


@query(v.sql("""SELECT game_id, team, opponent, is_home::BIGINT is_home, round(CASE WHEN is_home = 1 THEN metric ELSE -metric END, 6) spread FROM (SELECT game_id, grp team, opp opponent, 1 is_home, metric FROM v_game UNION ALL SELECT game_id, opp, grp, 0, metric FROM v_game)"""))
def home_away_fan_out(spark: SparkSession, d: str) -> DataFrame:
    out = joins.fan_out(v.games(spark, d).select("game_id", "grp", "opp", "metric"), home="grp", away="opp", mirrored={"spread": (F.col("metric"), -F.col("metric"))})
    return out.select("game_id", "team", "opponent", big("is_home"), r6("spread"))


@query(v.sql("""SELECT season::BIGINT season, n, joined, n = joined AS one_to_one FROM (SELECT season, count(*) n, count(p.game_id) joined FROM v_game g LEFT JOIN (SELECT DISTINCT game_id FROM v_plays) p USING (game_id) GROUP BY 1)"""))
def join_row_contract(spark: SparkSession, d: str) -> DataFrame:
    """Whether an inner join by key keeps every row, by season."""
    p = v.plays(spark, d).select("game_id").distinct().withColumn("hit", F.lit(1))
    out = v.games(spark, d).join(p, "game_id", "left").groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("joined"))
    return out.select(big("season"), "n", "joined", (F.col("n") == F.col("joined")).alias("one_to_one"))


@query(v.sql("""SELECT g.game_id, round(g.metric, 6) metric, p.n_plays::BIGINT n_plays FROM v_game g JOIN (SELECT game_id, count(*) n_plays FROM v_plays GROUP BY 1) p USING (game_id)"""))
def one_to_one_join(spark: SparkSession, d: str) -> DataFrame:
    """Two fact tables side by side by key; a missing or repeated partner would fail the query."""
    p = v.plays(spark, d).groupBy("game_id").agg(F.count(F.lit(1)).alias("n_plays"))
    g = joins.members(v.games(spark, d).select("game_id", "metric"), p, ["game_id"])
    return joins.beside(g, p, ["game_id"]).select("game_id", r6("metric"), "n_plays")


@query(v.sql("""SELECT c_name live_name, entity, last_game, round(metric, 6) last_metric FROM customer LEFT JOIN (SELECT entity, game_id last_game, metric FROM v_game QUALIFY row_number() OVER (PARTITION BY entity ORDER BY kickoff DESC, game_id DESC) = 1) ON entity = c_custkey"""))
def latest_row(spark: SparkSession, d: str) -> DataFrame:
    """Each live name with the last row of the customer that it resolves to, by one aggregate and a name match."""
    from ..functions import text

    g = v.games(spark, d).groupBy("entity").agg(F.max_by(F.struct("game_id", "metric"), F.struct("kickoff", "game_id")).alias("x"))
    c = v.table(spark, d, "customer").select("c_custkey", "c_name")
    live = c.select(F.col("c_name").alias("live_name"), F.upper("c_name").alias("told"))
    out = joins.resolve(live, c, name="told", candidate_name="c_name", candidate_id="c_custkey", normalise=text.normalize_name).join(g, F.col("resolved_id") == F.col("entity"), "left")
    return out.select("live_name", "entity", F.col("x.game_id").alias("last_game"), r6("x.metric", "last_metric"))


@query("""SELECT o_orderpriority, o_orderstatus, count(*) n FROM orders GROUP BY 1, 2""")
def category_distribution(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(*) n, count(DISTINCT user_id) users, count(DISTINCT ts::DATE) AS "days", max("value") top_value FROM events GROUP BY 1""")
def collection_manifest(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"), F.max("value").alias("top_value"))


@query(v.sql("""SELECT actor, evidence FROM (SELECT s_suppkey actor, CASE WHEN s_suppkey IN (SELECT actor FROM v_plays WHERE td = 1 AND yardline <= 3 UNION SELECT actor FROM v_plays WHERE kind = 'rushing' AND yardline >= 97) THEN 'seen' END evidence FROM supplier)"""))
def participation(spark: SparkSession, d: str) -> DataFrame:
    """Positive evidence from any source; absence is unknown, not false."""
    p = v.plays(spark, d)
    members = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("actor"))
    return agg.participation(members, "actor", p.where("td = 1 AND yardline <= 3"), p.where("kind = 'rushing' AND yardline >= 97"))


@query(v.sql("""SELECT season::BIGINT season, round(sum(all_value) / sum(tds), 6) ratio FROM v_player_game WHERE season < 2000 GROUP BY 1"""))
def points_per_unit(spark: SparkSession, d: str) -> DataFrame:
    p = v.player_games(spark, d).where("season < 2000")
    return p.groupBy("season").agg(r6(F.sum("all_value") / F.sum("tds"), "ratio")).withColumn("season", big("season"))


@query(v.sql("""SELECT count(*) n, round(avg(gap), 6) mean_gap, round(max(gap), 6) max_gap, round(avg((gap > 0.5)::INT), 6) above_half, count(*) FILTER (gap > 1e-7) incoherent FROM (SELECT game_id, abs(CASE WHEN game_id % 53 = 0 THEN 0.75 ELSE 0 END * count(*)) gap FROM (SELECT DISTINCT game_id, actor FROM v_plays) GROUP BY 1)"""))
def coherence(spark: SparkSession, d: str) -> DataFrame:
    """Members' allocated expectations against their group's; some members are told too much on purpose."""
    from ..operators import models

    s = v.plays(spark, d).groupBy("game_id", "actor").agg(F.sum("value").alias("a"), F.sum(F.col("air") / 60.0).alias("b"))
    out = models.allocate(s, ["game_id"], {"a": 0.6, "b": 0.4}, F.lit(2.5)).withColumn("expected", F.lit(2.5))
    out = out.withColumn("lambda", F.col("lambda") + F.when(F.col("game_id") % 53 == 0, 0.75).otherwise(0.0))
    t = models.coherence(out, ["game_id"], "lambda", "expected")
    return t.select("n", r6("mean_gap"), r6("max_gap"), r6("above_half"), "incoherent")


@query(v.sql("""SELECT game_id, actor, round(CASE WHEN sum(score) OVER w > 0 THEN score / sum(score) OVER w ELSE 1.0::DOUBLE / count(*) OVER w END * 2.5, 6) AS "lambda", round(1 - exp(-CASE WHEN sum(score) OVER w > 0 THEN score / sum(score) OVER w ELSE 1.0 / count(*) OVER w END * 2.5), 6) p FROM (SELECT game_id, actor, coalesce((0.6 * coalesce(a, 0) + 0.4 * coalesce(b, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END, 0), 1) score FROM
    (SELECT game_id, actor, sum("value") FILTER (kind IS NOT NULL) a, sum(air / 60.0::DOUBLE) b FROM v_plays GROUP BY 1, 2)) WINDOW w AS (PARTITION BY game_id)"""))
def allocation_scores(spark: SparkSession, d: str) -> DataFrame:
    """A group's expectation dealt to members by a weighted mean of the shares they have; some have none."""
    from ..operators import models

    s = v.plays(spark, d).groupBy("game_id", "actor").agg(F.sum(F.when(F.col("kind").isNotNull(), F.col("value"))).alias("a"), F.sum(F.col("air") / 60.0).alias("b"))
    out = models.allocate(s, ["game_id"], {"a": 0.6, "b": 0.4}, F.lit(2.5))
    return out.select("game_id", "actor", r6("lambda"), r6("p"))


@query(v.sql("""SELECT priority, round(avg((coalesce(tds, 0) > 0)::INT), 6) prior FROM v_player_game WHERE season <= 1998 GROUP BY 1"""))
def position_priors(spark: SparkSession, d: str) -> DataFrame:
    g = v.player_games(spark, d).where("season <= 1998")
    return g.groupBy("priority").agg(r6(F.avg((F.coalesce("tds", F.lit(0)) > 0).cast("double")), "prior"))


@query(v.sql("""SELECT g.game_id, round((coalesce(tds, 0) + 3.0::DOUBLE * prior) / (coalesce(n_plays, 0) + 3.0::DOUBLE), 6) shrunk FROM v_player_game g JOIN (SELECT priority, avg((coalesce(tds, 0) > 0)::INT) prior FROM v_player_game WHERE season <= 1998 GROUP BY 1) USING (priority)"""))
def shrunk_rates(spark: SparkSession, d: str) -> DataFrame:
    g = v.player_games(spark, d)
    prior = g.where("season <= 1998").groupBy("priority").agg(F.avg((F.coalesce("tds", F.lit(0)) > 0).cast("double")).alias("prior"))
    return g.join(F.broadcast(prior), "priority").select("game_id", r6(dist.shrunk_rate(F.coalesce("tds", F.lit(0)), F.coalesce("n_plays", F.lit(0)), F.col("prior")), "shrunk"))


@query(v.sql("""SELECT season::BIGINT season, prop, count(*) n, round(avg(label), 6) mean_label, round(avg((label + 6.5) / (n_plays + 10)), 6) rate, count(*) FILTER (prop = 'targets') with_extra FROM (SELECT season, 'carries' prop, coalesce(carries, 0) label, coalesce(n_plays, 0) n_plays FROM v_player_game UNION ALL SELECT season, 'targets', coalesce(targets, 0), coalesce(n_plays, 0) FROM v_player_game) GROUP BY 1, 2"""))
def prop_label_frame(spark: SparkSession, d: str) -> DataFrame:
    """Each prop with its label column, ragged parts united by name."""
    g = v.player_games(spark, d)
    part = lambda c: g.select("season", F.lit(c).alias("prop"), F.coalesce(c, F.lit(0)).alias("label"), F.coalesce("n_plays", F.lit(0)).alias("n_plays"))
    # only one of the parts knows the group
    u = part("carries").unionByName(part("targets").withColumn("only_here", F.lit(1)), allowMissingColumns=True)
    return u.groupBy("season", "prop").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("label"), "mean_label"), r6(F.avg(dist.smoothed_rate(F.col("label"), F.col("n_plays"))), "rate"), F.count("only_here").alias("with_extra")).withColumn("season", big("season"))
