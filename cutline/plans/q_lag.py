"""Lagged features of orders, by customer, nation and opponent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins, lag, profiles
from . import views as v
from .registry import big, query, r6

#: Every history row a target may see, the newest first.
HIST = """SELECT t.game_id, t.entity, h.game_id h_id, h.kickoff h_kickoff, h.available_at h_available, h.season h_season, t.season, h.metric, h.td_value, h.all_value, h.tds, t.kickoff,
    row_number() OVER (PARTITION BY t.game_id ORDER BY h.kickoff DESC, h.game_id DESC) rn
    FROM v_player_game t JOIN v_player_game h ON h.entity = t.entity AND h.kickoff < t.prediction_time AND h.available_at < t.prediction_time AND h.game_id <> t.game_id"""
TARGETS = ["game_id", "entity", "season", "kickoff", "prediction_time"]


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return v.games(spark, d).select("game_id", "entity", "grp", "opp", "season", "kickoff", "prediction_time")


@query(v.sql("""SELECT g.game_id, g.entity, coalesce(n, 0)::BIGINT n_history, round(m3, 6) last3_metric, round(m5, 6) last5_metric, round(m8, 6) last8_metric FROM v_game g LEFT JOIN
    (SELECT game_id, count(*) n, avg(metric) FILTER (rn <= 3) m3, avg(metric) FILTER (rn <= 5) m5, avg(metric) FILTER (rn <= 8) m8 FROM h GROUP BY 1) USING (game_id)""", ("h", HIST)))
def lag_features_lastn(spark: SparkSession, d: str) -> DataFrame:
    out = lag.prefix_features(v.games(spark, d), _targets(spark, d), ["entity"], metrics=["metric"], with_ewma=False)
    return out.select("game_id", "entity", "n_history", r6("last3_metric"), r6("last5_metric"), r6("last8_metric"))


@query(v.sql("""SELECT g.game_id, g.entity, g.season::BIGINT season, coalesce(n, 0)::BIGINT n_history, round(m, 6) season_metric FROM v_game g LEFT JOIN
    (SELECT game_id, count(*) n, avg(metric) m FROM h WHERE h_season = season GROUP BY 1) USING (game_id)""", ("h", HIST)))
def lag_features_season(spark: SparkSession, d: str) -> DataFrame:
    out = lag.prefix_features(v.games(spark, d), _targets(spark, d), ["entity"], metrics=["metric"], windows={"season": None}, season="season", with_ewma=False)
    return out.select("game_id", "entity", big("season"), "n_history", r6("season_metric"))


@query(v.sql("""SELECT g.game_id, g.entity, round(m, 6) ewma_metric FROM v_game g LEFT JOIN
    (SELECT game_id, sum(metric * pow(0.5::DOUBLE, (rn - 1) / 3.0::DOUBLE)) / sum(pow(0.5::DOUBLE, (rn - 1) / 3.0::DOUBLE)) m FROM h GROUP BY 1) USING (game_id)""", ("h", HIST)))
def lag_features_ewma(spark: SparkSession, d: str) -> DataFrame:
    out = lag.prefix_features(v.games(spark, d), _targets(spark, d), ["entity"], metrics=["metric"], windows={}, half_life=3.0)
    return out.select("game_id", "entity", r6("ewma_metric"))


@query(v.sql("""SELECT g.game_id, g.entity, round(s3, 6) last3_share, round(s5, 6) last5_share FROM v_game g LEFT JOIN (SELECT game_id,
    CASE WHEN count(all_value) FILTER (rn <= 3) = count(*) FILTER (rn <= 3) AND sum(all_value) FILTER (rn <= 3) > 0 THEN sum(td_value) FILTER (rn <= 3) / sum(all_value) FILTER (rn <= 3) END s3,
    CASE WHEN count(all_value) FILTER (rn <= 5) = count(*) FILTER (rn <= 5) AND sum(all_value) FILTER (rn <= 5) > 0 THEN sum(td_value) FILTER (rn <= 5) / sum(all_value) FILTER (rn <= 5) END s5
    FROM h GROUP BY 1) USING (game_id)""", ("h", HIST)))
def lag_shares(spark: SparkSession, d: str) -> DataFrame:
    out = lag.prefix_features(v.player_games(spark, d), _targets(spark, d), ["entity"], shares={"share": ("td_value", "all_value")}, windows={"last3": 3, "last5": 5}, with_ewma=False)
    return out.select("game_id", "entity", r6("last3_share"), r6("last5_share"))


@query(v.sql("""SELECT g.game_id, g.entity, ids source_ids, lu latest_used, ma max_available_at FROM v_game g LEFT JOIN (SELECT game_id, string_agg(h_id::VARCHAR, ';' ORDER BY rn DESC) ids, max(h_kickoff) lu, max(h_available) ma
    FROM h WHERE rn <= 8 GROUP BY 1) USING (game_id)""", ("h", HIST)))
def lag_lineage(spark: SparkSession, d: str) -> DataFrame:
    out = lag.prefix_features(v.games(spark, d), _targets(spark, d), ["entity"], windows={}, with_ewma=False, lineage=8)
    return out.select("game_id", "entity", "source_ids", "latest_used", "max_available_at")


#: Days of a group: ties inside a day are one fact.
DAY = """SELECT grp, kickoff, kickoff + INTERVAL 1 DAY available_at, avg(metric) metric, count(*) games FROM v_game GROUP BY 1, 2"""


def _group_days(spark: SparkSession, d: str) -> DataFrame:
    days = v.games(spark, d).groupBy("grp", "kickoff").agg(F.avg("metric").alias("metric"), F.count(F.lit(1)).alias("games"))
    return days.withColumn("available_at", F.col("kickoff") + F.expr("INTERVAL 1 DAY")).withColumn("day_id", F.date_format("kickoff", "yyyyMMdd").cast("long"))


@query(v.sql("""SELECT g.game_id, g.grp, g.opp, round(a.m, 6) own_last5, round(b.m, 6) opp_last5 FROM v_game g LEFT JOIN own a USING (game_id) LEFT JOIN opp_ b USING (game_id)""",
    ("day", DAY), ("own", """SELECT t.game_id, avg(y.metric) m FROM v_game t JOIN LATERAL (SELECT max(rn) top FROM rd WHERE rd.grp = t.grp AND rd.available_at < t.prediction_time) x ON true JOIN rd y ON y.grp = t.grp AND y.rn BETWEEN x.top - 4 AND x.top GROUP BY 1"""),
    ("opp_", """SELECT t.game_id, avg(y.metric) m FROM v_game t JOIN LATERAL (SELECT max(rn) top FROM rd WHERE rd.grp = t.opp AND rd.available_at < t.prediction_time) x ON true JOIN rd y ON y.grp = t.opp AND y.rn BETWEEN x.top - 4 AND x.top GROUP BY 1""")).replace("own AS (", "rd AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY kickoff) rn FROM day), own AS (", 1))
def group_and_opponent_lag(spark: SparkSession, d: str) -> DataFrame:
    """The same operator in two roles: a game's own group and its opponent's."""
    days, t = _group_days(spark, d), _targets(spark, d)
    own = lag.prefix_features(days, t, ["grp"], row_id="day_id", metrics=["metric"], windows={"own": 5}, with_ewma=False).select("game_id", "grp", "opp", "own_metric")
    opp_days = days.withColumnRenamed("grp", "opp")
    opp = lag.prefix_features(opp_days, t, ["opp"], row_id="day_id", metrics=["metric"], windows={"opp": 5}, with_ewma=False).select("game_id", "opp_metric")
    return own.join(opp, "game_id").select("game_id", "grp", "opp", r6("own_metric", "own_last5"), r6("opp_metric", "opp_last5"))


#: Rows of half of all groups under one key.
_HOT = """SELECT *, CASE WHEN grp < 13 THEN 0 ELSE grp END hot FROM v_game"""


@query(v.sql("""SELECT k.game_id, k.hot::BIGINT hot, coalesce(s.top, 0)::BIGINT n_history, round(m5, 6) last5_metric, round(total, 4) all_sum, round(e, 6) ewma_metric FROM k LEFT JOIN seen s USING (game_id) LEFT JOIN (
    SELECT s.game_id, avg(y.metric) FILTER (y.rn > s.top - 5) m5, max(y.total) total, sum(y.metric * pow(0.5::DOUBLE, (s.top - y.rn) / 3.0::DOUBLE)) / sum(pow(0.5::DOUBLE, (s.top - y.rn) / 3.0::DOUBLE)) e
    FROM seen s JOIN rd y ON y.hot = s.hot AND y.rn BETWEEN s.top - 191 AND s.top GROUP BY 1) USING (game_id)""",
    ("k", _HOT), ("rd", "SELECT *, row_number() OVER w rn, sum(metric) OVER (w ROWS UNBOUNDED PRECEDING) total FROM k WINDOW w AS (PARTITION BY hot ORDER BY kickoff, game_id)"),
    ("told", "SELECT hot, available_at, max(rn) top FROM rd GROUP BY 1, 2"), ("seen", "SELECT k.game_id, k.hot, told.top FROM k ASOF JOIN told ON told.hot = k.hot AND told.available_at < k.prediction_time")))
def hot_entity_lag(spark: SparkSession, d: str) -> DataFrame:
    """Half of all rows are one entity's, whose time line is swept in chunks of thirty days by as many tasks."""
    g = v.games(spark, d).withColumn("hot", F.when(F.col("grp") < 13, 0).otherwise(F.col("grp")))
    t = g.select("game_id", "hot", "prediction_time")
    out = lag.prefix_features(g, t, ["hot"], metrics=["metric"], windows={"last5": 5, "all": None}, sums=True, chunk=30 * 86_400.0)
    return out.select("game_id", big("hot"), "n_history", r6("last5_metric"), F.round("all_sum_metric", 4).alias("all_sum"), r6("ewma_metric"))


@query(v.sql("""SELECT g.game_id, g.entity, round(date_diff('second', p, g.kickoff) / 86400.0::DOUBLE, 6) rest_days FROM v_game g LEFT JOIN (SELECT game_id, max(h_kickoff) p FROM h GROUP BY 1) USING (game_id)""", ("h", HIST)))
def rest_days(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import timing

    out = lag.prefix_features(v.games(spark, d), _targets(spark, d), ["entity"], windows={}, with_ewma=False, lineage=1)
    return out.select("game_id", "entity", r6(timing.seconds_between(F.col("latest_used"), F.col("kickoff")) / 86400.0, "rest_days"))


@query(v.sql("""SELECT g.game_id, g.entity, coalesce(n, 0)::BIGINT games, coalesce(w, 0)::BIGINT wins, round(r5, 6) last5_rate, round(r8, 6) last8_rate, round(e, 6) ewma_rate FROM v_game g LEFT JOIN (SELECT game_id, count(*) n, sum(won) w,
    avg(won) FILTER (rn <= 5) r5, avg(won) FILTER (rn <= 8) r8, sum(won * pow(0.5::DOUBLE, (rn - 1) / 3.0::DOUBLE)) FILTER (rn <= 8) / sum(pow(0.5::DOUBLE, (rn - 1) / 3.0::DOUBLE)) FILTER (rn <= 8) e
    FROM (SELECT *, (coalesce(tds, 0) > 0)::INT won FROM h) GROUP BY 1) USING (game_id)""", ("h", HIST)))
def event_rate_windows(spark: SparkSession, d: str) -> DataFrame:
    """Rates of a label over a customer's earlier orders; the weighted one over the last eight."""
    hist = v.player_games(spark, d).withColumn("won", (F.coalesce("tds", F.lit(0)) > 0).cast("int"))
    out = profiles.event_rates(hist, _targets(spark, d), ["entity"], "won")
    return out.select("game_id", "entity", F.col("n_history").alias("games"), "wins", r6("last5_rate"), r6("last8_rate"), r6("ewma_rate"))


@query(v.sql("""SELECT entity, games::BIGINT games, scored::BIGINT scored_games, round(mean_metric, 6) mean_metric, round(share, 6) share, round((tds + 6.5) / (games + 10), 6) smoothed FROM (SELECT entity, count(*) games, count(*) FILTER (tds > 0) scored, avg(metric) mean_metric, CASE WHEN sum(all_value) > 0 THEN sum(td_value) / sum(all_value) END share, sum(tds) tds
    FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY kickoff DESC, game_id DESC) rn FROM v_player_game WHERE n_plays IS NOT NULL) WHERE rn <= 8 GROUP BY 1 HAVING count(*) >= 3 AND scored >= 3)"""))
def profile_last8(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's last eight orders with lines, for those that have at least three, three of them scored."""
    rows = v.player_games(spark, d).where("n_plays IS NOT NULL")
    p = profiles.profile(rows, ["entity"], ["kickoff", "game_id"], metric="metric", part="td_value", whole="all_value", hits="tds", scored=F.col("tds") > 0)
    return p.select("entity", "games", "scored_games", r6("mean_metric"), r6("share"), r6("smoothed"))


@query(v.sql("""SELECT season::BIGINT season, grp, entity, round(CASE WHEN sum(c) OVER w > 0 THEN c / sum(c) OVER w END, 6) carries_share, round(CASE WHEN sum(t) OVER w > 0 THEN t / sum(t) OVER w END, 6) targets_share FROM (SELECT season, grp, entity, sum(carries)::DOUBLE c, sum(targets)::DOUBLE t FROM v_player_game GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY season, grp)"""))
def season_usage_shares(spark: SparkSession, d: str) -> DataFrame:
    out = profiles.season_shares(v.player_games(spark, d), "season", ["grp"], "entity", ["carries", "targets"])
    return out.select(big("season"), "grp", "entity", r6("carries_share"), r6("targets_share"))


@query(v.sql("""SELECT g.game_id, round(m5, 6) last5_value, round(r5, 6) last5_share, round(e, 6) ewma_value FROM v_game g LEFT JOIN (SELECT game_id, avg(td_value) FILTER (rn <= 5) m5,
    CASE WHEN sum(all_value) FILTER (rn <= 5) > 0 THEN sum(td_value) FILTER (rn <= 5) / sum(all_value) FILTER (rn <= 5) END r5,
    sum(td_value * pow(0.5::DOUBLE, (rn - 1) / 3.0::DOUBLE)) / sum(pow(0.5::DOUBLE, (rn - 1) / 3.0::DOUBLE)) FILTER (td_value IS NOT NULL) e FROM h GROUP BY 1) USING (game_id)""", ("h", HIST)))
def value_lag_skipnull(spark: SparkSession, d: str) -> DataFrame:
    """Windows that leave nulls out; ranks are those of the unfiltered history."""
    out = lag.prefix_features(v.player_games(spark, d), _targets(spark, d), ["entity"], metrics=["td_value"], shares={"share": ("td_value", "all_value")}, windows={"last5": 5}, null_policy="skip")
    return out.select("game_id", r6("last5_td_value", "last5_value"), r6("last5_share"), r6("ewma_td_value", "ewma_value"))


@query(v.sql("""SELECT game_id, entity, n_last3::BIGINT n_last3 FROM (SELECT g.game_id, g.entity, g.priority, count(*) FILTER (rn <= 3) n_last3, max(h.tds) FILTER (rn <= 3) usage FROM v_player_game g JOIN h ON h.game_id = g.game_id GROUP BY 1, 2, 3)
    WHERE n_last3 = 3 AND priority <> '5-LOW' AND (usage > 0 OR priority = '1-URGENT')""", ("h", HIST.replace("t.game_id, t.entity,", "t.game_id, t.entity t_entity,"))))
def candidate_universe(spark: SparkSession, d: str) -> DataFrame:
    """Orders of allowed priorities whose customer has three earlier ones, some with recent usage or of top priority."""
    t = v.games(spark, d).select("game_id", "entity", "priority", "prediction_time")
    out = profiles.candidate_universe(v.player_games(spark, d), t, ["entity"], usage="tds", allowed=F.col("priority") != "5-LOW", exempt=F.col("priority") == "1-URGENT")
    return out.select("game_id", "entity", F.col("n_recent").alias("n_last3"))


@query(v.sql("""SELECT season::BIGINT season, grp, entity, usage::BIGINT usage, rank::BIGINT "rank" FROM (SELECT *, row_number() OVER (PARTITION BY season, grp ORDER BY usage DESC, entity) rank FROM
    (SELECT season, grp, entity, sum(coalesce(carries, 0) + coalesce(targets, 0)) usage FROM v_player_game WHERE entity IN (SELECT user_id FROM events) GROUP BY 1, 2, 3)) WHERE rank <= 2"""))
def topk_usage(spark: SparkSession, d: str) -> DataFrame:
    """The two of most usage of each group and season among those with a quote."""
    quoted = v.table(spark, d, "events").select(F.col("user_id").alias("entity"))
    out = profiles.top_usage(v.player_games(spark, d), ["season", "grp"], "entity", F.coalesce("carries", F.lit(0)) + F.coalesce("targets", F.lit(0)), offered=quoted)
    return out.select(big("season"), "grp", "entity", big("usage"), big("rank"))


@query(v.sql("""SELECT g.game_id, round(CASE WHEN sum(all_value) FILTER (rn <= 3) > 0 THEN sum(coalesce(td_value, 0)) FILTER (rn <= 3) / sum(all_value) FILTER (rn <= 3) END, 6) recent_share FROM v_game g JOIN h ON h.game_id = g.game_id GROUP BY 1""", ("h", HIST.replace("t.game_id, t.entity,", "t.game_id, t.entity t_entity,"))))
def recent_share(spark: SparkSession, d: str) -> DataFrame:
    hist = v.player_games(spark, d).withColumn("td_value", F.coalesce("td_value", F.lit(0.0)))
    out = lag.prefix_features(hist, _targets(spark, d), ["entity"], shares={"share": ("td_value", "all_value")}, windows={"recent": 3}, null_policy="skip", with_ewma=False)
    return out.where("n_history > 0").select("game_id", r6("recent_share"))


@query(v.sql("""SELECT priority, game_id, rank::BIGINT "rank" FROM (SELECT priority, game_id, row_number() OVER (PARTITION BY priority ORDER BY kickoff, game_id) rank FROM v_game) WHERE rank <= 3"""))
def first_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import aggregates as agg

    return agg.first_n(v.games(spark, d), ["priority"], [F.col("kickoff"), F.col("game_id")], 3).select("priority", "game_id", big("rank"))


@query(v.sql("""SELECT entity, string_agg(game_id::VARCHAR, ';' ORDER BY kickoff, game_id) tail, bool_or(status = 'F') has_final FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY kickoff DESC, game_id DESC) rn FROM v_game) WHERE rn <= 3 GROUP BY 1"""))
def actual_history_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The last three ids of each customer as a delimited list; only those three are collected."""
    w = Window.partitionBy("entity").orderBy(F.desc("kickoff"), F.desc("game_id"))
    last = v.games(spark, d).select("entity", "kickoff", "game_id", "status").withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    h = last.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("kickoff", "game_id", "status"))).alias("h"))
    ids = F.transform("h", lambda x: x["game_id"].cast("string"))
    return h.select("entity", F.array_join(ids, ";").alias("tail"), F.exists("h", lambda x: x["status"] == "F").alias("has_final"))


#: Histories whose results come in out of order: every seventh one only after sixty days.
_LATE = """SELECT *, kickoff + CASE WHEN game_id % 7 = 0 THEN INTERVAL 60 DAY ELSE INTERVAL 1 DAY END late FROM v_player_game"""
_LATE_HIST = """SELECT t.game_id, h.game_id h_id, h.metric, h.td_value, h.all_value, row_number() OVER (PARTITION BY t.game_id ORDER BY h.kickoff DESC, h.game_id DESC) rn
    FROM lg t JOIN lg h ON h.entity = t.entity AND h.kickoff < t.prediction_time AND h.late < t.prediction_time AND h.game_id <> t.game_id"""


def _late_games(spark: SparkSession, d: str) -> DataFrame:
    late = F.when(F.col("game_id") % 7 == 0, F.expr("INTERVAL 60 DAYS")).otherwise(F.expr("INTERVAL 1 DAY"))
    return v.player_games(spark, d).withColumn("available_at", F.col("kickoff") + late)


@query(v.sql("""SELECT g.game_id, coalesce(n, 0)::BIGINT n_history, round(m3, 6) last3_metric, round(s5, 6) last5_sum, round(e, 6) ewma_metric, round(es, 6) ewma_share, ids source_ids FROM v_game g LEFT JOIN (SELECT game_id, count(*) n, avg(metric) FILTER (rn <= 3) m3, sum(metric) FILTER (rn <= 5) s5,
    sum(metric * pow(0.5::DOUBLE, (rn - 1) / 3.0::DOUBLE)) / sum(pow(0.5::DOUBLE, (rn - 1) / 3.0::DOUBLE)) e, sum(td_value * pow(0.5::DOUBLE, (rn - 1) / 3.0::DOUBLE)) / nullif(sum(all_value * pow(0.5::DOUBLE, (rn - 1) / 3.0::DOUBLE)), 0) es,
    string_agg(h_id::VARCHAR, ';' ORDER BY rn DESC) FILTER (rn <= 5) ids FROM lh GROUP BY 1) USING (game_id)""", ("lg", _LATE), ("lh", _LATE_HIST)))
def lag_features_irregular(spark: SparkSession, d: str) -> DataFrame:
    """Means, sums, weighted means and shares, and lineage, of histories that were not yet complete at the cutoff."""
    h, t = _late_games(spark, d), _targets(spark, d)
    a = lag.prefix_features(h, t, ["entity"], metrics=["metric"], windows={"last3": 3, "last5": 5}, sums=True, lineage=5).select("game_id", "n_history", "last3_metric", "last5_sum_metric", "ewma_metric", "source_ids")
    b = lag.prefix_features(h, t, ["entity"], shares={"share": ("td_value", "all_value")}, windows={}, null_policy="skip").select("game_id", "ewma_share")
    return joins.beside(a, b, ["game_id"]).select("game_id", "n_history", r6("last3_metric"), r6("last5_sum_metric", "last5_sum"), r6("ewma_metric"), r6("ewma_share"), "source_ids")


@query(v.sql("""SELECT game_id, count(*) n_seen, max(h_id) latest_id, round(sum(metric), 6) total FROM lh GROUP BY 1""", ("lg", _LATE), ("lh", _LATE_HIST)))
def history_range_join(spark: SparkSession, d: str) -> DataFrame:
    """The general range join: every row that a target may see, whatever the order of availability."""
    pairs = joins.history_join(_late_games(spark, d).select("entity", "game_id", "kickoff", "available_at", "metric"), _targets(spark, d), ["entity"], time="kickoff", available_at="available_at", cutoff="prediction_time", history_id="game_id", target_id="game_id")
    return pairs.groupBy("game_id").agg(F.count(F.lit(1)).alias("n_seen"), F.max("h_game_id").alias("latest_id"), r6(F.sum("h_metric"), "total"))


@query(v.sql("""SELECT g.game_id, g.grp, round(r.m5, 6) carry_mean, round(r.s5, 6) value_sum, round(r.q5, 6) value_rate FROM v_game g LEFT JOIN (SELECT h.game_id, avg(carries) FILTER (rn <= 5) m5, sum(all_value) FILTER (rn <= 5) s5, CASE WHEN sum(n_plays) FILTER (rn <= 5) > 0 THEN sum(all_value) FILTER (rn <= 5) / sum(n_plays) FILTER (rn <= 5) END q5
    FROM (SELECT t.game_id, h.carries, h.all_value, h.n_plays, row_number() OVER (PARTITION BY t.game_id ORDER BY h.kickoff DESC, h.game_id DESC) rn FROM v_game t JOIN v_player_game h ON h.entity = t.entity AND h.kickoff < t.prediction_time AND h.available_at < t.prediction_time AND h.game_id <> t.game_id) h GROUP BY 1) r USING (game_id)"""))
def lag_sums_and_rates(spark: SparkSession, d: str) -> DataFrame:
    """Null-skipping means, sums, and rates as ratios of sums over the window."""
    out = lag.prefix_features(v.player_games(spark, d), _targets(spark, d), ["entity"], metrics=["carries", "all_value"], shares={"rate": ("all_value", "n_plays")}, windows={"last5": 5}, null_policy="skip", sums=True, with_ewma=False)
    return out.select("game_id", "grp", r6("last5_carries", "carry_mean"), r6("last5_sum_all_value", "value_sum"), r6("last5_rate", "value_rate"))
