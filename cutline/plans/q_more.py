"""Remaining operators: status flags, box scores, rankings, allocations, registry, streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import odds, text
from ..operators import joins, metrics, models
from ..sources import boxscore
from ..sources import quotes as src
from ..streaming import freeze as st
from . import views as v
from .q_stream import ON_TIME, quotes_of, run_in_parts
from .registry import big, query, r6


@query(v.sql("""SELECT w.event, w.player, coalesce(t <= cutoff, false) at_cutoff, coalesce(t <= kickoff, false) at_kickoff FROM v_wagers w JOIN v_cutoff USING (event) LEFT JOIN (SELECT date_trunc('week', ts)::DATE AS event, user_id player, min(ts) t FROM events WHERE event_type = 'error' GROUP BY 1, 2) e ON e.event = w.event AND e.player = w.player"""))
def inactive_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether a player was listed out at the cutoff, and at kickoff."""
    e = v.table(spark, d, "events").where("event_type = 'error'").select(F.to_date(F.date_trunc("week", "ts")).alias("event"), F.col("user_id").alias("player"), "ts")
    w = v.wagers(spark, d).select("event", "player").join(v.cutoffs(spark, d), "event")
    w = joins.status_at(w, e, ["event", "player"], at="cutoff", known_at="ts", flag="at_cutoff")
    return joins.status_at(w, e, ["event", "player"], at="kickoff", known_at="ts", flag="at_kickoff").select("event", "player", "at_cutoff", "at_kickoff")


@query("""SELECT l_orderkey game, l_suppkey player, coalesce(sum(q) FILTER (g IN ('A', 'R')), 0) AS offensive, greatest(coalesce(sum(q) FILTER (g = 'NF'), 0), coalesce(sum(q) FILTER (g = 'NO'), 0)) + coalesce(sum(q) FILTER (g = 'ret'), 0) special
FROM (SELECT l_orderkey, l_suppkey, l_quantity q, CASE WHEN l_linenumber = 7 THEN 'ret' WHEN l_returnflag = 'N' THEN 'N' || l_linestatus ELSE l_returnflag END g FROM lineitem) GROUP BY 1, 2""")
def box_score_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Lines nested into box scores by group, then flattened and merged."""
    g = F.when(F.col("l_linenumber") == 7, "ret").when(F.col("l_returnflag") == "N", F.concat(F.lit("N"), "l_linestatus")).otherwise(F.col("l_returnflag"))
    l = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("id"), "l_quantity", g.alias("name"))
    a = l.groupBy("game", "name").agg(F.collect_list(F.struct("id", F.array(F.lit("9"), F.col("l_quantity").cast("string")).alias("stats"))).alias("athletes"))
    docs = a.groupBy("game").agg(F.array(F.struct(F.lit(0).cast("long").alias("team"), F.collect_list(F.struct("name", F.array(F.lit("YDS"), F.lit("TD")).alias("labels"), "athletes")).alias("statistics"))).alias("players"))
    out = boxscore.outcomes(boxscore.flatten(docs), ["A", "R"], ["NF", "NO"], "ret")
    return out.select("game", "player", "offensive", "special")


@query(v.sql("""SELECT event, player, round(round(gap, 9), 6) gap, row_number() OVER (PARTITION BY event ORDER BY round(gap, 9) DESC NULLS LAST, player) "rank" FROM (SELECT event, player, CASE WHEN books >= 3 THEN "decimal" / median_decimal - 1 END gap FROM v_wagers)"""))
def ranked_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    """Players of each week by price gap, those without enough books last."""
    w = v.wagers(spark, d).withColumn("gap", F.when(F.col("books") >= 3, F.round(odds.dispersion(F.col("decimal"), F.col("median_decimal")), 9)))
    order = Window.partitionBy("event").orderBy(F.col("gap").desc_nulls_last(), "player")
    return w.select("event", "player", r6("gap"), big(F.row_number().over(order), "rank"))


@query("""SELECT event_id, round(miss, 6) miss, side FROM (SELECT *, row_number() OVER (ORDER BY miss DESC, event_id) r, 'largest' side FROM (SELECT event_id, abs(least(0.95::DOUBLE, 0.05::DOUBLE + ((event_id * 37) % 90) / 100.0::DOUBLE) - (event_type = 'purchase')::INT) miss FROM events) UNION ALL
SELECT *, row_number() OVER (ORDER BY miss, event_id) r, 'smallest' side FROM (SELECT event_id, abs(least(0.95::DOUBLE, 0.05::DOUBLE + ((event_id * 37) % 90) / 100.0::DOUBLE) - (event_type = 'purchase')::INT) miss FROM events)) WHERE r <= 10""")
def extreme_examples(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest and smallest misses: a top-k report."""
    s = v.scored(spark, d).select("event_id", F.abs(F.col("p2") - F.col("y")).alias("miss"))
    top = s.orderBy(F.desc("miss"), "event_id").limit(10).withColumn("side", F.lit("largest"))
    low = s.orderBy("miss", "event_id").limit(10).withColumn("side", F.lit("smallest"))
    return top.unionByName(low).select("event_id", r6("miss"), "side")


@query("""SELECT a.n_nationkey::BIGINT n_nationkey, (CASE b.n_name WHEN 'NATION_3' THEN 'N3' ELSE b.n_name END) || '@' || (CASE a.n_name WHEN 'NATION_3' THEN 'N3' ELSE a.n_name END) code FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25""")
def event_codes(spark: SparkSession, d: str) -> DataFrame:
    n = v.table(spark, d, "nation")
    o = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("away"))
    return n.join(o, (F.col("n_nationkey") + 1) % 25 == F.col("k")).select(big("n_nationkey"), text.event_code(F.col("away"), F.col("n_name"), {"NATION_3": "N3"}).alias("code"))


_SHARES = """SELECT game_id, actor, a / sum(a) OVER w a, b / nullif(sum(b) OVER w, 0) b, c * 1.0::DOUBLE / nullif(sum(c) OVER w, 0) c FROM (SELECT game_id, actor, sum("value") a, sum(air)::DOUBLE b, count(*) FILTER (kind = 'rushing') c FROM v_plays GROUP BY 1, 2) WINDOW w AS (PARTITION BY game_id)"""


@query(v.sql("""SELECT game_id, actor, round(CASE WHEN sum(s) OVER w > 0 THEN s / sum(s) OVER w ELSE 1.0::DOUBLE / count(*) OVER w END * 2.5, 6) "lambda" FROM (SELECT game_id, actor, coalesce((coalesce(0.5 * a, 0) + coalesce(0.3 * b, 0) + coalesce(0.2 * c, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.5 END + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END, 0), 0) s FROM x) WINDOW w AS (PARTITION BY game_id)""", ("x", _SHARES)))
def fixed_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Counts normalised by their group's sums, mixed by fixed weights over what is at hand."""
    p = v.plays(spark, d).groupBy("game_id", "actor").agg(F.sum("value").alias("a"), F.sum("air").cast("double").alias("b"), F.count_if(F.col("kind") == "rushing").cast("double").alias("c"))
    w = Window.partitionBy("game_id")
    p = p.withColumns({x: F.try_divide(F.col(x), F.sum(x).over(w)) for x in ("a", "b", "c")})
    return models.allocate(p, ["game_id"], {"a": 0.5, "b": 0.3, "c": 0.2}, F.lit(2.5)).select("game_id", "actor", r6("lambda"))


@query(v.sql("""SELECT count(*) n, round(avg(abs(all_value - tds * ratio)), 6) mae, round(sum(tds * ratio) / sum(all_value), 6) total_ratio FROM v_player_game, (SELECT sum(all_value) / sum(tds) ratio FROM v_player_game WHERE season < 2000) WHERE season >= 2000 AND tds IS NOT NULL"""))
def ratio_baseline(spark: SparkSession, d: str) -> DataFrame:
    """A ratio of sums of early seasons applied to later ones."""
    g = v.player_games(spark, d)
    ratio = g.where("season < 2000").agg((F.sum("all_value") / F.sum("tds")).alias("ratio"))
    t = g.where("season >= 2000 AND tds IS NOT NULL").join(F.broadcast(ratio)).withColumn("guess", F.col("tds") * F.col("ratio"))
    return t.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(F.col("all_value") - F.col("guess"))), "mae"), r6(F.sum("guess") / F.sum("all_value"), "total_ratio"))


@query(v.sql("""SELECT CASE WHEN month("at") <> 1 OR day("at") > 21 THEN 'late' WHEN day("at") <= 10 THEN 'early' ELSE 'middle' END segment, count(*) n, round(avg((p - y) * (p - y)), 6) brier FROM v_scored GROUP BY 1"""))
def chronological_segments(spark: SparkSession, d: str) -> DataFrame:
    day, month = F.dayofmonth("at"), F.month("at")
    seg = F.when((month != 1) | (day > 21), "late").when(day <= 10, "early").otherwise("middle")
    out = metrics.probability_metrics(v.scored(spark, d).withColumn("segment", seg), "p", "y", ["segment"])
    return out.select("segment", "n", r6("brier"))


#: Convex weights of four scores, by name.
BLENDS = {"first": (1.0, 0.0, 0.0, 0.0), "second": (0.0, 1.0, 0.0, 0.0), "equal": (0.25, 0.25, 0.25, 0.25), "heavy_first": (0.6, 0.2, 0.1, 0.1), "heavy_last": (0.1, 0.2, 0.2, 0.5)}
_FOUR = """SELECT y, p, p2, sqrt(p * p2) p3, 0.05::DOUBLE + 0.1::DOUBLE * seg p4 FROM v_scored"""
_BLEND = "SELECT name, count(*) n, avg(CASE WHEN y = 1 THEN -ln(least(1 - 1e-6, greatest(1e-6, q))) ELSE -ln(1 - least(1 - 1e-6, greatest(1e-6, q))) END) ll FROM (SELECT name, y, a * p + b * p2 + c * p3 + e * p4 q FROM four, (VALUES " + ", ".join("('{}', {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE)".format(n, *w) for n, w in BLENDS.items()) + ") w(name, a, b, c, e)) GROUP BY 1"


def _four(spark: SparkSession, d: str) -> DataFrame:
    return v.scored(spark, d).select("y", "p", "p2", F.sqrt(F.col("p") * F.col("p2")).alias("p3"), (F.lit(0.05) + F.lit(0.1) * F.col("seg")).alias("p4"))


@query(v.sql("SELECT name, n, round(ll, 6) log_loss, name = (SELECT arg_min(name, (ll, name)) FROM b) chosen FROM b", ("four", _FOUR), ("b", _BLEND)))
def blend_four(spark: SparkSession, d: str) -> DataFrame:
    """Registered blends of four scores, all in one scan, and the one of least loss."""
    return metrics.blends(_four(spark, d), ["p", "p2", "p3", "p4"], "y", BLENDS).select("name", "n", r6("log_loss"), "chosen")


@query(v.sql("""SELECT count(*) AS rows, count(*) FILTER (name = 'equal') log_loss_differs, count(*) FILTER (name = 'second') not_forward, (SELECT count(*) FROM (SELECT arg_min(name, (ll, name)) best FROM b) WHERE best <> 'heavy_last') chosen_not_best, count(*) FILTER (name = 'first') weights_differ FROM b""", ("four", _FOUR), ("b", _BLEND)))
def model_registry_audit(spark: SparkSession, d: str) -> DataFrame:
    """A registry against its rebuild from out-of-sample scores; scores, seasons, weights and the choice are wrong on purpose."""
    rebuilt = metrics.blends(_four(spark, d), ["p", "p2", "p3", "p4"], "y", BLENDS)
    name = F.col("name")
    stored = rebuilt.select("name", (F.col("log_loss") + F.when(name == "equal", 0.01).otherwise(0.0)).alias("log_loss"), F.when(name == "second", 2024).otherwise(2023).alias("fit_upto"), F.lit(2024).alias("scored"), (name == "heavy_last").alias("chosen"), F.when(name == "first", F.array(*(F.lit(0.25) for _ in range(4)))).otherwise(F.col("weights")).alias("weights"))
    return metrics.registry_audit(stored, rebuilt)


#: The eleven shares of an allocation: name, weight, and what is summed in SQL and in Spark.
_R, _C = "kind = 'rushing'", "kind = 'receiving'"
FAMILIES = {
    "total_value": (0.45, '"value"'), "rush_value": (0.08, f'CASE WHEN {_R} THEN "value" END'), "catch_value": (0.08, f'CASE WHEN {_C} THEN "value" END'), "goal_line": (0.08, "CASE WHEN yardline <= 5 THEN 1 END"),
    "inside_5": (0.06, f"CASE WHEN {_R} AND yardline <= 5 THEN 1 END"), "inside_10": (0.04, f"CASE WHEN {_R} AND yardline <= 10 THEN 1 END"), "red_zone": (0.05, f"CASE WHEN {_C} AND yardline <= 20 THEN 1 END"),
    "end_zone": (0.05, f"CASE WHEN {_C} AND air >= yardline THEN 1 END"), "carries": (0.05, f"CASE WHEN {_R} THEN 1 END"), "targets": (0.05, f"CASE WHEN {_C} THEN 1 END"), "snaps": (0.01, "1"),
}
_SUMS = "SELECT game_id, actor, " + ", ".join(f"sum({x})::DOUBLE {n}" for n, (_, x) in FAMILIES.items()) + " FROM v_plays GROUP BY 1, 2"
_PARTS = "SELECT game_id, actor, " + ", ".join(f"{n} / nullif(sum({n}) OVER w, 0) {n}" for n in FAMILIES) + " FROM sums WINDOW w AS (PARTITION BY game_id)"
_SCORE = "SELECT game_id, actor, (" + " + ".join(f"coalesce({w} * {n}, 0)" for n, (w, _) in FAMILIES.items()) + ") / nullif(" + " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE {w}::DOUBLE END" for n, (w, _) in FAMILIES.items()) + ", 0) s FROM parts"


@query(v.sql("""SELECT game_id, actor, round(CASE WHEN sum(coalesce(s, 0)) OVER w > 0 THEN coalesce(s, 0) / sum(coalesce(s, 0)) OVER w ELSE 1.0::DOUBLE / count(*) OVER w END * 2.5, 6) "lambda" FROM score WINDOW w AS (PARTITION BY game_id)""", ("sums", _SUMS), ("parts", _PARTS), ("score", _SCORE)))
def eleven_weights(spark: SparkSession, d: str) -> DataFrame:
    """Eleven families of counts, each a share of its game, renormalised over what a member has."""
    p = v.plays(spark, d).groupBy("game_id", "actor").agg(*(F.sum(F.expr(x.replace('"', "`"))).cast("double").alias(n) for n, (_, x) in FAMILIES.items()))
    w = Window.partitionBy("game_id")
    p = p.withColumns({n: F.try_divide(F.col(n), F.sum(n).over(w)) for n in FAMILIES})
    return models.allocate(p, ["game_id"], {n: w for n, (w, _) in FAMILIES.items()}, F.lit(2.5)).select("game_id", "actor", r6("lambda"))


@query(v.sql("""SELECT event::VARCHAR AS event, book, player::VARCHAR player, price::BIGINT price, quote_time FROM v_quotes"""))
def stream_flatten(spark: SparkSession, d: str) -> DataFrame:
    """The batch flattening, on a stream of nested snapshots: every outcome, once."""

    def build(read: Callable[[], DataFrame]) -> DataFrame:
        s = quotes_of(read())
        outcome = F.array(F.struct(F.lit("Over").alias("name"), F.col("player").cast("string").alias("description"), F.lit(0.5).alias("point"), F.col("price")))
        market = F.array(F.struct(F.lit("prop").alias("key"), F.col("quote_time").alias("last_update"), outcome.alias("outcomes")))
        return src.flatten(s.select(F.col("quote_time").alias("timestamp"), "event", F.array(F.struct(F.col("book").alias("key"), market.alias("markets"))).alias("bookmakers")))

    return run_in_parts(spark, d, "flatten", build).select("event", "book", "player", big("price"), F.col("quote_time").cast("timestamp_ntz").alias("quote_time"))


@query(f"""WITH e AS ({ON_TIME}) SELECT count(*) FILTER (won IS NULL) pending, count(*) FILTER (won) won, count(*) FILTER (NOT won) lost FROM (SELECT w.event_id, w.ts, r.won FROM e w LEFT JOIN (SELECT event_id - 1 id, ts, "value" > 20 won FROM e WHERE event_type IN ('purchase', 'error')) r
ON r.id = w.event_id AND r.ts >= w.ts AND r.ts <= w.ts + INTERVAL 6 HOUR WHERE w.event_type = 'click') WHERE won IS NOT NULL OR ts + INTERVAL 6 HOUR < (SELECT max(ts) - INTERVAL 20 MINUTE FROM events)""")
def stream_settlement(spark: SparkSession, d: str) -> DataFrame:
    """Wagers wait six hours for their result; what the watermark has passed without one is pending."""

    def build(read: Callable[[], DataFrame]) -> DataFrame:
        own = lambda: read().withColumn("ts", F.col("ts").cast("timestamp"))
        w = own().where("event_type = 'click'").select(F.col("event_id").alias("wager_id"), F.col("ts").alias("placed_at"))
        r = own().where("event_type IN ('purchase', 'error')").select((F.col("event_id") - 1).alias("wager_id"), F.col("ts").alias("known_at"), (F.col("value") > 20).alias("won"))
        return st.settle(w, r).select("wager_id", "placed_at", "won", "status")

    out = run_in_parts(spark, d, "settle", build)
    top = v.table(spark, d, "events").agg((F.max("ts").cast("timestamp") - F.expr("INTERVAL 20 MINUTES")).alias("top"))
    done = out.join(F.broadcast(top)).where("won IS NOT NULL OR placed_at + INTERVAL 6 HOURS < top")
    return done.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "won").alias("won"), F.count_if(F.col("status") == "lost").alias("lost"))
