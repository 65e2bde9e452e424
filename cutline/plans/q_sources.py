"""Reading, writing and guarding: what is written must come back, and what is wrong must be refused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, timing
from ..operators import audit, joins, prices
from ..sources import boxscore
from ..sources import quotes as src
from ..sources import schema, sinks, staging
from . import views as v
from .registry import big, query, r6


def _refused(f: Callable[[], object], kind: type[Exception], told: str) -> bool:
    """Whether a guard raises its own error; any other error is one of the query."""
    try:
        f()
    except kind as e:
        if told not in str(e):
            raise
        return True
    return False


@query("""SELECT o_orderstatus status, count(*) n, round(sum(o_totalprice), 2) total, count(*) FILTER (o_orderkey % 7 = 0) unknown FROM orders GROUP BY 1""")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Orders written once as CSV with a header and nulls, read back by a declared schema."""
    o = v.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"))
    at = staging.place(spark, "csv")
    sinks.write_once(o, at, "csv")
    back = sinks.read_csv(spark, at, "o_orderkey long, o_orderstatus string, o_totalprice double, priority string")
    return back.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_if(F.col("priority").isNull()).alias("unknown"))


@query("""SELECT count(*) FILTER (event_id % 10 <> 0) parsed, count(*) FILTER (event_id % 10 = 0) rejected, sum(event_id) FILTER (event_id % 10 <> 0)::BIGINT points FROM events""")
def snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot documents as files of text, every tenth broken off: what parses is read, the rest is counted, not lost."""
    e = v.table(spark, d, "events")
    outcome = F.struct(F.lit("Over").alias("name"), F.lit("p").alias("description"), F.col("event_id").cast("double").alias("point"), F.lit(150).alias("price"))
    market = F.struct(F.lit("prop").alias("key"), F.col("ts").alias("last_update"), F.array(outcome).alias("outcomes"))
    doc = F.to_json(F.struct(F.col("ts").alias("timestamp"), F.col("event_id").cast("string").alias("event"), F.array(F.struct(F.lit("b").alias("key"), F.array(market).alias("markets"))).alias("bookmakers")))
    lines = e.select(F.when(F.col("event_id") % 10 == 0, F.substring(doc, 1, 60)).otherwise(doc).alias("value"))
    at = staging.place(spark, "snapshots")
    lines.write.text(at)
    good, bad = src.read_snapshots(spark, at)
    flat = src.flatten(good).agg(F.count(F.lit(1)).alias("parsed"), F.sum("line").cast("long").alias("points"))
    return flat.join(F.broadcast(bad.agg(F.count(F.lit(1)).alias("rejected")))).select("parsed", "rejected", "points")  # one row each


@query("""SELECT year(o_orderdate)::BIGINT season, count(*) n, min(o_orderkey) first_key, (SELECT count(DISTINCT year(o_orderdate)) FROM orders) parts FROM orders GROUP BY 1""")
def season_parts(spark: SparkSession, d: str) -> DataFrame:
    """Season files of different widths united into one partitioned table and read back; the season is in the path."""
    o = v.table(spark, d, "orders").withColumn("season", F.year("o_orderdate"))
    early = o.where("season < 1998").select("season", "o_orderkey")
    late = o.where("season >= 1998").select("season", "o_orderkey", "o_orderstatus")
    at = staging.place(spark, "seasons")
    sinks.concat_seasons([early, late], at, "season")
    back = spark.read.parquet(at)
    parts = back.select("season").distinct().agg(F.count(F.lit(1)).alias("parts"))
    return back.groupBy(big("season")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key")).join(F.broadcast(parts))  # one row


@query(v.sql("""SELECT x.entity, n, round(total, 4) total, rows FROM (SELECT entity, count(*) n, sum(metric) total FROM v_game GROUP BY 1 ORDER BY n DESC, entity LIMIT 10) x JOIN (SELECT entity, count(*) rows FROM v_game GROUP BY 1) USING (entity)"""))
def report_bundle(spark: SparkSession, d: str) -> DataFrame:
    """A ranked summary beside the rows behind it, both of one scan, written once and read back."""
    g = v.games(spark, d).select("entity", "game_id", "metric")
    top = g.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("metric").alias("total")).orderBy(F.desc("n"), "entity").limit(10)
    at = staging.place(spark, "report")
    sinks.report_bundle(top, joins.members(g, top, ["entity"]), at)
    summary, rows = sinks.read_csv(spark, f"{at}/summary", "entity long, n long, total double"), spark.read.parquet(f"{at}/rows")
    return summary.join(rows.groupBy("entity").agg(F.count(F.lit(1)).alias("rows")), "entity").select("entity", "n", F.round("total", 4).alias("total"), "rows")


@query(v.sql("""SELECT count(*) rows, count(*) > 0 AS overwrite_refused, count(*) > 0 AS missing_column_refused, count(*) > 0 AS unknown_field_refused, count(*) > 0 AS result_field_refused, min(year(o_orderdate)) < 1990 OR max(year(o_orderdate)) > 2000 AS late_season_refused,
    count(*) > count(DISTINCT o_custkey) AS ambiguous_refused, count(*) FILTER (o_orderkey = 1) > 0 AS altered_table_refused, count(*) > 10 AS over_budget_refused, (SELECT count(*) > 0 FROM v_quotes JOIN v_cutoff USING (event) WHERE snapshot_time > cutoff) AS late_wrapper_refused,
    (SELECT count(*) > 0 FROM (SELECT 1 FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1)) AS conflict_refused,
    (SELECT count(*) > 0 FROM (SELECT 1 FROM events a JOIN events b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 864000000000 WHERE a.event_type = 'purchase' AND b.event_type = 'error' GROUP BY a.event_id HAVING count(*) > 1)) AS many_matches_refused,
    (SELECT count(*) > 0 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)) AS partner_refused, count(*) > 0 AS ambiguous_scorer_refused FROM orders"""))
def guards_refuse(spark: SparkSession, d: str) -> DataFrame:
    """Every guard on whole tables with a fault in them: each must raise an error of its kind that names the fault."""
    o = v.table(spark, d, "orders").withColumn("season", F.year("o_orderdate"))
    at = staging.place(spark, "once")
    sinks.write_once(o, at)
    stored = staging.stage(sinks.fingerprint(o), "print")
    altered = o.withColumn("o_totalprice", F.col("o_totalprice") + (F.col("o_orderkey") == 1).cast("int"))
    lines = v.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    costs = o.groupBy("season").agg(F.count(F.lit(1)).alias("cost"))
    tests = {
        "overwrite_refused": (lambda: sinks.write_once(o, at), AnalysisException, "PATH_ALREADY_EXISTS"),
        "missing_column_refused": (lambda: schema.require_columns(o, ["o_orderkey", "nothing"], "orders"), ValueError, "orders lacks nothing"),
        "unknown_field_refused": (lambda: schema.closed(o, o.drop("season").schema), ValueError, "fields outside the closed schema: season"),
        "result_field_refused": (lambda: schema.feature_matrix(o, ["o_orderkey", "o_orderstatus"], ["o_orderstatus"]), ValueError, "result-bearing fields: o_orderstatus"),
        "late_season_refused": (lambda: schema.season_firewall(o, 1990, 2000), ValueError, "are not within 1990..2000"),
        "ambiguous_refused": (lambda: audit.ambiguous(o, ["o_custkey"], strict=True)[0].count(), PySparkException, "ambiguous key"),
        "altered_table_refused": (lambda: sinks.verify_fingerprint(altered, stored), ValueError, "differs from its fingerprint"),
        "over_budget_refused": (lambda: audit.require_budget(costs, "cost", 10), ValueError, "over 10"),
        "late_wrapper_refused": (lambda: prices.eligible(v.quotes(spark, d), v.cutoffs(spark, d), ["event"], times=["quote_time"], wrapper="snapshot_time").count(), PySparkException, "snapshot after the cutoff of"),
        "conflict_refused": (lambda: joins.require_one_value(v.table(spark, d, "part"), ["p_name"], "p_brand").count(), PySparkException, "conflicting values of"),
        "many_matches_refused": (lambda: _band(spark, d, 10 * 86_400, single=True).count(), PySparkException, "more than one match for"),
        "partner_refused": (lambda: joins.beside(o, lines, ["o_orderkey"]).count(), PySparkException, "no single partner for"),
        "ambiguous_scorer_refused": (lambda: _scorers(spark, d, strict=True).agg(F.sum("scored")).collect(), PySparkException, "ambiguous scorer"),
    }
    schema.season_firewall(o, 1990, 2010)
    sinks.verify_fingerprint(o, stored)
    return o.agg(F.count(F.lit(1)).alias("rows"), *(F.lit(_refused(*t)).alias(n) for n, t in tests.items()))


@query("""SELECT p_name, count(*) n, count(DISTINCT p_brand) brands, CASE WHEN count(DISTINCT p_brand) > 1 THEN 'quarantine' ELSE 'accepted' END AS "table" FROM part GROUP BY 1""")
def ambiguity_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Names of one meaning are accepted; the others go to a table of their own with all their rows."""
    p = v.table(spark, d, "part")
    many = joins.conflicts(p, ["p_name"], "p_brand")
    bad, good = joins.members(p, many, ["p_name"]).withColumn("table", F.lit("quarantine")), joins.coverage_gap(p, many, ["p_name"]).withColumn("table", F.lit("accepted"))
    return good.unionByName(bad).groupBy("p_name", "table").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("brands")).select("p_name", "n", "brands", "table")


@query("""SELECT event_id, (((date_trunc('minute', ts)) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC')::TIMESTAMP kickoff, CASE WHEN event_id % 3 <> 0 THEN (ts - INTERVAL 2 HOUR)::TIMESTAMP END stated FROM events""")
def local_clocks(spark: SparkSession, d: str) -> DataFrame:
    """Local wall clocks as instants, and stated instants that count only if they name their zone."""
    e = v.table(spark, d, "events")
    kick = timing.local_to_utc(F.to_date("ts"), F.date_format("ts", "HH:mm"))
    told = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 3 != 0, "+02:00").otherwise(""))
    return e.select("event_id", kick.cast("timestamp_ntz").alias("kickoff"), timing.parse_zoned(told).cast("timestamp_ntz").alias("stated"))


@query("""SELECT o_orderkey, year(o_orderdate)::BIGINT season, month(o_orderdate)::BIGINT "week", 'T' || (o_custkey % 32) away, 'T' || (o_orderkey % 32) home FROM orders""")
def game_keys(spark: SparkSession, d: str) -> DataFrame:
    """Season, week and sides out of composed game keys."""
    key = F.concat_ws("_", F.year("o_orderdate"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0"), F.concat(F.lit("T"), F.col("o_custkey") % 32), F.concat(F.lit("T"), F.col("o_orderkey") % 32))
    o = v.table(spark, d, "orders").select("o_orderkey", text.game_key(key).alias("k"))
    return o.select("o_orderkey", big("k.season", "season"), big("k.week", "week"), F.col("k.away").alias("away"), F.col("k.home").alias("home"))


@query(v.sql("""SELECT event, player, round(x, 6) disagreement, books n_books, n_history, tail, ambiguous FROM (SELECT event, player, p - 1 / median_decimal x, books FROM v_wagers QUALIFY row_number() OVER (ORDER BY abs(round(p - 1 / median_decimal, 9)) DESC, event, player) <= 20) JOIN (SELECT user_id player, count(*) n_history, string_agg(event_type, ';' ORDER BY ts, event_id) FILTER (r <= 3) tail
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) GROUP BY 1) USING (player) JOIN (SELECT c_custkey player, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) > 1 ambiguous FROM customer) USING (player)"""))
def disagreement_history(spark: SparkSession, d: str) -> DataFrame:
    """The widest disagreements with each player's recent history and whether the identity is ambiguous."""
    w = v.wagers(spark, d).withColumn("x", F.col("p") - F.lit(1.0) / F.col("median_decimal"))
    c = v.table(spark, d, "customer").select(F.col("c_custkey").alias("player"), F.struct("c_nationkey", "c_mktsegment").alias("alias"))
    h = v.table(spark, d, "events").select(F.col("user_id").alias("player"), "event_type", "ts", "event_id")
    out = audit.disagreements(w, "x", ["event", "player"], h, ["player"], value="event_type", order=["ts", "event_id"], aliases=c, alias="alias")
    return out.select("event", "player", r6("x", "disagreement"), F.col("books").alias("n_books"), "n_history", "tail", "ambiguous")


def _band(spark: SparkSession, d: str, seconds: int, single: bool) -> DataFrame:
    e = v.table(spark, d, "events")
    b = e.where("event_type = 'error'").select(F.col("event_id").alias("other_id"), F.col("user_id").alias("u"), F.col("ts").alias("at"))
    return joins.band_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), b, [("user_id", "u")], left_time="ts", right_time="at", seconds=seconds, left_id="event_id", single=single)


def _scorers(spark: SparkSession, d: str, strict: bool = False) -> DataFrame:
    """Suppliers as players of an order: every eleventh shares its name with the next, every thirteenth has another team."""
    l = v.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("id")).agg(F.count_if(F.col("l_discount") >= 0.09).alias("n"))
    name = F.concat(F.lit("Player "), F.when(F.col("id") % 11 == 0, F.col("id") + 1).otherwise(F.col("id")))
    told = l.select("game", "id", name.alias("name"), (F.col("id") % 2).alias("team"), "n")
    rows = told.select("game", "id", F.upper("name").alias("name"), F.when(F.col("id") % 13 == 0, 9).otherwise(F.col("team")).alias("team"))
    return boxscore.scorers(told, rows, ["game"], name="name", team="team", normalise=text.normalize_name, strict=strict)


@query("""WITH l AS (SELECT l_orderkey game, l_suppkey id, CASE WHEN l_suppkey % 11 = 0 THEN l_suppkey + 1 ELSE l_suppkey END nm, l_suppkey % 2 team, count(*) FILTER (l_discount >= 0.09) n FROM lineitem GROUP BY 1, 2), o AS (SELECT game, nm, count(*) k, sum(n) n, any_value(team) team FROM l GROUP BY 1, 2)
SELECT team_status, count(*) n, coalesce(sum(CASE WHEN team_status = 'OK' THEN n END), 0)::BIGINT scored FROM (SELECT CASE WHEN k > 1 THEN 'AMBIGUOUS_SCORER' WHEN id % 13 = 0 THEN 'TEAM_MISMATCH' WHEN o.team <> l.team THEN 'TEAM_MISMATCH' ELSE 'OK' END team_status, o.n FROM l JOIN o USING (game, nm)) GROUP BY 1""")
def slate_scorers(spark: SparkSession, d: str) -> DataFrame:
    """Scores matched to a slate by name: shared names and other teams are told, not counted."""
    out = _scorers(spark, d)
    return out.groupBy("team_status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("scored"), F.lit(0)).cast("long").alias("scored"))


@query("""SELECT row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) - 1 AS "at", o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END o_totalprice FROM orders) QUALIFY "at" < 100""")
def sorted_report(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred rows of a global sort, numbered as they come: nulls last, ties by key."""
    o = v.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    top = o.orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(100)
    return top.agg(F.collect_list("o_orderkey").alias("ids")).select(F.posexplode("ids").alias("at", "o_orderkey")).select(big("at"), "o_orderkey")  # a hundred rows


@query("""SELECT count(*) rows, sum(('0x' || substr(md5('=' || o_orderkey || '|=' || o_custkey || '|=' || o_orderstatus || '|' || CASE WHEN o_orderkey % 7 = 0 THEN '-' ELSE '=' || o_orderpriority END), 1, 12))::BIGINT::HUGEINT)::VARCHAR digest FROM orders""")
def portable_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A digest of a table that another engine repeats, in any order of rows."""
    o = v.table(spark, d, "orders").withColumn("priority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
    return sinks.portable_fingerprint(o, ["o_orderkey", "o_custkey", "o_orderstatus", "priority"]).withColumn("digest", F.col("digest").cast("string"))
