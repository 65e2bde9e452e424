"""Audits of clocks, lineage, features, quotes and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import audit, lag
from ..sources import sinks
from . import views as v
from .q_lag import HIST, _targets
from .registry import query, r6


def _lineage(spark: SparkSession, d: str) -> DataFrame:
    return lag.prefix_features(v.games(spark, d), _targets(spark, d), ["entity"], metrics=["metric"], windows={"last5": 5}, with_ewma=False, lineage=5)


@query(v.sql("""SELECT status, violations, count(*) n FROM (SELECT CASE WHEN x = '' THEN 'PASS' ELSE 'BLOCKED' END status, x violations FROM (SELECT concat_ws('|', CASE WHEN snapshot_time >= cutoff THEN 'snapshot_time' END, CASE WHEN quote_time > cutoff THEN 'quote_time' END) x FROM v_quotes JOIN v_cutoff USING (event))) GROUP BY 1, 2"""))
def temporal_audit(spark: SparkSession, d: str) -> DataFrame:
    q = v.quotes(spark, d).join(v.cutoffs(spark, d), "event")
    return audit.temporal(q, "cutoff", ["snapshot_time"], ["quote_time"]).groupBy("status", "violations").agg(F.count(F.lit(1)).alias("n"))


@query(v.sql("""SELECT count(*) rows, count(*) FILTER (game_id % 97 = 0 OR game_id % 101 = 0) differing, count(*) FILTER (game_id % 101 = 0) unknown_sources, round(avg(m), 6) mean_value FROM (SELECT game_id, CASE WHEN game_id % 101 = 0 THEN avg(metric) FILTER (rn > 1) ELSE avg(metric) END m FROM h WHERE rn <= 5 GROUP BY 1)""", ("h", HIST)))
def lineage_recompute(spark: SparkSession, d: str) -> DataFrame:
    """Every reported mean rebuilt from the ids it names; some means are off and some ids unknown on purpose."""
    g = v.games(spark, d)
    told = _lineage(spark, d).where("n_history > 0")
    wrong, lost = F.col("game_id") % 97 == 0, F.col("game_id") % 101 == 0
    told = told.withColumn("last5_metric", F.col("last5_metric") + F.when(wrong, 0.5).otherwise(0.0)).withColumn("source_ids", F.when(lost, F.regexp_replace("source_ids", r"\d+$", "none")).otherwise(F.col("source_ids")))
    out = audit.recompute(told, g, ids="source_ids", source_id="game_id", value="metric", reported="last5_metric", keys=["game_id"], eps=1e-9)
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_if("differs").alias("differing"), F.sum("unknown_sources").cast("long").alias("unknown_sources"), r6(F.avg("recomputed"), "mean_value"))


@query(v.sql("""SELECT (SELECT count(*) FROM v_game) + (SELECT count(*) FROM v_game WHERE game_id % 89 = 0) AS rows, (SELECT count(*) FROM (SELECT DISTINCT game_id FROM h) WHERE game_id % 83 = 0) late_history, (SELECT count(*) FROM v_game WHERE game_id % 89 = 0) duplicate_rows, (SELECT count(*) FROM v_game WHERE game_id NOT IN (SELECT game_id FROM h)) no_history,
    (SELECT count(*) FROM v_game WHERE game_id % 79 = 0) share_out_of_range, (SELECT count(*) FROM v_game WHERE game_id % 73 = 0) schedule_differs, (SELECT count(*) FROM (SELECT DISTINCT game_id FROM h) WHERE game_id % 71 = 0) unknown_sources, (SELECT count(*) FROM v_game WHERE game_id % 67 = 0) family_not_null""", ("h", HIST)))
def feature_audit(spark: SparkSession, d: str) -> DataFrame:
    """Clocks, keys, shares, schedule, source ids and the unavailable family of a feature table with planted faults."""
    g = v.player_games(spark, d)
    f = lag.prefix_features(g, _targets(spark, d), ["entity"], shares={"share": ("td_value", "all_value")}, windows={"last5": 5}, with_ewma=False, lineage=5)
    every = lambda n: F.col("game_id") % n == 0
    f = f.withColumns({
        "max_available_at": F.when(every(83) & (F.col("n_history") > 0), F.col("prediction_time")).otherwise(F.col("max_available_at")), "last5_share": F.when(every(79), 1.5).otherwise(F.col("last5_share")),
        "kickoff": F.when(every(73), F.col("kickoff") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("kickoff")), "source_ids": F.when(every(71), F.regexp_replace("source_ids", r"\d+$", "none")).otherwise(F.col("source_ids")),
        "routes": F.when(every(67), 1.0),
    })
    f = f.unionByName(f.where(every(89)))
    return audit.feature_table(
        f, v.games(spark, d), key="game_id", cutoff="prediction_time", clocks=["latest_used", "max_available_at"], history="n_history", shares=["last5_share"], same_as_schedule=["kickoff", "entity"], ids="source_ids", null_families=["routes"]
    )


@query(v.sql("""SELECT count(*) + count(*) FILTER (event_id % 13 = 0) reported, count(*) FILTER (event_id % 11 = 0) + count(*) FILTER (event_id % 13 = 0) unsupported FROM v_per_book"""))
def quote_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Every chosen quote must exist in the raw table with its price and time; some prices are changed and some quotes made up."""
    from ..operators import prices

    q = v.quotes(spark, d)
    told = prices.one_per_book(v.eligible_quotes(spark, d), ["event", "player"], tie="event_id")
    made_up = told.where("event_id % 13 = 0").withColumn("book", F.lit("nobody"))
    told = told.withColumn("price", F.when(F.col("event_id") % 11 == 0, F.col("price") + 100_000).otherwise(F.col("price"))).unionByName(made_up)
    lost = audit.unmatched(told, q, ["event", "player", "book", "price", "quote_time"])
    return told.agg(F.count(F.lit(1)).alias("reported")).join(F.broadcast(lost.agg(F.count(F.lit(1)).alias("unsupported"))))  # one row each


@query(v.sql("""SELECT count(*) FILTER (a = b) agree, count(*) FILTER (a <> b) AS differ, count(*) FILTER (b IS NULL) only_left, count(*) FILTER (a IS NULL) only_right FROM (SELECT game_id, (sum(td) > 0)::INT a FROM v_plays WHERE kind IS NOT NULL GROUP BY 1) x FULL JOIN (SELECT game_id, (sum(td) > 0)::INT b FROM v_plays GROUP BY 1) y ON x.game_id = y.game_id"""))
def outcome_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Labels from opportunities against labels from all plays."""
    p = v.plays(spark, d)
    label = lambda df: df.groupBy("game_id").agg((F.sum("td") > 0).cast("int").alias("label"))
    return audit.outcome(label(p.where("kind IS NOT NULL")), label(p), ["game_id"], "label")


@query(v.sql("""SELECT coalesce(x.game_id, y.game_id) game_id, coalesce(a, b)::BIGINT AS label, CASE WHEN a IS NULL THEN 'all_plays_only' WHEN b IS NULL THEN 'opportunities_only' WHEN a = b THEN 'agreed' ELSE 'opportunities_over_all_plays' END provenance
    FROM (SELECT game_id, (sum(td) > 0)::INT a FROM v_plays WHERE kind IS NOT NULL AND line <> 3 GROUP BY 1) x FULL JOIN (SELECT game_id, (sum(td) > 0)::INT b FROM v_plays WHERE line <> 5 GROUP BY 1) y ON x.game_id = y.game_id"""))
def outcome_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The label of each game with where it comes from."""
    p = v.plays(spark, d)
    label = lambda df: df.groupBy("game_id").agg((F.sum("td") > 0).cast("long").alias("label"))
    return audit.with_provenance(label(p.where("kind IS NOT NULL AND line <> 3")), label(p.where("line <> 5")), ["game_id"], "label", ("opportunities", "all_plays"))


@query(v.sql("""SELECT reason, count(*) n FROM (SELECT CASE WHEN n_plays IS NULL THEN 'no_plays' WHEN coalesce(carries, 0) + coalesce(targets, 0) = 0 THEN 'no_opportunity' WHEN tds = 0 THEN 'no_score' ELSE 'none' END reason FROM v_player_game) GROUP BY 1"""))
def missing_reasons(spark: SparkSession, d: str) -> DataFrame:
    use = F.coalesce("carries", F.lit(0)) + F.coalesce("targets", F.lit(0))
    r = F.when(F.col("n_plays").isNull(), "no_plays").when(use == 0, "no_opportunity").when(F.col("tds") == 0, "no_score").otherwise("none")
    return v.player_games(spark, d).groupBy(r.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(v.sql("""SELECT count(*) rows, count(*) FILTER (p <= 0 OR p >= 1) out_of_range, count(*) FILTER (p2 <= 0 OR p2 >= 1) out_of_range_2, (count(*) - count(DISTINCT event_id)) duplicates, count(*) FILTER (y NOT IN (0, 1)) bad_label FROM v_scored"""))
def scored_table_audit(spark: SparkSession, d: str) -> DataFrame:
    s = v.scored(spark, d)
    n = s.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("p"), F.max("p2").alias("p2"), F.max("y").alias("y"))
    out = n.agg(F.sum("n").alias("rows"), F.count_if((F.col("p") <= 0) | (F.col("p") >= 1)).alias("out_of_range"), F.count_if((F.col("p2") <= 0) | (F.col("p2") >= 1)).alias("out_of_range_2"), F.sum(F.col("n") - 1).alias("duplicates"), F.count_if(~F.col("y").isin(0, 1)).alias("bad_label"))
    return out


@query(v.sql("""SELECT count(*) + count(*) FILTER (game_id % 61 = 0) rows, count(*) FILTER (game_id % 59 = 0) out_of_range, count(*) FILTER (game_id % 61 = 0) duplicates, count(*) FILTER (season % 4 = 0) + count(*) FILTER (season % 4 = 0 AND game_id % 61 = 0) not_forward, (SELECT count(*) FROM (SELECT season FROM v_game GROUP BY 1) WHERE season % 5 = 0) sums_differ FROM v_game"""))
def scored_season_audit(spark: SparkSession, d: str) -> DataFrame:
    """A scored table with planted faults: range, keys, fit season before the scored one, and season totals against their report."""
    g = v.games(spark, d).select("game_id", "season", F.when(F.col("game_id") % 59 == 0, 1.0).otherwise(0.25).alias("p"))
    g = g.withColumn("fit_upto", F.when(F.col("season") % 4 == 0, F.col("season")).otherwise(F.col("season") - 1))
    told = g.groupBy("season").agg((F.sum("p") + F.when(F.col("season") % 5 == 0, 1.0).otherwise(0.0)).alias("p"))
    return audit.scored_table(g.unionByName(g.where("game_id % 61 = 0")), g.groupBy("season").agg(F.sum("p").alias("p")), told, key="game_id", p="p", fit="fit_upto", season="season")


@query(v.sql("""SELECT count(*) FILTER (grp % 8 <> 5) + count(*) FILTER (grp % 9 = 4 AND grp % 8 <> 5) rows, count(*) FILTER (grp % 6 = 0 AND grp % 8 <> 5) differing, count(*) FILTER (grp % 8 = 5) + count(*) FILTER (grp % 9 = 4 AND grp % 8 <> 5) missing,
    count(*) FILTER (grp % 7 = 3 AND grp % 8 <> 5) + count(*) FILTER (grp % 7 = 3 AND grp % 9 = 4 AND grp % 8 <> 5) not_one FROM (SELECT DISTINCT season, grp FROM v_game)"""))
def team_table_audit(spark: SparkSession, d: str) -> DataFrame:
    """A stored table against its rebuild, and distributions that must sum to one, with planted faults."""
    from ..functions import dist

    g = v.games(spark, d).groupBy("season", "grp").agg(F.avg("metric").alias("mean"), F.count(F.lit(1)).alias("games"))
    masses = dist.poisson_masses(F.col("mean"))
    total = masses[0]
    for c in masses[1:]:
        total = total + c
    rebuilt = g.withColumn("total", total + F.when(F.col("grp") % 7 == 3, 0.25).otherwise(0.0))
    stored = rebuilt.withColumn("mean", F.col("mean") + F.when(F.col("grp") % 6 == 0, 0.01).otherwise(0.0)).where("grp % 8 <> 5")
    # some groups are not stored at all, and some that are not in the rebuild are
    stored = stored.unionByName(stored.where("grp % 9 = 4").withColumn("grp", F.col("grp") + 1000))
    return audit.rebuilt_table(stored, rebuilt, ["season", "grp"], ["mean", "games"], sums="total")


@query(v.sql("""SELECT count(*) rows, count(*) FILTER (abs(s - 1) > 1e-9) not_one FROM (SELECT event_id, exp(-m) * (1 + m + m * m / 2 + m * m * m / 6) + greatest(0, 1 - exp(-m) * (1 + m + m * m / 2 + m * m * m / 6)) s FROM (SELECT event_id, ln(1 + "value") m FROM events))"""))
def probability_sums_audit(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import dist

    masses = dist.poisson_masses(F.log1p("value"))
    total = masses[0]
    for c in masses[1:]:
        total = total + c
    e = v.table(spark, d, "events").select(total.alias("s"))
    return e.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(F.col("s") - 1) > 1e-9).alias("not_one"))


_WEEKS = """SELECT user_id player, date_trunc('week', ts)::DATE w, count(*) n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2"""
_PRIOR = """SELECT event, player, sum(n) usage, avg(n) FILTER (rn <= 3) recent, max(w) latest FROM (SELECT p.event, p.player, h.n, h.w, row_number() OVER (PARTITION BY p.event, p.player ORDER BY h.w DESC) rn FROM (SELECT DISTINCT event, player FROM v_eligible) p JOIN weeks h ON h.player = p.player AND h.w < p.event) GROUP BY 1, 2"""
_FRESH = """SELECT event, player, book, least(t1, t2) older FROM (SELECT event, player, book, max(quote_time) FILTER (side = 'Over') t1, max(quote_time) FILTER (side = 'Under') t2 FROM v_eligible GROUP BY 1, 2, 3) WHERE t1 IS NOT NULL AND t2 IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY event, player ORDER BY least(t1, t2) DESC, greatest(t1, t2) DESC, book) = 1"""


@query(v.sql("""SELECT e.event, e.player, usage_rank, coalesce(usage, 0)::BIGINT usage, round(recent, 6) recent_mean, f.book package_book, f.older package_time, told quote_time, coalesce(won, false) AS label, CASE WHEN told > cutoff THEN 'quote_time' ELSE '' END violations, CASE WHEN told > cutoff THEN 'BLOCKED' ELSE 'PASS' END status, greatest((latest + 7)::TIMESTAMP, f.older, told) max_available
    FROM (SELECT event, player, cutoff, CASE WHEN player % 17 = 0 THEN q + INTERVAL 5 DAY ELSE q END told, usage, recent, latest, row_number() OVER (PARTITION BY event ORDER BY coalesce(usage, 0) DESC, player) usage_rank FROM (SELECT event, player, max(cutoff) cutoff, max(quote_time) q FROM v_eligible GROUP BY 1, 2) LEFT JOIN prior USING (event, player)) e
    LEFT JOIN fresh f ON f.event = e.event AND f.player = e.player LEFT JOIN v_wagers w ON w.event = e.event AND w.player = e.player WHERE usage_rank <= 2""", ("weeks", _WEEKS), ("prior", _PRIOR), ("fresh", _FRESH)))
def audited_sample(spark: SparkSession, d: str) -> DataFrame:
    """The end-to-end point-in-time row of each week's two players of most prior usage.

    Usage and recent mean from the weeks before, the freshest two-sided package, the
    newest quote, the label, the newest clock of all and what it violates; some quotes
    are told too late on purpose.
    """
    from ..operators import prices

    e = v.table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("player"), F.to_date(F.date_trunc("week", "ts")).alias("w"))
    weeks = e.groupBy("player", "w").agg(F.count(F.lit(1)).alias("n")).withColumn("begins", F.col("w").cast("timestamp_ntz")).withColumn("ends", F.col("begins") + F.expr("INTERVAL 7 DAYS"))
    q = v.eligible_quotes(spark, d)
    keys = ["event", "player"]
    rows = q.groupBy(*keys).agg(F.max("cutoff").alias("cutoff"), F.max("quote_time").alias("quote_time"))
    rows = lag.prefix_features(weeks, rows, ["player"], time="begins", available_at="ends", cutoff="cutoff", row_id="w", metrics=["n"], windows={"last3": 3, "all": None}, null_policy="skip", sums=True, with_ewma=False, lineage=1)
    top = agg.first_n(rows.withColumn("usage", F.coalesce("all_sum_n", F.lit(0)).cast("long")), ["event"], [F.desc("usage"), F.col("player")], 2)
    sides = q.groupBy(*keys, "book").agg(*(F.max(F.when(F.col("side") == s, F.col("quote_time"))).alias(t) for s, t in (("Over", "t1"), ("Under", "t2")))).where("t1 IS NOT NULL AND t2 IS NOT NULL")
    fresh = prices.freshest_package(sides, keys, first_time="t1", second_time="t2", priority=F.lit(0), tie="book").select(*keys, F.col("book").alias("package_book"), F.least("t1", "t2").alias("package_time"))
    out = top.join(fresh, keys, "left").join(v.wagers(spark, d).select(*keys, "won"), keys, "left")
    out = out.withColumn("quote_time", F.when(F.col("player") % 17 == 0, F.col("quote_time") + F.expr("INTERVAL 5 DAYS")).otherwise(F.col("quote_time")))
    out = audit.temporal(out, "cutoff", ["max_available_at"], ["package_time", "quote_time"])
    return out.select(*keys, F.col("rank").cast("long").alias("usage_rank"), "usage", r6("last3_n", "recent_mean"), "package_book", "package_time", "quote_time", F.coalesce("won", F.lit(False)).alias("label"), "violations", "status", "max_available")


@query()
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Order-insensitive fingerprints of the fact tables; hashes are the engine's own."""
    parts = [sinks.fingerprint(v.table(spark, d, t)).withColumn("table", F.lit(t)) for t in ("orders", "lineitem", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT sha256("value") sha256, count(*) offered, min("value") "value", min("value") < '3' AS known FROM (SELECT o_orderpriority || o_orderstatus AS "value" FROM orders) GROUP BY 1""")
def artifact_registry(spark: SparkSession, d: str) -> DataFrame:
    """Content-addressed payloads, inserted once each, or ignored where the registry has them."""
    o = v.table(spark, d, "orders").select(F.concat("o_orderpriority", "o_orderstatus").alias("value"))
    dig = o.withColumn("sha256", sinks.payload_digest("value"))
    held = dig.where("value < '3'").dropDuplicates(["sha256"])
    new = sinks.new_artifacts(held, dig)
    registry = held.withColumn("known", F.lit(True)).unionByName(new.withColumn("known", F.lit(False)))
    return registry.join(dig.groupBy("sha256").agg(F.count(F.lit(1)).alias("offered")), "sha256").select("sha256", "offered", "value", "known")
