"""Wagers from quotes to settlement, rules and audits of the season."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import odds, timing
from ..operators import backtest as bt
from ..operators import audit, metrics, prices
from . import views as v
from .registry import big, query, r6


_CLOSE = f"""SELECT event, player, count(*) n_close, median({v.dec("close_price")}) mid FROM v_close GROUP BY 1, 2"""


@query(v.sql("SELECT w.event, w.player, best_book, round(clv, 6) clv, clv > 0 beat_close, round(mid, 6) closing_median, round(1 / mid - 1 / median_decimal, 6) clv_median FROM v_wagers w LEFT JOIN c ON c.event = w.event AND c.player = w.player WHERE clv IS NOT NULL", ("c", _CLOSE)))
def close_join_clv(spark: SparkSession, d: str) -> DataFrame:
    """Entry price against the same book's last price before kickoff, and median against median."""
    w = v.wagers(spark, d).where("clv IS NOT NULL")
    mid = v.closes(spark, d).groupBy("event", "player").agg(F.median(odds.american_to_decimal(F.col("close_price"))).alias("closing_median"))
    w = w.join(mid, ["event", "player"], "left")
    return w.select("event", "player", "best_book", r6("clv"), (F.col("clv") > 0).alias("beat_close"), r6("closing_median"), r6(odds.closing_line_value(F.col("median_decimal"), F.col("closing_median")), "clv_median"))


@query(v.sql("""SELECT w.event, w.player, best_book, round("decimal", 6) best_decimal, round(median_decimal, 6) median_decimal, books, round(CASE WHEN player % 9 <> 0 THEN ev END, 6) ev, round(CASE WHEN player % 9 <> 0 THEN edge END, 6) edge, coalesce(player % 9 <> 0 AND ev >= 0.05 AND edge >= 0.025, false) bet,
    coalesce(nullif(concat_ws('|', CASE WHEN player % 9 = 0 THEN 'UNMODELED' END, CASE WHEN books < 3 THEN 'FEW_BOOKS' END, CASE WHEN "decimal" / median_decimal - 1 >= 0.25 THEN 'OUTLIER' END), ''), 'OK') flags FROM v_wagers w"""))
def stage_a(spark: SparkSession, d: str) -> DataFrame:
    w = bt.stage_a(_offers(spark, d))
    return w.select("event", "player", "best_book", r6("decimal", "best_decimal"), r6("median_decimal"), "books", r6("ev"), r6("edge"), "bet", "flags")


def _offers(spark: SparkSession, d: str) -> DataFrame:
    """Best offers; every ninth player has no model."""
    w = v.wagers(spark, d).select("event", "player", "best_book", "decimal", "median_decimal", "books", "p")
    return w.withColumn("p", F.when(F.col("player") % 9 != 0, F.col("p")))


_SETTLE = """SELECT w.*, CASE WHEN player % 9 = 0 THEN 'unmodeled' WHEN a.act THEN 'graded_played' ELSE 'policy_unknown' END status, n, mid FROM v_wagers w LEFT JOIN (SELECT DISTINCT date_trunc('week', ts)::DATE AS event, user_id player, true act FROM events WHERE event_type IN ('purchase', 'click')) a USING (event, player)
    LEFT JOIN (SELECT date_trunc('week', ts)::DATE AS event, user_id player, count(*) n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) USING (event, player) LEFT JOIN c USING (event, player)"""


def _settled(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events").select(F.to_date(F.date_trunc("week", "ts")).alias("event"), F.col("user_id").alias("player"), "event_type")
    counts = e.where("event_type = 'purchase'").groupBy("event", "player").agg(F.count(F.lit(1)).alias("n"))
    closes = v.closes(spark, d).withColumn("close_decimal", odds.american_to_decimal(F.col("close_price")))
    return bt.settle(bt.stage_a(_offers(spark, d)), e.where("event_type IN ('purchase', 'click')"), counts, closes, ["event", "player"])


@query(v.sql("""SELECT event, player, status, CASE WHEN status = 'graded_played' THEN coalesce(n, 0) END::DOUBLE actual, CASE WHEN status = 'graded_played' THEN round(profit, 6) END profit, CASE WHEN status = 'graded_played' THEN round(profit_median, 6) END profit_median, round(clv, 6) clv, round(1 / mid - 1 / median_decimal, 6) clv_median FROM s""", ("c", _CLOSE), ("s", _SETTLE)))
def settlement(spark: SparkSession, d: str) -> DataFrame:
    """Unmodeled, graded where participation is proven, unknown elsewhere."""
    return _settled(spark, d).select("event", "player", "status", F.col("actual").cast("double").alias("actual"), r6("profit"), r6("profit_median"), r6("clv"), r6("clv_median"))


@query(v.sql("""SELECT event, count(*) bets, count(*) FILTER (won) wins, round(sum(profit), 6) net, round(avg(profit), 6) roi, round(avg("decimal"), 6) mean_decimal, round(avg(ev), 6) mean_ev, round(avg(edge), 6) mean_edge, round(avg(clv), 6) mean_clv, round(avg((clv IS NOT NULL)::INT), 6) clv_coverage FROM v_wagers WHERE edge >= 0 GROUP BY 1"""))
def portfolio(spark: SparkSession, d: str) -> DataFrame:
    out = bt.portfolio(v.wagers(spark, d).where("edge >= 0"), ["event"])
    return out.select("event", "bets", "wins", *(r6(c) for c in ("net", "roi", "mean_decimal", "mean_ev", "mean_edge", "mean_clv", "clv_coverage")))


@query(v.sql("""SELECT event, round(sum(profit), 6) equity, round(max(pk), 6) peak, round(max(pk - e), 6) max_drawdown FROM (SELECT *, greatest(0, max(e) OVER w) pk FROM (SELECT event, player, profit, sum(profit) OVER (PARTITION BY event ORDER BY player) e FROM v_wagers) WINDOW w AS (PARTITION BY event ORDER BY player)) GROUP BY 1"""))
def drawdown(spark: SparkSession, d: str) -> DataFrame:
    return bt.drawdown(v.wagers(spark, d), ["event"], ["player"], parts=16).select("event", r6("equity"), r6("peak"), r6("max_drawdown"))


@query(v.sql("""SELECT event, max(n) longest_losing_streak FROM (SELECT event, i, count(*) FILTER (NOT won) n FROM (SELECT event, won, sum(won::INT) OVER (PARTITION BY event ORDER BY player) i FROM v_wagers) GROUP BY 1, 2) GROUP BY 1"""))
def losing_streak(spark: SparkSession, d: str) -> DataFrame:
    return bt.losing_streak(v.wagers(spark, d), ["event"], ["player"], parts=16)


@query(v.sql("""SELECT event, round(sum(profit) FILTER (r <= 1) / sum(profit), 6) top1_share, round(sum(profit) FILTER (r <= 2) / sum(profit), 6) top2_share FROM (SELECT event, profit, row_number() OVER (PARTITION BY event ORDER BY profit DESC, player) r FROM v_wagers WHERE profit > 0) GROUP BY 1"""))
def winner_share(spark: SparkSession, d: str) -> DataFrame:
    return bt.winner_share(v.wagers(spark, d), ["event"], tie=["player"]).select("event", r6("top1_share"), r6("top2_share"))


_GRID = """SELECT min_edge, min_ev, min_books, count(*) bets, count(*) FILTER (won) wins, sum(profit) net_best, sum(profit_median) net_median, avg(profit) roi_best, avg(profit_median) roi_median, avg(clv) mean_clv, avg((clv IS NOT NULL)::INT) clv_coverage, max(profit) FILTER (profit > 0) / sum(profit) FILTER (profit > 0) top_share
    FROM v_wagers, (VALUES (0.0::DOUBLE), (0.01), (0.025), (0.05), (0.10)) a(min_edge), (VALUES (0.0::DOUBLE), (0.05), (0.10), (0.20)) b(min_ev), (VALUES (1), (2), (3)) c(min_books) WHERE edge >= min_edge AND ev >= min_ev AND books >= min_books GROUP BY 1, 2, 3"""


@query(v.sql("SELECT min_edge::DOUBLE min_edge, min_ev::DOUBLE min_ev, min_books::BIGINT min_books, bets, wins, round(net_best, 6) net_best, round(net_median, 6) net_median, round(roi_best, 6) roi_best, round(clv_coverage, 6) clv_coverage, round(top_share, 6) top_share FROM g", ("g", _GRID)))
def rule_grid(spark: SparkSession, d: str) -> DataFrame:
    """Sixty rules over one scan."""
    g = bt.rule_grid(v.wagers(spark, d))
    return g.select("min_edge", "min_ev", big("min_books"), "bets", "wins", r6("net_best"), r6("net_median"), r6("roi_best"), r6("clv_coverage"), r6("top_share"))


@query(v.sql("""SELECT min_edge::DOUBLE min_edge, min_ev::DOUBLE min_ev, min_books::BIGINT min_books, bets, round(roi_best, 6) roi_best, row_number() OVER (ORDER BY round(roi_median, 9) DESC, round(mean_clv, 9) DESC, bets DESC, min_edge, min_ev, min_books) "rank" FROM g WHERE bets >= 20 AND roi_best > 0 AND roi_median >= 0 AND coalesce(mean_clv, -1) >= 0 AND clv_coverage >= 0.5 AND top_share <= 0.5 QUALIFY "rank" <= 5""", ("g", _GRID)))
def rule_shortlist(spark: SparkSession, d: str) -> DataFrame:
    g = bt.rule_grid(v.wagers(spark, d)).withColumns({c: F.round(c, 9) for c in ("roi_median", "mean_clv")})
    return bt.shortlist(g, min_bets=20).select("min_edge", "min_ev", big("min_books"), "bets", r6("roi_best"), big("rank"))


@query(v.sql("""SELECT t::DOUBLE threshold, count(*) bets, round(sum(profit), 6) net, round(avg(profit), 6) roi FROM v_wagers, (VALUES (0.0::DOUBLE), (0.05), (0.10), (0.25)) l(t) WHERE CASE WHEN t = 0 THEN ev > 0 ELSE ev >= t END GROUP BY 1"""))
def ev_ladder(spark: SparkSession, d: str) -> DataFrame:
    return bt.ev_ladder(v.wagers(spark, d)).select("threshold", "bets", r6("net"), r6("roi"))


_EDGES = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in zip(bt.EDGE_BINS[:-1], bt.EDGE_BINS[1:], strict=True))


@query(v.sql(f"""SELECT lo, count(*) n, round(avg(won::INT), 6) hit_rate, round(avg(p), 6) mean_p, round(avg("decimal"), 6) mean_decimal, round(avg(profit), 6) roi, round(avg(clv), 6) mean_clv FROM v_wagers JOIN (VALUES {_EDGES}) b(lo, hi) ON edge > lo AND edge <= hi GROUP BY 1"""))
def edge_buckets(spark: SparkSession, d: str) -> DataFrame:
    w = v.wagers(spark, d)
    w = w.withColumn("lo", bt.buckets(w, "edge", bt.EDGE_BINS)).where("lo IS NOT NULL")
    return w.groupBy("lo").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("won").cast("double")), "hit_rate"), r6(F.avg("p"), "mean_p"), r6(F.avg("decimal"), "mean_decimal"), r6(F.avg("profit"), "roi"), r6(F.avg("clv"), "mean_clv"))


@query(v.sql("""SELECT event, count(*) n, round(avg(clv), 6) mean_clv, round(avg((clv > 0)::INT), 6) beating, round(max(clv) FILTER (r = c // 2), 6) upper_median FROM (SELECT event, clv, row_number() OVER (PARTITION BY event ORDER BY clv) - 1 r, count(*) OVER (PARTITION BY event) c FROM v_wagers WHERE clv IS NOT NULL) GROUP BY 1"""))
def clv_summary(spark: SparkSession, d: str) -> DataFrame:
    w = v.wagers(spark, d).where("clv IS NOT NULL")
    a = w.groupBy("event").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("clv"), "mean_clv"), r6(F.avg((F.col("clv") > 0).cast("double")), "beating"))
    return a.join(metrics.upper_median(w, "clv", ["event"]), "event").withColumn("upper_median", r6("upper_median"))


@query(v.sql("""SELECT best_book, books::DOUBLE books, CASE WHEN edge >= 0 THEN 'yes' ELSE 'no' END positive, count(*) n, round(avg(profit), 6) roi FROM v_wagers GROUP BY GROUPING SETS ((best_book), (v_wagers.books), (positive), ())"""))
def grouping_sets_diag(spark: SparkSession, d: str) -> DataFrame:
    """Diagnostics by book, by number of books and by sign of the edge, in one scan."""
    w = v.wagers(spark, d).withColumn("positive", F.when(F.col("edge") >= 0, "yes").otherwise("no"))
    return w.groupingSets([["best_book"], ["books"], ["positive"], []], "best_book", "books", "positive").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("profit"), "roi")).withColumn("books", F.col("books").cast("double"))


@query(v.sql("""SELECT w.event, count(*) bets, round(sum(profit), 6) net_best, round(sum(profit_median), 6) net_median, count(*) FILTER (t IS NOT NULL) inactive_bets, round(coalesce(sum(profit) FILTER (t IS NULL), 0), 6) void_net_best, round(coalesce(sum(profit_median) FILTER (t IS NULL), 0), 6) void_net_median
    FROM v_wagers w LEFT JOIN (SELECT DISTINCT date_trunc('week', ts)::DATE AS event, user_id player, true t FROM events WHERE event_type = 'error' AND "value" > 60) x ON x.event = w.event AND x.player = w.player WHERE ev >= 0.05 AND edge >= 0.025 GROUP BY 1"""))
def same_picks_median(spark: SparkSession, d: str) -> DataFrame:
    """Picks made at the best price, settled at the median one, and both with absent players void."""
    e = v.table(spark, d, "events").where("event_type = 'error' AND value > 60").select(F.to_date(F.date_trunc("week", "ts")).alias("event"), F.col("user_id").alias("player"), F.lit(True).alias("out")).distinct()
    w = v.wagers(spark, d).join(e, ["event", "player"], "left")
    t = bt.price_variants(w, ["event"], bet=(F.col("ev") >= 0.05) & (F.col("edge") >= 0.025), inactive=F.col("out"))
    return t.select("event", "bets", r6("net_best"), r6("net_median"), "inactive_bets", r6("void_net_best"), r6("void_net_median"))


@query(v.sql("""SELECT event, player, CASE WHEN NOT bet THEN 'not_bet' WHEN z IS NULL THEN 'pending' WHEN inactive AND NOT coalesce(played, false) THEN CASE WHEN best_book = 'b1' THEN 'lost_dnp_action' ELSE 'void' END WHEN played IS NULL THEN 'pending' WHEN won THEN 'won' ELSE 'lost' END status
    FROM (SELECT w.event, w.player, w.best_book, w.won, w.edge >= 0 bet, w.close_decimal z, coalesce(bool_or(e.event_type = 'error' AND e."value" > 60), false) inactive, bool_or(CASE WHEN e.event_type = 'click' THEN true END) played
    FROM v_wagers w LEFT JOIN events e ON e.user_id = w.player AND date_trunc('week', e.ts)::DATE = w.event GROUP BY ALL)"""))
def wager_status(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("event"), F.col("user_id").alias("player")).agg(
        F.bool_or((F.col("event_type") == "error") & (F.col("value") > 60)).alias("inactive"), F.bool_or(F.when(F.col("event_type") == "click", F.lit(True))).alias("played")
    )
    w = v.wagers(spark, d).join(e, ["event", "player"], "left")
    s = bt.wager_status(bet=F.col("edge") >= 0, settled=F.col("close_decimal").isNotNull(), played=F.col("played"), inactive=F.col("inactive"), won=F.col("won"), action_on_absent=F.col("best_book") == "b1")
    return w.select("event", "player", s.alias("status"))


@query(v.sql("""SELECT event, count(*) n, count(*) FILTER (age <= 300) fresh, count(*) FILTER (age > 300 AND age <= 86400) middle, count(*) FILTER (age > 86400) stale, round(sum(profit) FILTER (age > 86400), 6) stale_net FROM (SELECT w.event, profit, date_diff('microsecond', best_time, cutoff) / 1e6 age FROM v_wagers w JOIN v_cutoff USING (event)) GROUP BY 1"""))
def frozen_rule_segments(spark: SparkSession, d: str) -> DataFrame:
    """A frozen rule's picks by quote age, with what stale quotes contribute."""
    w = v.wagers(spark, d).join(v.cutoffs(spark, d), "event").withColumn("age", timing.seconds_between(F.col("best_time"), F.col("cutoff")))
    return w.groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("age") <= 300).alias("fresh"), F.count_if((F.col("age") > 300) & (F.col("age") <= 86400)).alias("middle"), F.count_if(F.col("age") > 86400).alias("stale"),
        r6(F.sum(F.when(F.col("age") > 86400, F.col("profit"))), "stale_net"),
    )


_PICKS = """SELECT w.*, date_diff('microsecond', best_time, cutoff) / 60e6 age, CASE WHEN month(event) = 1 AND day(event) <= 8 THEN 'early' WHEN month(event) = 1 AND day(event) <= 15 THEN 'middle' ELSE 'late' END seg FROM v_wagers w JOIN v_cutoff USING (event) WHERE edge >= 0.025 AND ev >= 0.05 AND books >= 2"""


@query(v.sql("""SELECT *, bets >= 20 AND roi > 0 AND roi_median > 0 AND coalesce(mean_clv, -1) >= 0 AND clv_coverage >= 0.5 AND (net_early >= 0)::INT + (net_middle >= 0)::INT + (net_late >= 0)::INT >= 2 AND top_two_share <= 0.5 AND stale_net <= net / 2 AND longshot_net <= net / 2 promoted FROM
    (SELECT count(*) bets, round(sum(profit), 6) net, round(avg(profit), 6) roi, round(avg(profit_median), 6) roi_median, round(avg(clv), 6) mean_clv, round(avg((clv IS NOT NULL)::INT), 6) clv_coverage, round((SELECT sum(profit) FROM (SELECT profit FROM k WHERE profit > 0 ORDER BY profit DESC LIMIT 2)) / sum(profit) FILTER (profit > 0), 6) top_two_share,
    round(coalesce(sum(profit) FILTER (age > 30), 0), 6) stale_net, round(coalesce(sum(profit) FILTER ("decimal" >= 6), 0), 6) longshot_net, round(coalesce(sum(profit) FILTER (seg = 'early'), 0), 6) net_early, round(coalesce(sum(profit) FILTER (seg = 'middle'), 0), 6) net_middle, round(coalesce(sum(profit) FILTER (seg = 'late'), 0), 6) net_late FROM k)""", ("k", _PICKS)))
def frozen_rule_promotion(spark: SparkSession, d: str) -> DataFrame:
    """A frozen rule on its later picks: segments, stale and longshot nets, and the promotion rule."""
    w = v.wagers(spark, d).join(v.cutoffs(spark, d), "event").where("edge >= 0.025 AND ev >= 0.05 AND books >= 2")
    day = F.dayofmonth("event")
    seg = F.when((F.month("event") == 1) & (day <= 8), "early").when((F.month("event") == 1) & (day <= 15), "middle").otherwise("late")
    out = bt.validate_rule(w, segment=seg, stale=timing.seconds_between(F.col("best_time"), F.col("cutoff")) / 60 > 30, longshot=F.col("decimal") >= 6, min_bets=20)
    return out.select("bets", *(r6(c) for c in out.columns if c not in ("bets", "promoted")), "promoted")


_CUTS = """SELECT won, profit, best_book book, CASE player % 4 WHEN 0 THEN 'RB' WHEN 1 THEN 'WR' WHEN 2 THEN 'TE' ELSE 'QB' END "position", CASE WHEN age <= 5 THEN '<=5m' WHEN age <= 15 THEN '5-15m' WHEN age <= 30 THEN '15-30m' ELSE '>30m' END age, CASE WHEN "decimal" < 2 THEN 'negative' WHEN "decimal" < 3 THEN '+100-199' WHEN "decimal" < 4 THEN '+200-299' WHEN "decimal" < 6 THEN '+300-499' ELSE '+500+' END odds,
    CASE WHEN gap <= 0.05 THEN '<=5%' WHEN gap <= 0.15 THEN '5-15%' WHEN gap <= 0.30 THEN '15-30%' ELSE '>30%' END dispersion FROM (SELECT w.*, date_diff('microsecond', best_time, cutoff) / 60e6 age, "decimal" / median_decimal - 1 gap FROM v_wagers w JOIN v_cutoff USING (event))"""


@query(v.sql("SELECT cut, value, count(*) n, count(*) FILTER (won) wins, round(sum(profit), 6) net, round(avg(profit), 6) roi FROM (UNPIVOT k ON book, \"position\", age, odds, dispersion INTO NAME cut VALUE value) GROUP BY 1, 2", ("k", _CUTS)))
def diagnostic_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Portfolios by book, position, quote age, odds range and dispersion, in one scan."""
    w = v.wagers(spark, d).join(v.cutoffs(spark, d), "event")
    age, gap, price = timing.seconds_between(F.col("best_time"), F.col("cutoff")) / 60, odds.dispersion(F.col("decimal"), F.col("median_decimal")), F.col("decimal")
    cuts = {
        "book": F.col("best_book"), "position": F.element_at(F.array(*(F.lit(x) for x in ("RB", "WR", "TE", "QB"))), (F.col("player") % 4 + 1).cast("int")),
        "age": F.when(age <= 5, "<=5m").when(age <= 15, "5-15m").when(age <= 30, "15-30m").otherwise(">30m"),
        "odds": F.when(price < 2, "negative").when(price < 3, "+100-199").when(price < 4, "+200-299").when(price < 6, "+300-499").otherwise("+500+"),
        "dispersion": F.when(gap <= 0.05, "<=5%").when(gap <= 0.15, "5-15%").when(gap <= 0.30, "15-30%").otherwise(">30%"),
    }
    return bt.diagnostics(w, cuts).select("cut", "value", "n", "wins", r6("net"), r6("roi"))


#: The settled table with faults planted by player, and some rows twice.
_FAULTY = """SELECT event, player, p, "decimal", cutoff, ev + CASE WHEN player % 11 = 0 THEN 0.01 ELSE 0 END ev, edge - CASE WHEN player % 13 = 0 THEN 0.02 ELSE 0 END edge,
    best_time + CASE WHEN player % 17 = 0 THEN INTERVAL 30 DAY ELSE INTERVAL 0 DAY END best_time, CASE WHEN player % 19 <> 0 THEN profit END profit FROM v_wagers JOIN v_cutoff USING (event)"""


@query(v.sql("""SELECT count(*) rows, count(*) FILTER (abs(ev - (p * "decimal" - 1)) > 1e-9) bad_ev, count(*) FILTER (abs(edge - (p - 1 / "decimal")) > 1e-9) bad_edge, count(*) FILTER (best_time > cutoff) late, count(*) FILTER (profit IS NULL) ungraded, count(*) - count(DISTINCT (event, player)) duplicates
    FROM (SELECT * FROM faulty UNION ALL SELECT * FROM faulty WHERE player % 23 = 0)""", ("faulty", _FAULTY)))
def backtest_audit(spark: SparkSession, d: str) -> DataFrame:
    """Violation counts of the settled table, with planted faults of every kind."""
    w = v.wagers(spark, d).join(v.cutoffs(spark, d), "event").select("event", "player", "p", "decimal", "cutoff", "ev", "edge", "best_time", "profit")
    hit = lambda k: F.col("player") % k == 0
    w = w.withColumns({
        "ev": F.col("ev") + F.when(hit(11), 0.01).otherwise(0.0), "edge": F.col("edge") - F.when(hit(13), 0.02).otherwise(0.0),
        "best_time": F.when(hit(17), F.col("best_time") + F.expr("INTERVAL 30 DAYS")).otherwise(F.col("best_time")), "profit": F.when(~hit(19), F.col("profit")),
    })
    rules = {
        "bad_ev": F.abs(F.col("ev") - odds.expected_value(F.col("p"), F.col("decimal"))) > 1e-9, "bad_edge": F.abs(F.col("edge") - odds.edge(F.col("p"), F.col("decimal"))) > 1e-9,
        "late": F.col("best_time") > F.col("cutoff"), "ungraded": F.col("profit").isNull(),
    }
    both = w.unionByName(w.where(hit(23)))
    counts = audit.count_violations(both, rules)
    again = both.agg((F.count(F.lit(1)) - F.count_distinct("event", "player")).alias("duplicates"))
    return counts.crossJoin(F.broadcast(again))  # one row each


@query(v.sql("""SELECT event, player, round(p - 1 / median_decimal, 6) disagreement, n_books FROM (SELECT *, books n_books FROM v_wagers) QUALIFY row_number() OVER (ORDER BY abs(round(p - 1 / median_decimal, 9)) DESC, event, player) <= 20"""))
def disagreement_audit(spark: SparkSession, d: str) -> DataFrame:
    """The twenty picks on which model and market differ most: a top-k report."""
    w = v.wagers(spark, d).withColumn("x", F.round(F.col("p") - odds.implied_probability(F.col("median_decimal")), 9))
    return w.orderBy(F.desc(F.abs("x")), "event", "player").limit(20).select("event", "player", r6("x", "disagreement"), F.col("books").alias("n_books"))


@query(v.sql("""SELECT "position", count(*) n, round(-avg(CASE WHEN won THEN ln(p) ELSE ln(1 - p) END), 6) model_ll, round(-avg(CASE WHEN won THEN ln(q) ELSE ln(1 - q) END), 6) market_ll, round(avg(p - q), 6) mean_difference, round(avg(abs(p - q)), 6) mean_gap FROM (SELECT *, least(1 - 1e-6, greatest(1e-6, 1 / median_decimal)) q, CASE player % 4 WHEN 0 THEN 'RB' WHEN 1 THEN 'WR' WHEN 2 THEN 'TE' ELSE 'QB' END "position" FROM v_wagers WHERE books >= 2) GROUP BY GROUPING SETS (("position"), ())"""))
def matched_market_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Model and market on the rows that have a price, by position and over all."""
    w = v.wagers(spark, d).where("books >= 2").withColumn("y", F.col("won").cast("int")).withColumn("q", metrics.clip(odds.implied_probability(F.col("median_decimal"))))
    w = w.withColumn("position", F.element_at(F.array(*(F.lit(x) for x in ("RB", "WR", "TE", "QB"))), (F.col("player") % 4 + 1).cast("int")))
    gap = F.col("p") - F.col("q")
    out = w.groupingSets([["position"], []], "position").agg(F.count(F.lit(1)).alias("n"), metrics.log_loss(F.col("p"), F.col("y")).alias("model_ll"), metrics.log_loss(F.col("q"), F.col("y")).alias("market_ll"), F.avg(gap).alias("mean_difference"), F.avg(F.abs(gap)).alias("mean_gap"))
    return out.select("position", "n", *(r6(c) for c in out.columns[2:]))


@query(v.sql(f"""SELECT event, player, line, count(DISTINCT book) books, round(median(over_), 6) median_over, round(avg((1 / over_) / (1 / over_ + 1 / under_)), 6) fair_over FROM (SELECT q.event, s.s_suppkey player, book, line, max(d) FILTER (side = 'Over') over_, max(d) FILTER (side = 'Under') under_ FROM
    (SELECT *, {v.dec("price")} d FROM v_eligible) q JOIN supplier s ON s.s_suppkey = q.player GROUP BY 1, 2, 3, 4 HAVING over_ IS NOT NULL AND under_ IS NOT NULL) GROUP BY 1, 2, 3"""))
def line_market_normalise(spark: SparkSession, d: str) -> DataFrame:
    """The whole job: flatten nested quotes, match players by name, pair the sides, take the consensus."""
    q = v.eligible_quotes(spark, d)
    outcome = F.struct(F.col("side").alias("name"), F.concat(F.lit("SUPPLIER  "), "player").alias("description"), F.col("line").alias("point"), "price")
    nested = q.groupBy("snapshot_time", "event", "book", "quote_time").agg(F.collect_list(outcome).alias("outcomes"))
    market = F.array(F.struct(F.lit("prop").alias("key"), F.col("quote_time").alias("last_update"), "outcomes"))
    docs = nested.select(F.col("snapshot_time").alias("timestamp"), F.col("event").cast("string").alias("event"), F.array(F.struct(F.col("book").alias("key"), market.alias("markets"))).alias("bookmakers"))
    names = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Supplier "), "s_suppkey").alias("name"))
    out = prices.line_market(docs, names, name="name", player_id="id")
    return out.select(F.to_date("event").alias("event"), F.col("resolved_id").alias("player"), "line", "books", r6("median_over"), r6("fair_over"))


@query(v.sql("""SELECT a.event, count(*) planned, count(b.player) quoted, count(*) - count(b.player) missing, (count(*) - count(b.player)) * 10 credits FROM (SELECT event, player FROM (SELECT DISTINCT event FROM v_quotes), (SELECT DISTINCT player FROM v_quotes)) a LEFT JOIN (SELECT DISTINCT event, player FROM v_eligible) b ON a.event = b.event AND a.player = b.player GROUP BY 1"""))
def budget_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a plan of every player in every week still lacks, and what it would cost: counts only, no pairs."""
    q = v.quotes(spark, d)
    players = q.agg(F.count_distinct("player").alias("planned"))  # one row
    have = v.eligible_quotes(spark, d).groupBy("event").agg(F.count_distinct("player").alias("quoted"))
    out = q.select("event").distinct().crossJoin(F.broadcast(players)).join(have, "event", "left").withColumn("quoted", F.coalesce("quoted", F.lit(0)))
    missing = F.col("planned") - F.col("quoted")
    return out.select("event", "planned", "quoted", missing.alias("missing"), (missing * 10).alias("credits"))


@query(v.sql("""SELECT event, player, best_book, round("decimal", 6) "decimal", books, round(p, 6) p, round(date_diff('microsecond', best_time, cutoff) / 1e6, 6) age, 3::BIGINT refused_fields FROM v_wagers JOIN v_cutoff USING (event)"""))
def closed_pregame_view(spark: SparkSession, d: str) -> DataFrame:
    """The rows as they were known before kickoff, under a closed schema; fields that bear a result are refused."""
    from ..sources import schema

    w = v.wagers(spark, d).join(v.cutoffs(spark, d), "event").withColumn("age", timing.seconds_between(F.col("best_time"), F.col("cutoff")))
    fields, results = ["event", "player", "best_book", "decimal", "books", "p", "age"], ["won", "profit", "clv"]
    view = schema.closed(schema.feature_matrix(w, fields, forbidden=results), w.select(*fields).schema)
    refused = 0
    for f in results:
        try:
            schema.feature_matrix(w, [*fields, f], forbidden=results)
        except ValueError:
            refused += 1
    return view.select("event", "player", "best_book", r6("decimal"), "books", r6("p"), r6("age"), F.lit(refused).cast("long").alias("refused_fields"))
