"""Quotes, prices and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist, odds, text, timing
from ..operators import joins, lag, prices, profiles
from ..sources import quotes as src
from ..sources import sinks
from . import views as v
from .registry import big, query, r6
from .views import dec

KEYS = ["event", "player"]


@query(v.sql("SELECT event::VARCHAR AS event, book, player, side, line, price::BIGINT price, quote_time, snapshot_time FROM v_quotes"))
def quote_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Quotes nested into snapshot documents by book and market, then flattened again."""
    q = v.quotes(spark, d)
    o = q.groupBy("snapshot_time", "event", "book", "quote_time").agg(F.collect_list(F.struct(F.col("side").alias("name"), F.col("player").cast("string").alias("description"), F.col("line").alias("point"), "price")).alias("outcomes"))
    m = o.groupBy("snapshot_time", "event", "book").agg(F.collect_list(F.struct(F.lit("prop").alias("key"), F.col("quote_time").alias("last_update"), "outcomes")).alias("markets"))
    s = m.groupBy("snapshot_time", "event").agg(F.collect_list(F.struct(F.col("book").alias("key"), "markets")).alias("bookmakers"))
    flat = src.flatten(s.select(F.col("snapshot_time").alias("timestamp"), F.col("event").cast("string").alias("event"), "bookmakers"))
    return flat.select("event", "book", F.col("player").cast("long").alias("player"), "side", "line", big("price"), "quote_time", "snapshot_time")


@query(v.sql("SELECT event, player, book, event_id, quote_time FROM v_eligible"))
def quote_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return v.eligible_quotes(spark, d).select("event", "player", "book", "event_id", "quote_time")


@query(v.sql("SELECT count(*) FILTER (quote_time > cutoff) late_quotes, count(*) FILTER (snapshot_time > cutoff) late_snapshots, count(*) n FROM v_quotes JOIN v_cutoff USING (event)"))
def late_quote_audit(spark: SparkSession, d: str) -> DataFrame:
    q = v.quotes(spark, d).join(v.cutoffs(spark, d), "event")
    return q.agg(F.count_if(F.col("quote_time") > F.col("cutoff")).alias("late_quotes"), F.count_if(F.col("snapshot_time") > F.col("cutoff")).alias("late_snapshots"), F.count(F.lit(1)).alias("n"))


@query(v.sql("SELECT event_id, coalesce(snapshot_time <= cutoff, false) in_time, round(date_diff('microsecond', quote_time, cutoff) / 1e6, 6) age_seconds FROM v_quotes JOIN v_cutoff USING (event)"))
def issue_gate_and_age(spark: SparkSession, d: str) -> DataFrame:
    q = v.quotes(spark, d).join(v.cutoffs(spark, d), "event")
    return q.select("event_id", timing.issued_in_time(F.col("snapshot_time"), F.col("cutoff")).alias("in_time"), r6(timing.seconds_between(F.col("quote_time"), F.col("cutoff")), "age_seconds"))


@query(v.sql("SELECT event, player, book, event_id, price::BIGINT price FROM v_per_book"))
def quote_one_per_book(spark: SparkSession, d: str) -> DataFrame:
    return prices.one_per_book(v.eligible_quotes(spark, d), KEYS, tie="event_id").select("event", "player", "book", "event_id", big("price"))


@query(v.sql("""SELECT event, player, book, round("decimal", 6) "decimal" FROM v_per_book QUALIFY row_number() OVER (PARTITION BY event, player ORDER BY "decimal" DESC, book, quote_time DESC) = 1"""))
def best_offer(spark: SparkSession, d: str) -> DataFrame:
    q = prices.one_per_book(v.eligible_quotes(spark, d), KEYS, tie="event_id")
    return prices.best_offer(q, KEYS).select("event", "player", "book", r6("decimal"))


_PACKAGE = """SELECT event, player, book, max(quote_time) FILTER (side = 'Over') t1, max(quote_time) FILTER (side = 'Under') t2 FROM v_eligible GROUP BY 1, 2, 3"""


@query(v.sql("""SELECT event, player, book, least(t1, t2) older FROM p WHERE t1 IS NOT NULL AND t2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event, player ORDER BY least(t1, t2) DESC, greatest(t1, t2) DESC,
    CASE book WHEN 'b2' THEN 0 WHEN 'b0' THEN 1 ELSE 2 END, book) = 1""", ("p", _PACKAGE)))
def freshest_package(spark: SparkSession, d: str) -> DataFrame:
    """Of the books with both sides, the one whose package is freshest."""
    p = v.eligible_quotes(spark, d).groupBy(*KEYS, "book").agg(*(F.max(F.when(F.col("side") == s, F.col("quote_time"))).alias(t) for s, t in (("Over", "t1"), ("Under", "t2")))).where("t1 IS NOT NULL AND t2 IS NOT NULL")
    rank = F.when(F.col("book") == "b2", 0).when(F.col("book") == "b0", 1).otherwise(2)
    out = prices.freshest_package(p, KEYS, first_time="t1", second_time="t2", priority=rank, tie="book")
    return out.select("event", "player", "book", F.least("t1", "t2").alias("older"))


@query(v.sql("SELECT event, player, min(book) book FROM (SELECT event, player, book FROM v_eligible GROUP BY 1, 2, 3 HAVING count(DISTINCT side) = 2) GROUP BY 1, 2"))
def first_complete_book(spark: SparkSession, d: str) -> DataFrame:
    return prices.first_complete_book(v.eligible_quotes(spark, d), KEYS, "side", ["Over", "Under"])


_PAIRS = f"""SELECT event, player, book, line, max(d) FILTER (side = 'Over') over_, max(d) FILTER (side = 'Under') under_ FROM (SELECT *, {dec("price")} d FROM v_eligible) GROUP BY 1, 2, 3, 4 HAVING over_ IS NOT NULL AND under_ IS NOT NULL"""


@query(v.sql("SELECT event, player, book, line, round(over_, 6) over_price, round(under_, 6) under_price FROM p", ("p", _PAIRS)))
def pair_sides(spark: SparkSession, d: str) -> DataFrame:
    return prices.pairs_decimal(v.eligible_quotes(spark, d), [*KEYS, "book", "line"]).select(*KEYS, "book", "line", r6("over", "over_price"), r6("under", "under_price"))


@query(v.sql("""SELECT event, player, line, count(DISTINCT book) books, round(avg((1 / over_) / (1 / over_ + 1 / under_)), 6) fair_over, round(median(1 / over_ + 1 / under_ - 1), 6) hold, round(max(over_), 6) best_over, round(max(under_), 6) best_under,
    count(DISTINCT book) >= 3 enough_books FROM p GROUP BY 1, 2, 3""", ("p", _PAIRS)))
def devig_consensus(spark: SparkSession, d: str) -> DataFrame:
    pairs = prices.pairs_decimal(v.eligible_quotes(spark, d), [*KEYS, "book", "line"])
    out = prices.fair_consensus(pairs, [*KEYS, "line"])
    return out.select(*KEYS, "line", "books", r6("fair_over"), r6("hold"), r6("best_over"), r6("best_under"), "enough_books")


_SCAN = """SELECT event, player, max("decimal") best, median("decimal") med, count(DISTINCT book) books, min(quote_time) oldest, max(cutoff) cutoff FROM v_per_book GROUP BY 1, 2"""


@query(v.sql("""SELECT event, player, round(best, 6) best_decimal, round(med, 6) median_decimal, books, round(best / med - 1, 6) gap, coalesce(nullif(concat_ws('|', CASE WHEN books < 3 THEN 'INSUFFICIENT_MARKET' END,
    CASE WHEN date_diff('microsecond', oldest, cutoff) / 60e6 > 15 THEN 'STALE' END, CASE WHEN best / med - 1 >= 0.25 THEN 'OUTLIER' END), ''), 'OK') flags FROM s""", ("s", _SCAN)))
def cross_book_scan(spark: SparkSession, d: str) -> DataFrame:
    """Best against median price by player, ranked by gap at the sink."""
    q = v.eligible_quotes(spark, d)
    out = prices.price_scan(q, [*KEYS, "cutoff"], F.col("cutoff"), tie="event_id")
    return out.select("event", "player", r6("best_decimal"), r6("median_decimal"), "books", r6("gap"), "flags")


#: Each player's history as it was frozen when a week began.
_FROZEN = """SELECT event, player, sum(x * pow(0.5::DOUBLE, r / 3.0::DOUBLE)) / sum(pow(0.5::DOUBLE, r / 3.0::DOUBLE)) m, count(*) n_history FROM (SELECT c.event, q.player, ln(1 + abs(price)) x, row_number() OVER (PARTITION BY c.event, q.player ORDER BY quote_time DESC, event_id DESC) - 1 r
    FROM v_quotes q JOIN v_cutoff c ON q.quote_time < c.event::TIMESTAMP) GROUP BY 1, 2"""
_LINES = """SELECT event, player, line, count(DISTINCT book) books, avg((1 / over_) / (1 / over_ + 1 / under_)) fair, max(over_) best_over, max(under_) best_under FROM p GROUP BY 1, 2, 3"""


@query(v.sql("""SELECT *, coalesce(nullif(concat_ws('|', CASE WHEN books < 3 THEN 'INSUFFICIENT_MARKET' END, CASE WHEN age > 15 THEN 'STALE' END, CASE WHEN n_history < 4 THEN 'LOW_HISTORY' END, CASE WHEN abs(difference) < 0.05 THEN 'MARKET_ALIGNED' END, CASE WHEN difference >= 0.05 THEN 'LEANS_OVER' END, CASE WHEN difference <= -0.05 THEN 'LEANS_UNDER' END), ''), 'OK') flags FROM
    (SELECT c.event, c.player, c.line, books, coalesce(n_history, 0)::BIGINT n_history, round(m, 6) model_mean, round(1 - u, 6) p_over, round((1 - u) * best_over - 1, 6) ev_over, round(u * best_under - 1, 6) ev_under, round(CASE WHEN books >= 3 THEN 1 - u - fair END, 6) difference, round(date_diff('microsecond', oldest, cutoff) / 60e6, 6) age
    FROM c JOIN (SELECT event, player, line, min(quote_time) oldest FROM v_eligible GROUP BY 1, 2, 3) o USING (event, player, line) JOIN v_cutoff USING (event) LEFT JOIN f USING (event, player) LEFT JOIN LATERAL (SELECT sum(exp(k * ln(m) - m - lgamma(k + 1))) u FROM range(0, 6) t(k) WHERE k < line) z ON true)""", ("p", _PAIRS), ("c", _LINES), ("f", _FROZEN)))
def prop_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two-sided consensus against a count model of each player's history as it was frozen before the week."""
    q = v.eligible_quotes(spark, d)
    pairs = prices.fair_consensus(prices.pairs_decimal(q, [*KEYS, "book", "line"]), [*KEYS, "line"])
    oldest = q.groupBy(*KEYS, "line").agg(F.min("quote_time").alias("oldest"), F.max("cutoff").alias("cutoff"))
    past = v.quotes(spark, d).select("player", F.log1p(F.abs("price")).alias("x"), "quote_time", "event_id")
    targets = pairs.select(*KEYS).distinct().withColumn("begins", F.col("event").cast("timestamp_ntz"))
    means = lag.prefix_features(past, targets, ["player"], time="quote_time", available_at="quote_time", cutoff="begins", row_id="event_id", metrics=["x"], windows={}, null_policy="skip")
    means = means.select(*KEYS, F.col("ewma_x").alias("mean"), "n_history")
    out = prices.prop_scan(pairs.join(oldest, [*KEYS, "line"]), means, KEYS, dist.line_chances(F.col("mean"), F.lit(0.0), F.col("line")), oldest="oldest", at="cutoff")
    age = timing.seconds_between(F.col("oldest"), F.col("cutoff")) / 60
    return out.select(*KEYS, "line", "books", big(F.coalesce("n_history", F.lit(0)), "n_history"), r6("mean", "model_mean"), r6("p_over"), r6("ev_over"), r6("ev_under"), r6("difference"), r6(age, "age"), "flags")


@query(v.sql("""SELECT event, book, side, count(*) quotes, count(DISTINCT player) players, round(median("decimal"), 6) median_decimal FROM v_per_book GROUP BY 1, 2, 3"""))
def market_by_key(spark: SparkSession, d: str) -> DataFrame:
    q = prices.one_per_book(v.eligible_quotes(spark, d), KEYS, tie="event_id").withColumn("d", odds.american_to_decimal(F.col("price")))
    return q.groupBy("event", "book", "side").agg(F.count(F.lit(1)).alias("quotes"), F.count_distinct("player").alias("players"), r6(F.median("d"), "median_decimal"))


@query(v.sql(f"""SELECT event_id, round(d, 6) "decimal", round(CASE WHEN d >= 2 THEN (d - 1) * 100 WHEN d > 1 THEN -100.0::DOUBLE / (d - 1) END, 6) american, round(1 / d, 6) implied FROM (SELECT event_id, {dec("price")} d FROM v_quotes)"""))
def odds_conversions(spark: SparkSession, d: str) -> DataFrame:
    q = v.quotes(spark, d).withColumn("d", odds.american_to_decimal(F.col("price")))
    return q.select("event_id", r6("d", "decimal"), r6(odds.decimal_to_american(F.col("d")), "american"), r6(odds.implied_probability(F.col("d")), "implied"))


@query(v.sql("""SELECT event_id, CASE WHEN (t - s) / 2 >= 0 AND (t + s) / 2 >= 0 THEN round((t - s) / 2, 6) END home_points, CASE WHEN (t - s) / 2 >= 0 AND (t + s) / 2 >= 0 THEN round((t + s) / 2, 6) END away_points
    FROM (SELECT event_id, 30 + ln(1 + "value") t, (event_id % 81) - 40.5::DOUBLE s FROM events)"""))
def implied_points(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events")
    home, away = odds.implied_points(F.lit(30.0) + F.log1p("value"), (F.col("event_id") % 81) - 40.5)
    return e.select("event_id", r6(home, "home_points"), r6(away, "away_points"))


_STATE = """SELECT user_id, ts, event_type, event_id FROM events WHERE event_type IN ('view', 'signup')"""


@query(v.sql("""SELECT e.event_id, coalesce(x.event_type, 'Unknown') last_type FROM events e LEFT JOIN LATERAL (SELECT event_type FROM s WHERE s.user_id = e.user_id AND s.ts < e.ts ORDER BY s.ts DESC, s.event_id DESC LIMIT 1) x ON true WHERE e.event_type = 'purchase'""", ("s", _STATE)))
def asof_strict(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type IN ('view', 'signup')").select("user_id", F.col("ts").alias("at"), F.col("event_type").alias("last_type"), F.col("event_id").alias("rid"))
    out = joins.asof_join(left, right, ["user_id"], left_time="ts", right_time="at", values=["last_type"], strict=True, order=["rid"], chunk=7 * 86_400)
    return out.select("event_id", F.coalesce("last_type", F.lit("Unknown")).alias("last_type"))


@query(v.sql("""SELECT c.event, p.player, x.event_id::DOUBLE event_id, x.price::DOUBLE price FROM v_cutoff c JOIN (SELECT DISTINCT event, player FROM v_quotes) p ON p.event = c.event LEFT JOIN LATERAL (SELECT event_id, price FROM v_quotes q WHERE q.player = p.player AND q.quote_time <= c.cutoff ORDER BY quote_time DESC, event_id DESC LIMIT 1) x ON true"""))
def asof_inclusive(spark: SparkSession, d: str) -> DataFrame:
    """The latest quote of each week's players at its cutoff, whatever week it is from."""
    q = v.quotes(spark, d)
    left = q.select("event", "player").distinct().join(v.cutoffs(spark, d).select("event", "cutoff"), "event")
    right = q.select("player", "quote_time", "event_id", "price")
    out = joins.asof_join(left, right, ["player"], left_time="cutoff", right_time="quote_time", values=["event_id", "price"], order=["event_id"], chunk=7 * 86_400)
    return out.select("event", "player", F.col("event_id").cast("double").alias("event_id"), F.col("price").cast("double").alias("price"))


@query(v.sql("""SELECT a.event_id, b.event_id other_id, count(*) OVER (PARTITION BY a.event_id) n_matches FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'click' AND abs(date_diff('microsecond', a.ts, b.ts)) <= 3600000000"""))
def band_join(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events")
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = e.where("event_type = 'click'").select(F.col("event_id").alias("other_id"), F.col("user_id").alias("u"), F.col("ts").alias("at"))
    return joins.band_join(a, b, [("user_id", "u")], left_time="ts", right_time="at", seconds=3600, left_id="event_id").select("event_id", "other_id", "n_matches")


@query(v.sql("SELECT g.game_id, h.game_id other_id FROM v_game g JOIN v_game h ON g.kickoff = h.kickoff AND g.grp = h.opp AND g.opp = h.grp WHERE g.game_id < h.game_id"))
def exact_event_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Events with the same instant and the same two sides, by equality on all three."""
    g = v.games(spark, d).select("game_id", "kickoff", "grp", "opp")
    h = g.select(F.col("game_id").alias("other_id"), F.col("kickoff").alias("k2"), F.col("grp").alias("g2"), F.col("opp").alias("o2"))
    return g.join(h, (F.col("kickoff") == F.col("k2")) & (F.col("grp") == F.col("o2")) & (F.col("opp") == F.col("g2")) & (F.col("game_id") < F.col("other_id"))).select("game_id", "other_id")


@query(v.sql("SELECT o_custkey entity, count(*) n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1"))
def coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    o, l = v.table(spark, d, "orders").select("o_orderkey", "o_custkey"), v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.coverage_gap(o, l, ["o_orderkey"]).groupBy(F.col("o_custkey").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


@query(v.sql("SELECT o_orderkey game_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.09 AND l_quantity > 45)"))
def semi_members(spark: SparkSession, d: str) -> DataFrame:
    l = v.table(spark, d, "lineitem").where("l_discount >= 0.09 AND l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.members(v.table(spark, d, "orders").select("o_orderkey"), l, ["o_orderkey"]).select(F.col("o_orderkey").alias("game_id"))


_NAMES = """SELECT s_suppkey, s_name, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') k, s_nationkey FROM supplier"""


@query(v.sql("""SELECT c_custkey, CASE WHEN n = 1 THEN id END::DOUBLE resolved_id, CASE WHEN n = 1 THEN 'MATCHED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END match_status FROM (SELECT c_custkey, replace(c_name, 'Customer', 'Supplier') nm, c_nationkey FROM customer) c
    LEFT JOIN (SELECT k, count(DISTINCT s_suppkey) n, min(s_suppkey) id FROM s GROUP BY 1) x ON regexp_replace(lower(nm), '[^a-z0-9]', '', 'g') = k""", ("s", _NAMES)))
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Customers matched to suppliers by normalised name."""
    c = v.table(spark, d, "customer").select("c_custkey", F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("nm"))
    s = v.table(spark, d, "supplier")
    return joins.resolve(c, s, name="nm", candidate_name="s_name", candidate_id="s_suppkey", normalise=text.normalize_name).select("c_custkey", F.col("resolved_id").cast("double").alias("resolved_id"), "match_status")


@query(v.sql("SELECT p_name, count(DISTINCT p_brand) n_values FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1"))
def ambiguous_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Names that stand for more than one brand go to a quarantine table."""
    return joins.conflicts(v.table(spark, d, "part"), ["p_name"], "p_brand")


@query(v.sql("SELECT l_partkey, min(l_suppkey) l_suppkey FROM lineitem WHERE l_quantity > 49 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1"))
def unique_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    return joins.unique_crosswalk(v.table(spark, d, "lineitem").where("l_quantity > 49"), "l_partkey", "l_suppkey")


@query(v.sql("""SELECT c_custkey, coalesce(covered, false) AND coalesce(act, false) AND NOT coalesce(ina, false) available FROM customer LEFT JOIN (SELECT n_nationkey, n_regionkey <> 2 covered FROM nation) ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT user_id, bool_or(event_type IN ('view', 'click')) act, bool_or(event_type = 'error' AND "value" > 200) ina FROM events GROUP BY 1) ON user_id = c_custkey"""))
def availability_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Complete coverage, positive evidence, and no inactive record, which wins."""
    covered = v.table(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") != 2).alias("full"))
    e, kind = v.table(spark, d, "events"), F.col("event_type")
    out = profiles.availability(v.table(spark, d, "customer"), "c_custkey", "c_nationkey", covered, "n_nationkey", "full", e, "user_id", kind.isin("view", "click"), (kind == "error") & (F.col("value") > 200))
    return out.select("c_custkey", "available")


@query(v.sql("""SELECT max(a) latest_common_date, (SELECT max(ts) FROM events WHERE event_type = 'purchase') latest_left, (SELECT max(ts) FROM events WHERE event_type = 'error' AND "value" > 100) latest_right FROM (SELECT DISTINCT ts::DATE a FROM events WHERE event_type = 'purchase' INTERSECT SELECT DISTINCT ts::DATE FROM events WHERE event_type = 'error' AND "value" > 100)"""))
def latest_common_date(spark: SparkSession, d: str) -> DataFrame:
    """The latest day of both families, and the newest instant of each."""
    e = v.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return sinks.latest_common_date(e.where("event_type = 'purchase'"), e.where("event_type = 'error' AND value > 100"), "day", time="ts")


@query(v.sql("""SELECT day, min(cutoff) first_cutoff FROM (SELECT ((kickoff AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE AS day, kickoff - INTERVAL 60 MINUTE cutoff FROM v_game WHERE ((kickoff AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE BETWEEN '1996-01-01' AND '1997-12-31') GROUP BY 1"""))
def earliest_cutoff_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Earliest cutoff of each local day in a local-date range; instants are read as UTC."""
    g = v.games(spark, d)
    inst = F.col("kickoff").cast("timestamp")
    return g.where(timing.in_local_dates(inst, "1996-01-01", "1997-12-31")).groupBy(timing.local_date(inst).alias("day")).agg(F.min("prediction_time").alias("first_cutoff"))


@query(v.sql("""SELECT n_nationkey::BIGINT n_nationkey, CASE WHEN n_regionkey % 2 = 0 THEN n_nationkey - 12 ELSE 12 - n_nationkey END::BIGINT spread, CASE n_name WHEN 'NATION_3' THEN 'NATION_03' WHEN 'NATION_7' THEN 'NATION_07' ELSE n_name END code, split_part(n_name, '_', 2)::BIGINT key_part FROM nation"""))
def canonical_codes(spark: SparkSession, d: str) -> DataFrame:
    n = v.table(spark, d, "nation")
    return n.select(
        big("n_nationkey"), big(src.canonical_spread(F.col("n_nationkey") - 12, F.col("n_regionkey") % 2 == 0), "spread"),
        src.current_code(F.col("n_name"), {"NATION_3": "NATION_03", "NATION_7": "NATION_07"}).alias("code"), F.split("n_name", "_")[1].cast("long").alias("key_part"),
    )


@query(v.sql("""SELECT n_name, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'x' END k, CASE WHEN n_nationkey % 2 = 0 THEN 'suffix_alias' ELSE 'none' END "method" FROM nation"""))
def name_matching(spark: SparkSession, d: str) -> DataFrame:
    n = v.table(spark, d, "nation")
    other = F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, " Jr.").otherwise(" x"))
    return n.select("n_name", text.normalize_name(other).alias("k"), text.match_method(F.col("n_name"), other).alias("method"))
