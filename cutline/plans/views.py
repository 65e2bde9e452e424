"""Domain views over the warehouse tables, once for Spark and once as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timing


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def games(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("o_orderkey").alias("game_id"), F.col("o_custkey").alias("entity"), F.col("c_nationkey").cast("long").alias("grp"),
        ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25).cast("long").alias("opp"), F.col("o_orderdate").alias("kickoff"), F.year("o_orderdate").alias("season"),
        timing.available_at(F.col("o_orderdate")).alias("available_at"), timing.cutoff(F.col("o_orderdate")).alias("prediction_time"),
        F.log1p("o_totalprice").alias("metric"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )


def plays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("actor"), F.col("l_linenumber").alias("line"),
        (F.col("l_quantity").cast("int") * 2 - 1).alias("yardline"), F.when(F.col("l_linenumber") != 7, F.col("l_partkey") % 60).alias("air"),
        F.when(F.col("l_returnflag") == "A", "rushing").when(F.col("l_returnflag") == "R", "receiving").alias("kind"), (F.col("l_discount") >= 0.09).cast("int").alias("td"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1e5).alias("value"), F.when(F.col("l_linestatus") == "F", (F.col("l_partkey") % 4).cast("int")).alias("drive"),
        F.col("l_tax").alias("tax"), F.col("l_linestatus").alias("linestatus"), F.col("l_quantity").alias("quantity"),
    )


def player_games(spark: SparkSession, d: str) -> DataFrame:
    p = plays(spark, d).groupBy("game_id").agg(
        F.count_if(F.col("kind") == "rushing").alias("carries"), F.count_if(F.col("kind") == "receiving").alias("targets"), F.count(F.lit(1)).alias("n_plays"),
        F.sum(F.col("td")).cast("long").alias("tds"), F.sum(F.when(F.col("td") == 1, F.col("value")).otherwise(0.0)).alias("td_value"), F.sum("value").alias("all_value"),
    )
    return games(spark, d).join(p, "game_id", "left")


def quotes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    side = F.when(F.expr("event_id div 4") % 2 == 0, "Over").otherwise("Under")
    sign = F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)
    return e.select(
        F.to_date(F.date_trunc("week", "ts")).alias("event"), F.col("user_id").alias("player"), F.concat(F.lit("b"), F.col("event_id") % 4).alias("book"), side.alias("side"),
        ((F.col("user_id") % 6) + 0.5).cast("double").alias("line"), (sign * (100 + F.floor(F.col("value") * 5).cast("int"))).cast("int").alias("price"), F.col("ts").alias("quote_time"),
        (F.col("ts") + F.expr("INTERVAL 30 SECONDS")).alias("snapshot_time"), "event_id",
    )


def cutoffs(spark: SparkSession, d: str) -> DataFrame:
    week = F.date_trunc("week", "ts")
    k = week + F.expr("INTERVAL 5 DAYS 1 HOUR")
    e = table(spark, d, "events").select(F.to_date(week).alias("event"), k.cast("timestamp_ntz").alias("kickoff")).distinct()
    return e.withColumn("cutoff", timing.cutoff(F.col("kickoff")))


def eligible_quotes(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import prices

    return prices.eligible(quotes(spark, d), cutoffs(spark, d), ["event"], times=["quote_time", "snapshot_time"])


def closes(spark: SparkSession, d: str) -> DataFrame:
    """The last quote of each book at or before kickoff."""
    from ..operators import prices

    q = prices.eligible(quotes(spark, d), cutoffs(spark, d), ["event"], times=["quote_time"], cutoff="kickoff")
    return prices.one_per_book(q, ["event", "player"], tie="event_id").select("event", "player", "book", F.col("price").alias("close_price"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    x = F.log1p("value") / 2 - 2
    return table(spark, d, "events").select(
        "event_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).alias("p"), F.least(F.lit(0.95), F.lit(0.05) + ((F.col("event_id") * 37) % 90) / 100.0).alias("p2"),
        (F.col("event_type") == "purchase").cast("int").alias("y"), (F.col("user_id") % 3).alias("seg"), F.col("user_id").alias("cluster"), "value", F.col("ts").alias("at"),
    )


def wagers(spark: SparkSession, d: str) -> DataFrame:
    """Every eligible best offer with a model probability, settled by the player's next purchases."""
    from ..functions import odds
    from ..operators import prices

    keys = ["event", "player"]
    q = prices.one_per_book(eligible_quotes(spark, d), keys, tie="event_id")
    best = prices.best_offer(q, keys).select(*keys, F.col("book").alias("best_book"), F.col("decimal"), F.col("quote_time").alias("best_time"))
    c = prices.consensus(q, keys).select(*keys, "median_decimal", "books")
    won = table(spark, d, "events").where("event_type = 'purchase'").select(F.to_date(F.date_trunc("week", "ts")).alias("event"), F.col("user_id").alias("player"), F.lit(True).alias("won")).distinct()
    close = closes(spark, d).select(*keys, F.col("book").alias("best_book"), odds.american_to_decimal(F.col("close_price")).alias("close_decimal"))
    w = best.join(c, keys).join(won, keys, "left").join(close, [*keys, "best_book"], "left")
    w = w.withColumn("won", F.coalesce("won", F.lit(False))).withColumn("p", F.lit(0.30) + (F.col("player") * 13 % 40) / 100.0)
    w = w.withColumn("profit", odds.profit(F.col("won"), F.col("decimal"))).withColumn("profit_median", odds.profit(F.col("won"), F.col("median_decimal")))
    return w.withColumn("ev", odds.expected_value(F.col("p"), F.col("decimal"))).withColumn("edge", odds.edge(F.col("p"), F.col("decimal"))).withColumn("clv", odds.closing_line_value(F.col("decimal"), F.col("close_decimal")))


# DuckDB text of the same views; each may use those before it.
_DEC = "CASE WHEN {0} >= 100 THEN 1 + {0} / 100.0::DOUBLE WHEN {0} <= -100 THEN 1 - 100.0::DOUBLE / {0} END"


def dec(col: str) -> str:
    return _DEC.format(col)


VIEWS: dict[str, str] = {
    "v_game": """SELECT o_orderkey game_id, o_custkey entity, c_nationkey::BIGINT grp, ((c_nationkey + 1 + o_orderkey % 24) % 25)::BIGINT opp, o_orderdate kickoff, year(o_orderdate) season,
        o_orderdate + INTERVAL 1 DAY available_at, o_orderdate - INTERVAL 60 MINUTE prediction_time, ln(1 + o_totalprice) metric, o_orderstatus status, o_orderpriority priority
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_plays": """SELECT l_orderkey game_id, l_partkey part, l_suppkey actor, l_linenumber line, l_quantity::INT * 2 - 1 yardline, CASE WHEN l_linenumber <> 7 THEN l_partkey % 60 END air,
        CASE l_returnflag WHEN 'A' THEN 'rushing' WHEN 'R' THEN 'receiving' END kind, (l_discount >= 0.09)::INT td, l_extendedprice * (1 - l_discount) / 1e5 AS "value",
        CASE WHEN l_linestatus = 'F' THEN (l_partkey % 4)::INT END drive, l_tax tax, l_linestatus linestatus, l_quantity quantity FROM lineitem""",
    "v_player_game": """SELECT g.*, p.* EXCLUDE (game_id) FROM v_game g LEFT JOIN (SELECT game_id, count(*) FILTER (kind = 'rushing') carries, count(*) FILTER (kind = 'receiving') targets, count(*) n_plays,
        sum(td)::BIGINT tds, sum(CASE WHEN td = 1 THEN "value" ELSE 0 END) td_value, sum("value") all_value FROM v_plays GROUP BY 1) p USING (game_id)""",
    "v_quotes": """SELECT date_trunc('week', ts)::DATE AS event, user_id player, 'b' || (event_id % 4) book, CASE WHEN (event_id // 4) % 2 = 0 THEN 'Over' ELSE 'Under' END side, ((user_id % 6) + 0.5)::DOUBLE line,
        ((CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) * (100 + floor("value" * 5)::INT))::INT price, ts quote_time, ts + INTERVAL 30 SECOND snapshot_time, event_id FROM events""",
    "v_cutoff": """SELECT *, kickoff - INTERVAL 60 MINUTE cutoff FROM (SELECT DISTINCT date_trunc('week', ts)::DATE AS event, (date_trunc('week', ts) + INTERVAL 5 DAY + INTERVAL 1 HOUR)::TIMESTAMP kickoff FROM events)""",
    "v_eligible": "SELECT q.*, c.kickoff, c.cutoff FROM v_quotes q JOIN v_cutoff c USING (event) WHERE quote_time <= cutoff AND snapshot_time <= cutoff",
    "v_per_book": f"""SELECT * FROM (SELECT *, {dec("price")} "decimal" FROM v_eligible) QUALIFY row_number() OVER (PARTITION BY event, player, book ORDER BY quote_time DESC, "decimal" DESC, event_id) = 1""",
    "v_close": f"""SELECT event, player, book, price close_price FROM (SELECT q.*, {dec("price")} d FROM v_quotes q JOIN v_cutoff c USING (event) WHERE quote_time <= kickoff)
        QUALIFY row_number() OVER (PARTITION BY event, player, book ORDER BY quote_time DESC, d DESC, event_id) = 1""",
    "v_scored": """SELECT event_id, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(ln(1 + "value") / 2 - 2))) p, least(0.95::DOUBLE, 0.05::DOUBLE + ((event_id * 37) % 90) / 100.0::DOUBLE) p2, (event_type = 'purchase')::INT y,
        user_id % 3 seg, user_id "cluster", "value", ts "at" FROM events""",
    "v_wagers": f"""SELECT *, CASE WHEN won THEN "decimal" - 1 ELSE -1.0::DOUBLE END profit, CASE WHEN won THEN median_decimal - 1 ELSE -1.0::DOUBLE END profit_median, p * "decimal" - 1 ev, p - 1 / "decimal" edge, 1 / close_decimal - 1 / "decimal" clv
        FROM (SELECT b.event, b.player, b.book best_book, b."decimal", b.quote_time best_time, c.median_decimal, c.books, coalesce(w.won, false) won, {dec("z.close_price")} close_decimal, 0.30::DOUBLE + (b.player * 13 % 40) / 100.0::DOUBLE p
        FROM (SELECT * FROM v_per_book QUALIFY row_number() OVER (PARTITION BY event, player ORDER BY "decimal" DESC, book, quote_time DESC) = 1) b
        JOIN (SELECT event, player, median("decimal") median_decimal, count(DISTINCT book) books FROM v_per_book GROUP BY 1, 2) c USING (event, player)
        LEFT JOIN (SELECT DISTINCT date_trunc('week', ts)::DATE AS event, user_id player, true won FROM events WHERE event_type = 'purchase') w USING (event, player)
        LEFT JOIN v_close z ON z.event = b.event AND z.player = b.player AND z.book = b.book)""",
}
_NEEDS = {"v_player_game": ["v_game", "v_plays"], "v_eligible": ["v_quotes", "v_cutoff"], "v_per_book": ["v_eligible"], "v_close": ["v_quotes", "v_cutoff"], "v_wagers": ["v_per_book", "v_close"]}


def sql(body: str, *more: tuple[str, str]) -> str:
    """body with the views it names, and further named parts, in front."""
    text = body + " ".join(b for _, b in more)
    need: list[str] = []

    def add(v: str) -> None:
        for n in _NEEDS.get(v, []):
            add(n)
        if v not in need:
            need.append(v)

    for v in VIEWS:
        if v in text:
            add(v)
    parts = [f"{v} AS ({VIEWS[v]})" for v in need] + [f"{n} AS ({b})" for n, b in more]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
