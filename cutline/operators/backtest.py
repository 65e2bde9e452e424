"""Settlement and audit of frozen wagers: status, portfolio, equity, streaks, rules, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import odds
from . import scans

EDGE_BINS = [-1.0, -0.05, -0.025, 0.0, 0.025, 0.05, 0.10, 0.20, 1.0]
RULE_EDGES = [0.0, 0.01, 0.025, 0.05, 0.10]
RULE_EVS = [0.0, 0.05, 0.10, 0.20]
RULE_BOOKS = [1, 2, 3]


def wager_status(*, bet: Column, settled: Column, played: Column, inactive: Column, won: Column, action_on_absent: Column) -> Column:
    """Ordered tests: no bet, still open, absent player by the book's rule, result."""
    return (
        F.when(~F.coalesce(bet, F.lit(False)), "not_bet").when(~F.coalesce(settled, F.lit(False)), "pending")
        .when(F.coalesce(inactive, F.lit(False)) & ~F.coalesce(played, F.lit(False)), F.when(F.coalesce(action_on_absent, F.lit(False)), "lost_dnp_action").otherwise("void"))
        .when(played.isNull(), "pending").when(won, "won").otherwise("lost")
    )


def portfolio(df: DataFrame, by: list[str] | None = None, profit: str = "profit", won: str = "won", decimal: str = "decimal", ev: str = "ev", edge: str = "edge", clv: str = "clv") -> DataFrame:
    """bets, wins, net units, return, mean odds, EV and edge, and how often a closing price exists.

    Rows with a null profit are ungraded and left out.
    """
    return df.where(F.col(profit).isNotNull()).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("bets"), F.count_if(F.col(won)).alias("wins"), F.sum(profit).alias("net"), F.avg(profit).alias("roi"), F.avg(decimal).alias("mean_decimal"),
        F.avg(ev).alias("mean_ev"), F.avg(edge).alias("mean_edge"), F.avg(clv).alias("mean_clv"), F.avg(F.col(clv).isNotNull().cast("double")).alias("clv_coverage"),
    )


def drawdown(df: DataFrame, by: list[str], order: list[str], profit: str = "profit", parts: int | None = None) -> DataFrame:
    """Final equity, its peak and the greatest fall from a peak; the start counts as 0.

    parts: how many ranges the rows are dealt to, so that a long group is many tasks.
    """
    if parts:
        return scans.equity(df, by, order, profit, parts)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumn("_e", F.sum(profit).over(w)).withColumn("_p", F.greatest(F.lit(0.0), F.max("_e").over(w)))
    return run.groupBy(*by).agg(F.sum(profit).alias("equity"), F.max("_p").alias("peak"), F.max(F.col("_p") - F.col("_e")).alias("max_drawdown"))


def losing_streak(df: DataFrame, by: list[str], order: list[str], won: str = "won", parts: int | None = None) -> DataFrame:
    """Most losses in a row; parts as in drawdown."""
    if parts:
        return scans.losses(df, by, order, won, parts)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = df.withColumn("_i", F.sum(F.col(won).cast("int")).over(w))
    runs = island.groupBy(*by, "_i").agg(F.count_if(~F.col(won)).alias("n"))
    return runs.groupBy(*by).agg(F.max("n").alias("longest_losing_streak"))


def winner_share(df: DataFrame, by: list[str], profit: str = "profit", tie: list[str] = ()) -> DataFrame:
    """Shares of gross winnings that come from the largest one and two winners."""
    win = df.where(F.col(profit) > 0).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(profit), *tie)))
    gross = F.sum(profit)
    return win.groupBy(*by).agg((F.sum(F.when(F.col("_r") <= 1, F.col(profit))) / gross).alias("top1_share"), (F.sum(F.when(F.col("_r") <= 2, F.col(profit))) / gross).alias("top2_share"))


def rule_grid(df: DataFrame, edges: list[float] = RULE_EDGES, evs: list[float] = RULE_EVS, books: list[int] = RULE_BOOKS) -> DataFrame:
    """One row per rule of the grid: bets, wins and net at best and median price, CLV.

    The grid is a bounded literal.  A row names only the rules that it meets, and no other
    column than those summed goes with it; sums are partial before the shuffle.
    """
    rules = F.array(*(F.struct(F.lit(a).alias("min_edge"), F.lit(b).alias("min_ev"), F.lit(c).alias("min_books")) for a in edges for b in evs for c in books))
    met = F.filter(rules, lambda r: (F.col("edge") >= r["min_edge"]) & (F.col("ev") >= r["min_ev"]) & (F.col("books") >= r["min_books"]))
    needed = ["won", "profit", "profit_median", "clv"]
    rows = df.where(F.col("profit").isNotNull() & (F.col("edge") >= min(edges)) & (F.col("ev") >= min(evs)) & (F.col("books") >= min(books))).select(*needed, F.explode(met).alias("rule"))
    return rows.groupBy("rule.min_edge", "rule.min_ev", "rule.min_books").agg(
        F.count(F.lit(1)).alias("bets"), F.count_if("won").alias("wins"), F.sum("profit").alias("net_best"), F.sum("profit_median").alias("net_median"), F.avg("profit").alias("roi_best"),
        F.avg("profit_median").alias("roi_median"), F.avg("clv").alias("mean_clv"), F.avg(F.col("clv").isNotNull().cast("double")).alias("clv_coverage"), (F.max(F.when(F.col("profit") > 0, F.col("profit"))) / F.sum(F.when(F.col("profit") > 0, F.col("profit")))).alias("top_share"),
    )


def shortlist(grid: DataFrame, min_bets: int = 100, n: int = 5) -> DataFrame:
    """Rules that pass every gate, by return at the median price, then CLV, then bets; of the rest the first of the grid."""
    ok = (F.col("bets") >= min_bets) & (F.col("roi_best") > 0) & (F.col("roi_median") >= 0) & (F.coalesce("mean_clv", F.lit(-1.0)) >= 0) & (F.col("clv_coverage") >= 0.5) & (F.col("top_share") <= 0.5)
    order = Window.orderBy(F.desc("roi_median"), F.desc("mean_clv"), F.desc("bets"), "min_edge", "min_ev", "min_books")
    return grid.where(ok).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def validate_rule(picks: DataFrame, *, segment: Column, stale: Column, longshot: Column, min_bets: int = 100, segments: list[str] = ("early", "middle", "late")) -> DataFrame:
    """One row: how a frozen rule does on later picks, and whether it is promoted.

    Promotion needs enough bets, gains at both prices, CLV and its coverage, two of the
    segments not negative, and no more than half of the net from the two largest winners'
    gross, from stale quotes or from longshots.
    """
    p = picks.where(F.col("profit").isNotNull()).withColumn("_s", segment)
    own = {f"net_{s}": F.coalesce(F.sum(F.when(F.col("_s") == s, F.col("profit"))), F.lit(0.0)) for s in segments}
    gross = F.sum(F.when(F.col("profit") > 0, F.col("profit")))
    one = p.agg(
        F.count(F.lit(1)).alias("bets"), F.sum("profit").alias("net"), F.avg("profit").alias("roi"), F.avg("profit_median").alias("roi_median"), F.avg("clv").alias("mean_clv"), F.avg(F.col("clv").isNotNull().cast("double")).alias("clv_coverage"),
        gross.alias("gross"), F.coalesce(F.sum(F.when(stale, F.col("profit"))), F.lit(0.0)).alias("stale_net"), F.coalesce(F.sum(F.when(longshot, F.col("profit"))), F.lit(0.0)).alias("longshot_net"), *(c.alias(n) for n, c in own.items()),
    )
    # the two largest winners: two rows
    two = p.where("profit > 0").orderBy(F.desc("profit")).limit(2).agg(F.sum("profit").alias("two"))
    fine = F.lit(0)
    for n in own:
        fine = fine + (F.col(n) >= 0).cast("int")
    share = F.col("two") / F.col("gross")
    promoted = (
        (F.col("bets") >= min_bets) & (F.col("roi") > 0) & (F.col("roi_median") > 0) & (F.coalesce("mean_clv", F.lit(-1.0)) >= 0) & (F.col("clv_coverage") >= 0.5)
        & (fine >= 2) & (share <= 0.5) & (F.col("stale_net") <= F.col("net") / 2) & (F.col("longshot_net") <= F.col("net") / 2)
    )
    out = one.crossJoin(F.broadcast(two))  # one row each
    return out.select("bets", "net", "roi", "roi_median", "mean_clv", "clv_coverage", share.alias("top_two_share"), "stale_net", "longshot_net", *own, F.coalesce(promoted, F.lit(False)).alias("promoted"))


def stage_a(offers: DataFrame, *, p: str = "p", best: str = "decimal", median: str = "median_decimal", books: str = "books", min_ev: float = 0.05, min_edge: float = 0.025, min_books: int = 3, outlier: float = 0.25) -> DataFrame:
    """offers with ev, edge, bet and flags: what is frozen before any result is known."""
    made = offers.withColumn("ev", odds.expected_value(F.col(p), F.col(best))).withColumn("edge", odds.edge(F.col(p), F.col(best)))
    flags = odds.status_flags({"UNMODELED": F.col(p).isNull(), "FEW_BOOKS": F.col(books) < min_books, "OUTLIER": odds.dispersion(F.col(best), F.col(median)) >= outlier})
    return made.withColumn("bet", F.coalesce((F.col("ev") >= min_ev) & (F.col("edge") >= min_edge), F.lit(False))).withColumn("flags", flags)


def settle(rows: DataFrame, played: DataFrame, counts: DataFrame, closes: DataFrame, keys: list[str], *, p: str = "p", best: str = "decimal", median: str = "median_decimal", book: str = "best_book", close: str = "close_decimal") -> DataFrame:
    """Frozen rows with status, result, profits and closing values; every row stays.

    A row without a model is unmodeled; one whose player is proven to have played is
    graded; of the rest nothing is known.  played has the keys of proven players, counts
    the keys and ``n`` of scores, closes the keys, book and price of each book's last quote.
    """
    seen = played.select(*keys).distinct().withColumn("_played", F.lit(True))
    same = closes.select(*keys, F.col("book").alias(book), F.col(close).alias("closing_same_book"))
    middle = closes.where(F.col(close).isNotNull()).groupBy(*keys).agg(F.median(close).alias("closing_median"))
    out = rows.join(seen, keys, "left").join(counts.select(*keys, F.col("n").alias("_n")), keys, "left").join(same, [*keys, book], "left").join(middle, keys, "left")
    status = F.when(F.col(p).isNull(), "unmodeled").when(F.col("_played"), "graded_played").otherwise("policy_unknown")
    graded = status == "graded_played"
    count = F.when(graded, F.coalesce("_n", F.lit(0)))
    out = out.withColumn("status", status).withColumn("actual", count.cast("long")).withColumn("won", F.col("actual") > 0)
    made = {
        "profit": odds.profit(F.col("won"), F.col(best)), "profit_median": odds.profit(F.col("won"), F.col(median)),
        "clv": odds.closing_line_value(F.col(best), F.col("closing_same_book")), "clv_median": odds.closing_line_value(F.col(median), F.col("closing_median")),
    }
    return out.withColumns(made).drop("_played", "_n")


def price_variants(rows: DataFrame, by: list[str], *, bet: Column, inactive: Column, won: str = "won", best: str = "profit", median: str = "profit_median") -> DataFrame:
    """Net units of the same picks at best and at median price, and of both without who turned out inactive."""
    live = ~F.coalesce(inactive, F.lit(False))
    total = lambda c, ok=None: F.coalesce(F.sum(F.when(ok, F.col(c)) if ok is not None else F.col(c)), F.lit(0.0))
    return rows.where(bet).groupBy(*by).agg(
        F.count(F.lit(1)).alias("bets"), total(best).alias("net_best"), total(median).alias("net_median"), F.count_if(~live).alias("inactive_bets"), total(best, live).alias("void_net_best"), total(median, live).alias("void_net_median"),
    )


def ev_ladder(df: DataFrame, thresholds: list[float] = (0.0, 0.05, 0.10, 0.25), ev: str = "ev", profit: str = "profit") -> DataFrame:
    """Bets, net and return at each threshold of EV; 0 means above 0."""
    met = F.filter(F.array(*(F.lit(float(x)) for x in thresholds)), lambda t: F.when(t == 0, F.col(ev) > 0).otherwise(F.col(ev) >= t))
    rows = df.select(F.col(profit).alias("_p"), F.explode(met).alias("threshold"))
    return rows.groupBy("threshold").agg(F.count(F.lit(1)).alias("bets"), F.sum("_p").alias("net"), F.avg("_p").alias("roi"))


def diagnostics(df: DataFrame, cuts: dict[str, Column], profit: str = "profit") -> DataFrame:
    """cut, value, n, wins, net and roi of every named cut, in one scan by grouping sets."""
    named = df.select(profit, "won", *(c.cast("string").alias(n) for n, c in cuts.items()))
    sets = named.groupingSets([[n] for n in cuts], *cuts).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.count_if("won").alias("wins"), F.sum(profit).alias("net"), F.avg(profit).alias("roi"))
    full = (1 << len(cuts)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, n in enumerate(cuts):
        hit = F.col("_g") == (full ^ (1 << (len(cuts) - 1 - i)))
        name, value = F.when(hit, F.lit(n)).otherwise(name), F.when(hit, F.col(n)).otherwise(value)
    return sets.select(name.alias("cut"), value.alias("value"), "n", "wins", "net", "roi")


def buckets(df: DataFrame, value: str, edges: list[float]) -> Column:
    """Lower end of the (lo, hi] bucket of a value, null outside."""
    out = F.lit(None).cast("double")
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        out = F.when((F.col(value) > lo) & (F.col(value) <= hi), F.lit(lo)).otherwise(out)
    return out


def graded(df: DataFrame, won: str = "won", decimal: str = "decimal", p: str = "p") -> DataFrame:
    """profit, ev and edge of one unit at a decimal price."""
    return df.withColumn("profit", odds.profit(F.col(won), F.col(decimal))).withColumn("ev", odds.expected_value(F.col(p), F.col(decimal))).withColumn("edge", odds.edge(F.col(p), F.col(decimal)))
