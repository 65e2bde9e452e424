"""Quotes to prices: eligibility, one quote a book, best offer, consensus, packages, scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import odds
from . import joins


def eligible(quotes: DataFrame, cutoffs: DataFrame, keys: list[str], *, times: list[str], cutoff: str = "cutoff", wrapper: str | None = None) -> DataFrame:
    """Quotes of which every clock is at or before the key's cutoff; a missing clock is too late.

    wrapper: the clock of the snapshot that a quote came in.  A snapshot taken after the
    cutoff should not be here at all: it fails the query instead of being left out.
    """
    ok = F.lit(True)
    for t in times:
        ok = ok & F.coalesce(F.col(t) <= F.col(cutoff), F.lit(False))
    if wrapper:
        late = ~F.coalesce(F.col(wrapper) <= F.col(cutoff), F.lit(False))
        ok = F.when(late, F.raise_error(F.concat(F.lit("snapshot after the cutoff of "), F.to_json(F.struct(*keys)))).cast("boolean")).otherwise(ok)
    return quotes.join(cutoffs, keys).where(ok)


def one_per_book(quotes: DataFrame, keys: list[str], book: str = "book", time: str = "quote_time", price: str = "price", tie: str | None = None) -> DataFrame:
    """The newest quote of each book; at equal times the better price."""
    w = Window.partitionBy(*keys, book).orderBy(F.desc(time), F.desc(odds.american_to_decimal(F.col(price))), *([F.col(tie)] if tie else []))
    return quotes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_offer(quotes: DataFrame, keys: list[str], price: str = "price", book: str = "book", time: str = "quote_time") -> DataFrame:
    """The highest price; ties to the first book by name, then the newest quote."""
    d = odds.american_to_decimal(F.col(price))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("decimal"), F.col(book), F.desc(time))
    return quotes.withColumn("decimal", d).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def consensus(quotes: DataFrame, keys: list[str], price: str = "price", book: str = "book", time: str = "quote_time", min_books: int = 3) -> DataFrame:
    """Best and median price, books, and whether there are enough of them; the decimal median drives the maths."""
    d = odds.american_to_decimal(F.col(price))
    out = quotes.withColumn("_d", d).where("_d IS NOT NULL").groupBy(*keys).agg(
        F.max("_d").alias("best_decimal"), F.median("_d").alias("median_decimal"), F.count_distinct(book).cast("long").alias("books"), F.min(time).alias("oldest_quote"),
    )
    return out.withColumn("median_american", odds.decimal_to_american(F.col("median_decimal"))).withColumn("enough_books", F.col("books") >= min_books)


def freshest_package(quotes: DataFrame, keys: list[str], *, first_time: str, second_time: str, priority: Column, tie: str) -> DataFrame:
    """Of packages of two markets: the greatest older time, then newer time, then book priority."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.least(first_time, second_time)), F.desc(F.greatest(first_time, second_time)), priority, tie)
    return quotes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_complete_book(quotes: DataFrame, keys: list[str], side: str, sides: list[str], book: str = "book") -> DataFrame:
    """The first book by name that has all sides."""
    have = quotes.where(F.col(side).isin(sides)).groupBy(*keys, book).agg(F.count_distinct(side).alias("n")).where(F.col("n") == len(sides))
    return have.groupBy(*keys).agg(F.min(book).alias(book))


def fair_consensus(pairs: DataFrame, keys: list[str], over: str = "over", under: str = "under", book: str = "book", min_books: int = 3) -> DataFrame:
    """Margin-free consensus of two-sided prices (decimal): mean fair probability, median hold, best sides."""
    f = odds.two_sided_fair(F.col(over), F.col(under))
    rows = pairs.select(*keys, book, over, under, *(c.alias(n) for n, c in f.items()))
    return rows.groupBy(*keys).agg(
        F.count_distinct(book).cast("long").alias("books"), F.avg("fair_over").alias("fair_over"), F.median("hold").alias("hold"), F.max(over).alias("best_over"), F.max(under).alias("best_under"),
    ).withColumn("enough_books", F.col("books") >= min_books)


def price_scan(quotes: DataFrame, keys: list[str], at: Column, *, min_books: int = 3, stale_minutes: float = 15.0, outlier: float = 0.25, tie: str | None = None) -> DataFrame:
    """Best against median price across books, with gap, age and flags."""
    from ..functions import timing

    c = consensus(one_per_book(quotes, keys, tie=tie), keys, min_books=min_books)
    gap = odds.dispersion(F.col("best_decimal"), F.col("median_decimal"))
    age = timing.age_minutes(F.col("oldest_quote"), at)
    flags = odds.status_flags({"INSUFFICIENT_MARKET": ~F.col("enough_books"), "STALE": age > stale_minutes, "OUTLIER": gap >= outlier})
    return c.select(*keys, "best_decimal", "median_decimal", "books", gap.alias("gap"), flags.alias("flags"))


def pairs_decimal(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Two-sided decimal prices of the same book and line."""
    return joins.pair_sides(quotes.withColumn("_d", odds.american_to_decimal(F.col("price"))).where("_d IS NOT NULL"), keys, "side", "_d")


def line_market(snapshots: DataFrame, players: DataFrame, *, name: str, player_id: str, min_books: int = 1) -> DataFrame:
    """event, resolved_id, line, books, median_over, fair_over: nested quotes flattened, players matched by name, sides paired, books agreed.

    Quotes of names that match no player, or several, are left out; they are in
    joins.resolve's result for whoever asks.
    """
    from ..functions import text
    from ..sources import quotes as src

    flat = src.flatten(snapshots).withColumn("_d", odds.american_to_decimal(F.col("price"))).where("_d IS NOT NULL")
    known = joins.resolve(flat, players, name="player", candidate_name=name, candidate_id=player_id, normalise=text.normalize_name).where("match_status = 'MATCHED'")
    pairs = joins.pair_sides(known, ["event", "resolved_id", "book", "line"], "side", "_d")
    fair = odds.two_sided_fair(F.col("over"), F.col("under"))["fair_over"]
    out = pairs.groupBy("event", "resolved_id", "line").agg(F.count_distinct("book").alias("books"), F.median("over").alias("median_over"), F.avg(fair).alias("fair_over"))
    return out.where(F.col("books") >= min_books)


def prop_scan(consensus: DataFrame, means: DataFrame, keys: list[str], chances: Column, *, oldest: str, at: str, line: str = "line", min_books: int = 3, min_history: int = 4, stale_minutes: float = 15.0, aligned: float = 0.05) -> DataFrame:
    """A two-sided consensus beside a model's chances, with EVs, difference and data-quality flags.

    means has the keys, mean and n_history; chances is the struct of over, under and push
    of mean and line.  The market counts only with enough books.
    """
    out = consensus.join(means, keys, "left").withColumn("_o", chances)
    market = F.when(F.col("books") >= min_books, F.col("fair_over"))
    out = out.withColumns({"p_over": F.col("_o.over"), "p_under": F.col("_o.under"), "p_push": F.col("_o.push"), "market_over": market}).drop("_o")
    out = out.withColumn("difference", F.col("p_over") - F.col("market_over"))
    gap = F.col("difference")
    flags = odds.status_flags({
        "INSUFFICIENT_MARKET": F.col("books") < min_books, "STALE": (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(oldest).cast("timestamp"))) / 60e6 > stale_minutes,
        "LOW_HISTORY": F.coalesce("n_history", F.lit(0)) < min_history, "MARKET_ALIGNED": F.abs(gap) < aligned, "LEANS_OVER": gap >= aligned, "LEANS_UNDER": gap <= -aligned,
    })
    return out.withColumns({"ev_over": odds.expected_value(F.col("p_over"), F.col("best_over")), "ev_under": odds.expected_value(F.col("p_under"), F.col("best_under")), "flags": flags})
