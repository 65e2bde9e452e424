"""Price arithmetic as Column expressions.  Invalid prices are null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def american_to_decimal(price: Column) -> Column:
    """+150 is 2.5, -200 is 1.5; anything strictly between -100 and 100 is invalid."""
    p = price.cast("double")
    return F.when(p >= 100, 1 + p / 100).when(p <= -100, 1 - 100 / p)


def decimal_to_american(d: Column) -> Column:
    return F.when(d >= 2, (d - 1) * 100).when(d > 1, F.lit(-100.0) / (d - 1))


def implied_probability(d: Column) -> Column:
    return F.when(d > 1, F.lit(1.0) / d)


def two_sided_fair(over: Column, under: Column) -> dict[str, Column]:
    """Raw and margin-free probabilities of a two-sided decimal price, and the hold."""
    a, b = implied_probability(over), implied_probability(under)
    return {"raw_over": a, "raw_under": b, "fair_over": a / (a + b), "hold": a + b - 1}


def implied_points(total: Column, home_spread: Column) -> tuple[Column, Column]:
    """Expected (home, away) points; null where either would be negative."""
    home, away = (total - home_spread) / 2, (total + home_spread) / 2
    fine = (home >= 0) & (away >= 0)
    return F.when(fine, home), F.when(fine, away)


def expected_value(p: Column, d: Column) -> Column:
    return p * d - 1


def edge(p: Column, d: Column) -> Column:
    return p - implied_probability(d)


def closing_line_value(entry: Column, close: Column) -> Column:
    return implied_probability(close) - implied_probability(entry)


def dispersion(best: Column, median: Column) -> Column:
    return best / median - 1


def status_flags(flags: dict[str, Column], none: str = "OK") -> Column:
    """Names of the true conditions in order, joined by a pipe; a null condition is false."""
    named = F.array(*(F.when(c, F.lit(n)) for n, c in flags.items()))
    text = F.array_join(F.filter(named, lambda x: x.isNotNull()), "|")
    return F.when(text == "", F.lit(none)).otherwise(text)


def profit(won: Column, d: Column) -> Column:
    """Units won or lost by one unit at a decimal price; null if ungraded."""
    return F.when(won.isNull() | d.isNull(), F.lit(None).cast("double")).when(won, d - 1).otherwise(F.lit(-1.0))
