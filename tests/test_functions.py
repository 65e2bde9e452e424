"""Closed-form goldens of the scalar functions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cutline.functions import dist, odds, text, timing


def one(spark, *cols):
    return spark.range(1).select(*cols).head()


@pytest.mark.parametrize("price", [100, 101, 235, 1_250, -101, -175, -430, -2_000])
def test_american_prices_pay_what_they_say(spark, price):
    """A positive price is won on a stake of 100, a negative one has to be staked to win 100; both ways agree."""
    stake, win = (100, price) if price > 0 else (-price, 100)
    d = odds.american_to_decimal(F.lit(price))
    got, back, p = one(spark, d, odds.decimal_to_american(d), odds.implied_probability(d))
    assert got * stake == pytest.approx(stake + win)
    assert back == pytest.approx(price) and p == pytest.approx(stake / (stake + win))


@pytest.mark.parametrize("price", [-99, -1, 1, 7, 99])
def test_prices_between_the_hundreds_are_no_prices(spark, price):
    assert one(spark, odds.american_to_decimal(F.lit(price)))[0] is None
    assert one(spark, odds.american_to_decimal(F.lit(None).cast("int")))[0] is None


@pytest.mark.parametrize(("total", "spread"), [(51.5, -6.5), (38.0, 10.0), (40.0, 40.0), (44.5, 0.5)])
def test_implied_points_add_to_the_total_and_differ_by_the_spread(spark, total, spread):
    home, away = one(spark, *odds.implied_points(F.lit(total), F.lit(spread)))
    assert home + away == pytest.approx(total) and home + spread == pytest.approx(away)
    assert one(spark, *odds.implied_points(F.lit(total), F.lit(total + 1)))[0] is None


@pytest.mark.parametrize(("p", "d", "close"), [(0.31, 3.5, 3.1), (0.62, 1.55, 1.7), (1.0, 1.01, 1.01)])
def test_value_is_the_mean_profit(spark, p, d, close):
    value, line = one(spark, odds.expected_value(F.lit(p), F.lit(d)), odds.closing_line_value(F.lit(d), F.lit(close)))
    assert value == pytest.approx(p * (d - 1) - (1 - p))
    assert line == pytest.approx((d - close) / (d * close))


@pytest.mark.parametrize(("over", "under"), [(1.62, 2.3), (2.05, 1.78), (1.91, 1.91)])
def test_two_sided_fair_keeps_the_ratio_of_the_sides(spark, over, under):
    f = odds.two_sided_fair(F.lit(over), F.lit(under))
    a, b, fair, hold = one(spark, *f.values())
    assert (a * over, b * under) == pytest.approx((1, 1))
    assert fair / (1 - fair) == pytest.approx(under / over) and hold == pytest.approx((over + under) / (over * under) - 1)


def test_status_flags(spark):
    assert one(spark, odds.status_flags({"A": F.lit(False), "B": F.lit(None).cast("boolean")}))[0] == "OK"
    assert one(spark, odds.status_flags({"A": F.lit(True), "B": F.lit(False), "C": F.lit(True)}))[0] == "A|C"


def test_normalize_name(spark):
    rows = spark.createDataFrame([("Jo Dee Sample Sr.",), ("Jo-Dee Sample",), ("V",), (None,)], "n string").select(text.normalize_name(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["jodeesample", "jodeesample", "v", None]


def test_lists(spark):
    got = one(spark, text.list_tail(F.lit("a;b;c;d"), 3), text.list_tail(F.lit(""), 3), text.list_contains(F.lit("a;b"), F.lit("b")))
    assert list(got) == [["b", "c", "d"], [], True]


def test_clocks(spark):
    at = one(spark, timing.local_to_utc(F.lit("2024-09-08"), F.lit("13:00")), timing.local_to_utc(F.lit("2024-12-08"), F.lit("13:00")), timing.local_to_utc(F.lit("x"), F.lit("13:00")))
    assert [at[0].hour, at[1].hour, at[2]] == [17, 18, None]
    zoned = one(spark, timing.parse_zoned(F.lit("2024-09-08T13:00:00+02:00")), timing.parse_zoned(F.lit("2024-09-08T13:00:00")))
    assert zoned[0].hour == 11 and zoned[1] is None
    with pytest.raises(ValueError):
        timing.cutoff(F.current_timestamp(), 0)


def test_poisson_and_negative_binomial_sum_to_one(spark):
    assert one(spark, dist.poisson_at_least_one(F.lit(1.35)))[0] == pytest.approx(sum(math.exp(-1.35) * 1.35**k / math.factorial(k) for k in range(1, 40)))
    assert sum(one(spark, *dist.poisson_masses(F.lit(2.3)))) == pytest.approx(1)
    for alpha in (0.0, 0.9):
        p = one(spark, dist.pmf(F.lit(2.3), F.lit(alpha), 200))[0]
        assert sum(p) == pytest.approx(1, abs=1e-6)
        assert sum(k * x for k, x in enumerate(p)) == pytest.approx(2.3, abs=1e-4)
    o = dist.over_under_push(dist.pmf(F.lit(2.3), F.lit(0.0), 60), F.lit(2.0))
    over, under, push = one(spark, o["over"], o["under"], o["push"])
    assert over + under + push == pytest.approx(1)
    assert push == pytest.approx(math.exp(-2.3) * 2.3**2 / 2)
