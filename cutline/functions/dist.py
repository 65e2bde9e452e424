"""Count distributions as Column expressions, by recurrences over sequences: Poisson, negative binomial, residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def poisson_at_least_one(mean: Column) -> Column:
    return -F.expm1(-mean)


def poisson_at_least_two(mean: Column) -> Column:
    return F.lit(1.0) - F.exp(-mean) * (mean + 1)


def poisson_masses(mean: Column, upto: int = 3) -> list[Column]:
    """P(0) to P(upto) and the tail above."""
    p, out = F.exp(-mean), []
    for k in range(upto + 1):
        p = p if k == 0 else p * mean / float(k)
        out.append(p)
    tail = F.lit(1.0)
    for q in out:
        tail = tail - q
    return [*out, F.greatest(F.lit(0.0), tail)]


def pmf(mean: Column, alpha: Column, upto: int) -> Column:
    """Array of P(0)..P(upto): negative binomial with variance mean + alpha mean^2; Poisson where alpha is 0."""
    r = F.lit(1.0) / alpha
    q = r / (r + mean)
    start = F.when(alpha <= 0, F.exp(-mean)).otherwise(F.exp(r * F.log(q)))

    def step(acc: Column, k: Column) -> Column:
        last = F.element_at(acc, -1)
        grow = F.when(alpha <= 0, mean / k).otherwise((k - 1 + r) * (F.lit(1.0) - q) / k)
        return F.concat(acc, F.array(last * grow))

    return F.aggregate(F.sequence(F.lit(1), F.lit(upto)), F.array(start), lambda a, k: step(a, k.cast("double")))


def line_chances(mean: Column, alpha: Column, line: Column) -> Column:
    """Struct of over, under and push for a line: negative binomial, Poisson where alpha is 0.

    One fold over the counts up to the line, however high it lies, in logarithms; what is
    beyond counts as over.  A negative line or mean is null.
    """
    r = F.lit(1.0) / alpha
    start = F.when(alpha <= 0, -mean).otherwise(r * F.log(r / (r + mean)))
    odds = F.when(alpha <= 0, mean).otherwise(mean / (r + mean))
    none = F.lit(float("-inf"))
    state = F.struct(start.alias("lp"), F.lit(0.0).alias("under"), F.lit(0.0).alias("push"))

    def step(a: Column, k: Column) -> Column:
        grow = F.when(alpha <= 0, odds / k).otherwise((k - 1 + r) * odds / k)
        lp = F.when(k == 0, a["lp"]).when(mean > 0, a["lp"] + F.log(grow)).otherwise(none)
        p = F.exp(lp)
        return F.struct(lp.alias("lp"), (a["under"] + F.when(k < line, p).otherwise(0.0)).alias("under"), (a["push"] + F.when(k == line, p).otherwise(0.0)).alias("push"))

    counts = F.sequence(F.lit(0).cast("long"), F.floor(line).cast("long"))
    out = F.aggregate(counts, state, lambda a, k: step(a, k.cast("double")), lambda a: F.struct(F.greatest(F.lit(0.0), F.lit(1.0) - a["under"] - a["push"]).alias("over"), a["under"].alias("under"), a["push"].alias("push")))
    return F.when((line >= 0) & (mean >= 0), out)


def over_under_push(masses: Column, line: Column) -> dict[str, Column]:
    """over, under and push for a line within an array of masses P(0), P(1), ...

    The array must reach the line: beyond it the result is null.  For parametric counts
    take line_chances, which needs no array.
    """
    indexed = F.zip_with(masses, F.sequence(F.lit(0), F.size(masses) - 1), lambda p, k: F.struct(p.alias("p"), k.cast("double").alias("k")))
    total = lambda cond: F.aggregate(F.filter(indexed, cond), F.lit(0.0), lambda a, x: a + x["p"])
    reached = line < F.size(masses)
    under, push = F.when(reached, total(lambda x: x["k"] < line)), F.when(reached, total(lambda x: x["k"] == line))
    return {"over": F.greatest(F.lit(0.0), F.lit(1.0) - under - push), "under": under, "push": push}


def residual_histogram(df: DataFrame, y: str, mean: str, width: float = 0.25, most_bins: int = 100_000) -> DataFrame:
    """One row: residuals, an array of (residual, mass) of the occupied bins of a width, every row in its own bin.

    The query fails where more bins than most_bins are occupied; a greater width has fewer.
    """
    r = F.floor((F.col(y) - F.col(mean)) / width) * width
    n = df.where(F.col(y).isNotNull() & F.col(mean).isNotNull()).groupBy(r.alias("r")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    out = n.agg(F.array_sort(F.collect_list(F.struct("r", F.col("n").cast("double").alias("n")))).alias("_h"), total.alias("_t"))
    whole = F.transform("_h", lambda x: F.struct(x["r"].alias("residual"), (x["n"] / F.col("_t")).alias("mass")))
    return out.select(F.when(F.size("_h") > most_bins, F.raise_error(F.lit("more residual bins than most_bins")).cast(out.select(whole.alias("h")).schema["h"].dataType)).otherwise(whole).alias("residuals"))


def residual_chances(residuals: Column, mean: Column, line: Column) -> Column:
    """Struct of over, under and push from a residual histogram: counts are the rounded mean plus residual, never negative."""
    zero = F.struct(F.lit(0.0).alias("over"), F.lit(0.0).alias("under"), F.lit(0.0).alias("push"))

    def step(a: Column, x: Column) -> Column:
        k = F.greatest(F.lit(0.0), F.rint(mean + x["residual"]))
        add = lambda name, hit: (a[name] + F.when(hit, x["mass"]).otherwise(0.0)).alias(name)
        return F.struct(add("over", k > line), add("under", k < line), add("push", k == line))

    return F.when(line >= 0, F.aggregate(residuals, zero, step))


def logit(p: Column, eps: float = 1e-6) -> Column:
    c = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p))
    return F.log(c / (F.lit(1.0) - c))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def smoothed_rate(hits: Column, tries: Column, prior_hits: float = 6.5, prior_tries: float = 10.0) -> Column:
    return (hits + prior_hits) / (tries + prior_tries)


def shrunk_rate(hits: Column, tries: Column, prior: Column, strength: float = 3.0) -> Column:
    return (hits + strength * prior) / (tries + strength)
