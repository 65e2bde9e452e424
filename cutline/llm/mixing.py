"""Temperature mixing of sources, in DataFrame operations.

Shares.  A source's share is its part of all tokens (words).  Weights are the shares to
the power alpha, normalised: alpha 1 keeps the corpus, alpha 0 makes sources equal.

Bisection.  alpha is the largest exponent in [0, 1] whose weights reach the target
entropy (a fraction of the greatest possible, log of the number of sources); where some
source would then be repeated more often than ``max_repeats`` times under the budget,
alpha is raised until it is not.  Both conditions are monotonic in alpha, so each is
bisected, in one expression over the array of shares.  Of more than ``broadcast_sources``
sources no array is made: the same bisection runs on sums over the table of shares, sixteen
sections a pass, and only those sums reach the driver.

Block permutations.  Each source gets weight x budget tokens.  It gives its whole text as
many full times as fit; what remains is filled from a permutation of its blocks: blocks
come in the order of their hash, and documents inside a block in the order of theirs.
Since that order is a hash, a document only compares its own position with its source's
cut, and the corpus is not shuffled: one pass counts tokens by block, a second counts
documents of the one block in which the cut falls, a third writes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


@dataclass(frozen=True)
class MixConfig:
    """budget: tokens to draw, as a multiple of the corpus.  entropy: target over log(sources)."""

    entropy: float = 0.95
    max_repeats: float = 4.0
    budget: float = 1.0
    least_blocks: int = 256
    steps: int = 48
    seed: str = "mix"
    broadcast_sources: int = 100_000


def n_tokens(text: Column) -> Column:
    """Words of a text; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def _order(seed: str, *what: Column) -> Column:
    """A 48-bit position that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *what)), 1, 12), 16, 10).cast("long")


def exponent(shares: Column, budget: float, cfg: MixConfig) -> Column:
    """alpha for an array of positive shares, rounded to six places.

    The driver keeps its hands off: the bisections are folds over a sequence of steps.
    """
    steps = F.sequence(F.lit(1), F.lit(cfg.steps))

    def norm(a: Column) -> Column:
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + F.pow(p, a))

    def entropy(a: Column) -> Column:
        # -sum w log w with w = p^a / z is log z - a * sum(p^a log p) / z
        z = norm(a)
        return F.log(z) - a * F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + F.pow(p, a) * F.log(p)) / z

    def repeats(a: Column) -> Column:
        # the smallest source is repeated most: w / p is largest where p is least
        return F.pow(F.array_min(shares), a - 1.0) / norm(a) * F.lit(budget)

    def bisect(good_low, lo: Column) -> Column:
        """The end of the good part that begins at lo (if good_low) or reaches up to 1."""
        pair = F.struct(lo.alias("lo"), F.lit(1.0).alias("hi"))

        def halve(acc: Column, _: Column) -> Column:
            mid = (acc["lo"] + acc["hi"]) / 2.0
            left = good_low(mid)
            return F.struct(F.when(left, mid).otherwise(acc["lo"]).alias("lo"), F.when(left, acc["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(steps, pair, halve)

    target = F.log(F.size(shares).cast("double")) * F.lit(cfg.entropy)
    flat = F.when(entropy(F.lit(1.0)) >= target, F.lit(1.0)).otherwise(bisect(lambda a: entropy(a) >= target, F.lit(0.0))["lo"])
    # above this exponent no source passes the limit
    tame = F.when(repeats(F.lit(0.0)) <= cfg.max_repeats, F.lit(0.0)).otherwise(bisect(lambda a: repeats(a) > cfg.max_repeats, F.lit(0.0))["hi"])
    return F.when(F.size(shares) < 2, F.lit(1.0)).otherwise(F.round(F.greatest(flat, tame), 6))


def exponent_by_sums(shares: DataFrame, budget: float, cfg: MixConfig) -> float:
    """The same alpha for a table with a positive ``share`` in each row, by sums alone."""
    n, least = shares.agg(F.count(F.lit(1)), F.min("share")).head()
    if n < 2:
        return 1.0
    p = F.col("share")

    def values(points: list[float]) -> list[tuple[float, float]]:
        """Entropy and greatest repetition at each exponent, from one row of sums."""
        row = shares.agg(*(c for a in points for c in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p))))).head()
        pairs = list(zip(row[::2], row[1::2], strict=True))
        return [(math.log(z) - a * s / z, least ** (a - 1) / z * budget) for a, (z, s) in zip(points, pairs, strict=True)]

    def bisect(good_low) -> tuple[float, float]:
        lo, hi = 0.0, 1.0
        for _ in range(cfg.steps // 4):
            points = [lo + (hi - lo) * i / 16 for i in range(1, 16)]
            k = sum(good_low(v) for v in values(points))
            lo, hi = points[k - 1] if k else lo, points[k] if k < 15 else hi
        return lo, hi

    target = math.log(n) * cfg.entropy
    at_0, at_1 = values([0.0, 1.0])
    flat = 1.0 if at_1[0] >= target else bisect(lambda v: v[0] >= target)[0]
    tame = 0.0 if at_0[1] <= cfg.max_repeats else bisect(lambda v: v[1] > cfg.max_repeats)[1]
    return round(max(flat, tame), 6)


def mixture_plan(counted: DataFrame, cfg: MixConfig) -> DataFrame:
    """source, tokens, weight, quota, copies and remainder for each source of (source, tokens).

    Sources without a token get weight 0 and are passed through once.
    """
    some = counted.where("tokens > 0")
    if some.count() > cfg.broadcast_sources:
        n = some.agg(F.sum("tokens")).head()[0]
        shares = some.select((F.col("tokens").cast("double") / F.lit(float(n))).alias("share"))
        alpha = exponent_by_sums(shares, cfg.budget, cfg)
        solved = shares.agg(F.lit(n).cast("long").alias("total"), F.lit(alpha).alias("alpha"), F.sum(F.pow("share", F.lit(alpha))).alias("z"))
        return _quotas(counted, solved, cfg)
    total = some.agg(F.sum("tokens").alias("total"), F.sort_array(F.collect_list("tokens")).alias("all"))
    shares = F.transform("all", lambda t: t.cast("double") / F.col("total").cast("double"))
    solved = total.where("total > 0").withColumn("shares", shares)
    solved = solved.withColumn("alpha", exponent(F.col("shares"), cfg.budget, cfg))
    solved = solved.withColumn("z", F.expr("aggregate(shares, 0D, (acc, p) -> acc + power(p, alpha))")).select("total", "alpha", "z")
    return _quotas(counted, solved, cfg)


def _quotas(counted: DataFrame, solved: DataFrame, cfg: MixConfig) -> DataFrame:
    """Weights, quotas, copies and remainders under the one row of total, alpha and z."""
    plan = counted.join(F.broadcast(solved), how="left")  # one row
    raw = F.pow(F.col("tokens").cast("double") / F.col("total").cast("double"), F.col("alpha")) / F.col("z")
    plan = plan.withColumn("weight", F.when(F.col("tokens") > 0, F.round(raw, 9)).otherwise(F.lit(0.0)))
    quota = F.floor(F.col("weight") * F.lit(cfg.budget) * F.col("total").cast("double") + 0.5).cast("long")
    plan = plan.withColumn("quota", F.when(F.col("tokens") > 0, quota).otherwise(F.lit(0)))
    copies = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(1))
    plan = plan.withColumn("copies", copies.cast("long"))
    left = F.when(F.col("tokens") > 0, F.col("quota") - F.col("copies") * F.col("tokens")).otherwise(F.lit(0))
    return plan.withColumn("remainder", left).select("source", "tokens", "alpha", "weight", "quota", "copies", "remainder")


def mix_sources(
    docs: DataFrame, cfg: MixConfig = MixConfig(), source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", epoch_col: str | None = None
) -> DataFrame:
    """docs in the mixture: a row as often as its source's weight asks, columns as they were.

    epoch_col: an extra column that numbers a row's copies from 0 (the cut permutation
    comes last).  A null source is a source of its own.  Rows with no token follow their
    position.  Rows that share an id share a position, and are taken or left together;
    the remainder is filled up to, never beyond, the position at which it would be passed.
    Texts are counted whole, whatever their length; null, empty and wordless ones have no token.  Columns
    travel as one struct, so none clashes with the operator's own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    src = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))
    # Blocks of a source and documents of a block grow alike, with the root of the table.
    n_blocks = max(cfg.least_blocks, math.isqrt(docs.count()))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    named = F.coalesce(F.col(source_col).cast("string"), F.lit("null"))
    at_doc = _order(cfg.seed + "-doc", ident)
    block_no = F.pmod(_order(cfg.seed + "-deal", ident), F.lit(n_blocks))
    at_block = _order(cfg.seed + "-block", named, block_no.cast("string"))

    narrow = docs.select(src.alias("source"), at_block.alias("at_block"), at_doc.alias("at_doc"), n_tokens(F.col(text_col)).alias("tokens"))
    blocks = scratch.table(narrow.groupBy("source", "at_block").agg(F.sum("tokens").alias("tokens")), "blocks")
    plan = scratch.table(mixture_plan(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), cfg), "plan")
    few = plan.count() <= cfg.broadcast_sources
    small = (lambda d: F.broadcast(d)) if few else (lambda d: d)

    # The block in which a source's remainder ends, and what is left of it there.
    run = Window.partitionBy("source").orderBy("at_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = blocks.join(plan.select("source", "copies", "remainder"), "source").withColumn("upto", F.sum("tokens").over(run))
    cut = reach.where("upto > remainder").groupBy("source").agg(F.min_by(F.struct("at_block", (F.col("remainder") - F.col("upto") + F.col("tokens")).alias("room")), "at_block").alias("c"))
    cut = scratch.table(plan.join(cut, "source", "left").select("source", "copies", F.col("c.at_block").alias("cut_block"), F.col("c.room").alias("room")), "cuts")

    inside = narrow.join(small(cut), "source").where("at_block = cut_block and room > 0").groupBy("source", "room", "at_doc").agg(F.sum("tokens").alias("tokens"))
    run = Window.partitionBy("source").orderBy("at_doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = inside.withColumn("upto", F.sum("tokens").over(run)).where("upto > room").groupBy("source").agg(F.min("at_doc").alias("stop_doc"))
    plan = scratch.table(cut.join(stop, "source", "left").select(F.col("source").alias("_mix_source"), "copies", "cut_block", "room", "stop_doc"), "cuts")
    plan = plan.select("_mix_source", *(F.col(c).alias(f"_mix_{c}") for c in ("copies", "cut_block", "room", "stop_doc")))

    at = F.col("_mix_cut_block")
    # A source whose remainder takes every block has no cut block; then all its rows come once more only if it asks for tokens at all.
    own = F.col("_at_block")
    partial = F.when(at.isNull(), F.lit(False)).when(own < at, F.lit(True)).when(own > at, F.lit(False)).when(F.col("_mix_room") <= 0, F.lit(False)).otherwise(F.coalesce(F.col("_at_doc") < F.col("_mix_stop_doc"), F.lit(True)))
    times = F.col("_mix_copies") + partial.cast("long")
    rows = docs.select(F.struct("*").alias("_row"), src.alias("_src"), at_block.alias("_at_block"), at_doc.alias("_at_doc"))
    out = rows.join(small(plan), F.col("_src") == F.col("_mix_source")).withColumn("_mix_times", times).where("_mix_times > 0")
    out = out.withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_times") - 1)))
    columns = [F.col("_row").getField(c).alias(c) for c in docs.columns if c != epoch_col]
    return out.select(*columns, *([F.col("_mix_epoch").alias(epoch_col)] if epoch_col else []))
