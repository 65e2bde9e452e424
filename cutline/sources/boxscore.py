"""Nested box scores: sides, statistic groups and athletes with label and value arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ATHLETE = T.StructType().add("id", "long").add("stats", T.ArrayType(T.StringType()))
_GROUP = T.StructType().add("name", "string").add("labels", T.ArrayType(T.StringType())).add("athletes", T.ArrayType(_ATHLETE))
_SIDE = T.StructType().add("team", "long").add("statistics", T.ArrayType(_GROUP))
#: A game's document.
BOX_SCORE = T.StructType().add("game", "long").add("players", T.ArrayType(_SIDE))


def flatten(docs: DataFrame, label: str = "TD") -> DataFrame:
    """game, team, player, group, value: what each group says under one label; groups without it say nothing."""
    side = docs.select("game", F.explode("players").alias("s"))
    group = side.select("game", F.col("s.team").alias("team"), F.explode("s.statistics").alias("g"))
    who = group.select("game", "team", F.col("g.name").alias("group"), F.array_position("g.labels", label).alias("at"), F.explode("g.athletes").alias("a"))
    value = F.try_element_at(F.col("a.stats"), F.col("at").cast("int")).try_cast("double")
    return who.where("at > 0").select("game", "team", F.col("a.id").alias("player"), "group", value.alias("value"))


def outcomes(flat: DataFrame, offence: list[str], defence: list[str], returns: str) -> DataFrame:
    """game, team, player, offensive, special: sums of offence groups; the larger of the defence groups plus returns.

    Defence groups report the same score twice, so they are not added up.
    """
    own = lambda names: F.sum(F.when(F.col("group").isin(names), F.col("value")))
    out = flat.groupBy("game", "team", "player").agg(own(offence).alias("offensive"), *(own([g]).alias(f"_{g}") for g in defence), own([returns]).alias("_returns"))
    zero = F.lit(0.0)
    top = F.greatest(*(F.coalesce(F.col(f"_{g}"), zero) for g in defence)) if len(defence) > 1 else F.coalesce(F.col(f"_{defence[0]}"), zero)
    return out.select("game", "team", "player", F.coalesce("offensive", zero).alias("offensive"), (top + F.coalesce("_returns", zero)).alias("special"))


def scorers(results: DataFrame, rows: DataFrame, keys: list[str], *, name: str, team: str, normalise, strict: bool = False) -> DataFrame:
    """rows with scored (null where nobody of that name is in the results) and team_status.

    results and rows have the keys, a name and a team; results have ``n``.  A name that two
    players of a game share is AMBIGUOUS_SCORER, or with strict an error; one whose team
    differs from the row's is TEAM_MISMATCH and counts nothing.
    """
    r = results.select(*keys, normalise(F.col(name)).alias("_name"), F.col(team).alias("_team"), "n")
    one = r.groupBy(*keys, "_name").agg(F.count(F.lit(1)).alias("_players"), F.first("_team").alias("_team"), F.sum("n").alias("_n"))
    out = rows.withColumn("_name", normalise(F.col(name))).join(one, [*keys, "_name"], "left")
    many = F.col("_players") > 1
    if strict:
        many = F.when(many, F.raise_error(F.lit("ambiguous scorer")).cast("boolean")).otherwise(F.lit(False))
    status = F.when(F.col("_players").isNull(), "UNKNOWN").when(many, "AMBIGUOUS_SCORER").when(~F.col("_team").eqNullSafe(F.col(team)), "TEAM_MISMATCH").otherwise("OK")
    return out.withColumn("team_status", status).withColumn("scored", F.when(F.col("team_status") == "OK", F.col("_n"))).drop("_name", "_players", "_team", "_n")
