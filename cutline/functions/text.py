"""Name normalisation and delimited lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name suffixes that do not tell people apart (fixed values).
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]


def name_tokens(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_name(name: Column) -> Column:
    """Lower-case tokens without one trailing suffix, joined without a gap."""
    t = name_tokens(name)
    cut = (F.size(t) > 1) & F.element_at(t, -1).isin(SUFFIXES)
    return F.when(name.isNotNull(), F.array_join(F.when(cut, F.slice(t, F.lit(1), F.size(t) - 1)).otherwise(t), ""))


def match_method(left: Column, right: Column) -> Column:
    """exact, suffix alias or none."""
    return F.when(F.lower(left) == F.lower(right), "exact").when(normalize_name(left) == normalize_name(right), "suffix_alias").otherwise("none")


def list_tail(text: Column, n: int, sep: str = ";") -> Column:
    """The last n entries of a delimited list; an empty or null text has none."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), sep), lambda x: x != "")
    return F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), F.lit(n))


def list_contains(text: Column, item: Column, sep: str = ";") -> Column:
    return F.array_contains(F.split(F.coalesce(text, F.lit("")), sep), item)


def event_code(away: Column, home: Column, aliases: dict[str, str] | None = None) -> Column:
    """away@home with each side's alias in place."""
    def code(c: Column) -> Column:
        out = c
        for old, new in (aliases or {}).items():
            out = F.when(c == old, F.lit(new)).otherwise(out)
        return out

    return F.concat(code(away), F.lit("@"), code(home))


def game_key(key: Column) -> Column:
    """Struct of season, week, away and home out of season_week_away_home; null where it has another form."""
    parts = F.split(key, "_")
    fine = key.rlike(r"^\d{4}_\d{1,2}_[^_]+_[^_]+$")
    return F.when(fine, F.struct(parts[0].try_cast("int").alias("season"), parts[1].try_cast("int").alias("week"), parts[2].alias("away"), parts[3].alias("home")))
