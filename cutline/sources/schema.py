"""Declared schemas and the guards that keep a model to what it may read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A snapshot of quotes: books, their markets, and the outcomes of each.
_OUTCOME = T.StructType().add("name", "string").add("description", "string").add("point", "double").add("price", "integer")
_MARKET = T.StructType().add("key", "string").add("last_update", "timestamp").add("outcomes", T.ArrayType(_OUTCOME))
_BOOK = T.StructType().add("key", "string").add("markets", T.ArrayType(_MARKET))
SNAPSHOT = T.StructType().add("timestamp", "timestamp").add("event", "string").add("bookmakers", T.ArrayType(_BOOK))


def require_columns(df: DataFrame, needed: Iterable[str], source: str) -> DataFrame:
    """df, or an error that lists every missing column."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{source} lacks {', '.join(missing)}")
    return df


def unknown_fields(schema: T.DataType, allowed: T.DataType, at: str = "") -> list[str]:
    """Paths that schema has and allowed does not, at any depth."""
    if isinstance(schema, T.ArrayType) and isinstance(allowed, T.ArrayType):
        return unknown_fields(schema.elementType, allowed.elementType, f"{at}[]")
    if not (isinstance(schema, T.StructType) and isinstance(allowed, T.StructType)):
        return []
    known, out = {f.name: f.dataType for f in allowed.fields}, []
    for f in schema.fields:
        path = f"{at}.{f.name}".lstrip(".")
        out += unknown_fields(f.dataType, known[f.name], path) if f.name in known else [path]
    return out


def closed(df: DataFrame, allowed: T.StructType) -> DataFrame:
    """df, or an error that lists the fields beyond the closed schema."""
    extra = unknown_fields(df.schema, allowed)
    if extra:
        raise ValueError(f"fields outside the closed schema: {', '.join(extra)}")
    return df


def feature_matrix(df: DataFrame, fields: list[str], forbidden: Iterable[str] = ()) -> DataFrame:
    """Only the declared fields; an error if one of them bears a result."""
    bad = sorted(set(fields) & set(forbidden))
    if bad:
        raise ValueError(f"result-bearing fields: {', '.join(bad)}")
    return require_columns(df, fields, "feature matrix").select(*fields)


def season_firewall(df: DataFrame, first: int, last: int, season: str = "season") -> DataFrame:
    """df, or an error if a season lies outside; one aggregate over one column."""
    lo, hi = df.agg(F.min(season), F.max(season)).head()
    if lo is not None and (lo < first or hi > last):
        raise ValueError(f"seasons {lo}..{hi} are not within {first}..{last}")
    return df
