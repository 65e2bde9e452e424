"""Names of all queries, with the callable and the SQL oracle of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import q_audit, q_backtest, q_facts, q_lag, q_models, q_more, q_quotes, q_sources, q_stats, q_stream  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lagged features of every order from its customer's earlier ones."""
    return QUERIES["lag_features_lastn"](spark, sf_dir)
