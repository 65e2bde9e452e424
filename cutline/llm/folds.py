"""The fold that models never learn from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text has remainder 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def thinned(key: Column, share: Column) -> Column:
    """Keeps about that share of the keys, by a hash, the same ones every time."""
    return F.pmod(F.xxhash64(key, F.lit("thin")), F.lit(1_000_000)) < share * 1_000_000
