"""Sinks that never overwrite, a registry of artifacts, and table fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_once(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Fails if anything is at path already."""
    w = df.write.format(fmt).mode("errorifexists")
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def concat_seasons(parts: list[DataFrame], path: str, season: str) -> None:
    """One dataset of several season files, ragged columns as null, a folder for each season; never overwrites."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    write_once(whole, path, partition_by=[season])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def report_bundle(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """A ranked summary and the rows behind it, side by side."""
    write_once(summary, f"{path}/summary", "csv")
    write_once(rows, f"{path}/rows")


def new_artifacts(registry: DataFrame, incoming: DataFrame, digest: str = "sha256") -> DataFrame:
    """Incoming rows whose digest the registry lacks, one each: insert or ignore."""
    return incoming.dropDuplicates([digest]).join(registry.select(digest), digest, "left_anti")


def payload_digest(column: str = "value"):
    return F.sha2(F.col(column).cast("binary"), 256)


def fingerprint(df: DataFrame) -> DataFrame:
    """rows and an order-insensitive sum of row hashes."""
    h = F.xxhash64(*(F.col(c) for c in sorted(df.columns)))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("digest"))


def portable_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows and an order-insensitive digest that any engine with MD5 can repeat: of integers and strings, nulls apart from empty."""
    text = F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns))
    h = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).alias("digest"))


def verify_fingerprint(df: DataFrame, stored: DataFrame) -> None:
    """An error if df is not what the stored fingerprint was taken of."""
    have, want = fingerprint(df).head(), stored.head()
    if tuple(have) != (want["rows"], want["digest"]):
        raise ValueError("the table differs from its fingerprint")


def latest_common_date(left: DataFrame, right: DataFrame, date: str, time: str | None = None) -> DataFrame:
    """The latest date that both families have, and with time the newest instant of each."""
    out = left.select(date).intersect(right.select(date)).agg(F.max(date).alias("latest_common_date"))
    if time:
        for df, name in ((left, "latest_left"), (right, "latest_right")):
            out = out.join(F.broadcast(df.agg(F.max(time).alias(name))))  # one row each
    return out
