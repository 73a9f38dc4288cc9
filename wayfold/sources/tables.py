"""Catalog tables: scan, replace, cluster, publish."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, schema: str | None, table: str) -> DataFrame:
    """Read a catalog table whose schema name is a parameter."""
    return spark.table(f"{schema}.{table}" if schema else table)


def replace_table_as(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Create or replace a table from a query and return the stored table."""
    writer = df.write.mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def write_clustered(
    df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None, spread: int = 1
) -> DataFrame:
    """Store a table bucketed and sorted on its key, so joins on the key need no shuffle.

    Each bucket is at most ``spread`` files: rows go to the task of their bucket, which is the key's
    hash as the writer computes it, and of one of ``spread`` salts. More than one lets several tasks write
    the bucket of a very large key.
    """
    bucket = F.pmod(F.hash(*keys), F.lit(buckets))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(spread)).cast("int")
    writer = df.repartitionById(buckets * spread, bucket * spread + salt).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def publish_copy(spark: SparkSession, source: str, target: str, path: str | None = None) -> DataFrame:
    """Copy a work table to its published name."""
    return replace_table_as(spark.table(source), target, path)
