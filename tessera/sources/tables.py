"""Scans of the driver's Parquet tables (SRC1-SRC4).

Parquet scans are lazy: Catalyst prunes columns and pushes filters into
the reader, so callers should select what they need right after the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# Tables whose rows carry long text or vectors: per-row work dominates.
HEAVY_TABLES = ("documents", "pages", "conversations", "benchmark", "embeddings")


SPREAD_BELOW = 16


def read_table(spark: SparkSession, sf_dir: str, name: str, spread_rows: bool | None = None) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread_rows is None:
        spread_rows = name in HEAVY_TABLES
    return spread(df) if spread_rows else df


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan of a handful of partitions (fewer than cores, and
    fewer than ``SPREAD_BELOW``).

    A Parquet file is split by row group; a file with a single row group
    is read by a single task however many splits are planned, and every
    per-row regex / tokenizer / matmul after it would run on one core.  An
    input of more splits is never moved, whatever the number of cores.  Filters and column pruning still reach the
    scan (Catalyst pushes them through a round-robin repartition).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < min(cores, SPREAD_BELOW):
        return df.repartition(cores)
    return df


def read_csv(spark: SparkSession, path: str, schema, columns=None) -> DataFrame:
    """SRC4: header CSV with an explicit schema, quoted multi-line fields."""
    df = (spark.read.schema(schema)
          .option("header", True).option("multiLine", True)
          .option("escape", '"').csv(path))
    return df.select(*columns) if columns else df
