"""Sinks (SNK1-SNK8).  Parquet by default; every writer is a plain
DataFrameWriter call so it runs in parallel and commits atomically per job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.webdocs import review_projection

CHUNK_COLUMNS = ("chunk_id", "text")
MAX_MAP = 100_000
REVIEW_COLUMNS = ("chunk_id", "symbol_name", "source", "label", "url", "slug", "website",
                  "original_token_length", "token_length", "text")


def write_chunks(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """SNK1: chunk_id, text -- no index column."""
    w = df.select(*CHUNK_COLUMNS).write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def write_provenance(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK2: every column."""
    df.write.mode(mode).parquet(path)


def write_review(df: DataFrame, path: str, columns: Sequence[str] = REVIEW_COLUMNS,
                 mode: str = "overwrite") -> None:
    """SNK3: the review column list, restricted to columns present."""
    review_projection(df, columns).write.mode(mode).parquet(path)


def write_source_list(sources: DataFrame, path: str, header: Sequence[str] = ()) -> None:
    """SNK4: 'website,slug' lines after '#' header lines, in line order: a
    distributed sort, whose part files follow each other."""
    spark = sources.sparkSession
    head = spark.createDataFrame([(i, f"# {h}") for i, h in enumerate(header)], "k long, value string")
    body = sources.select((F.col("line_num") + len(header)).cast("long").alias("k"),
                          F.concat_ws(",", "website", "slug").alias("value"))
    head.unionByName(body).orderBy("k").select("value").write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    """SNK5: audit logs (page log, failures, filter log) are appended."""
    df.write.mode("append").parquet(path)


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK6: vectors partitioned by (model, variant, source).  Overwriting
    replaces the indexes that ``df`` holds and leaves all others."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("model", "variant", "source").parquet(path)


def write_lookup(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK7: chunk_id -> text lookup table, sorted by id within files."""
    df.select("chunk_id", "text").sortWithinPartitions("chunk_id").write.mode(mode).parquet(path)


def write_temperatures(temps: DataFrame, path: str, as_json_map: bool = True) -> None:
    """SNK8: temperatures as a 'model_dataset -> T' JSON object or as a table.
    The object is one row in one file, as its format asks: a map of more than
    ``MAX_MAP`` groups is refused and should be written as a table."""
    if as_json_map and temps.limit(MAX_MAP + 1).count() > MAX_MAP:
        raise ValueError(f"more than {MAX_MAP} temperatures: write them as a table")
    if as_json_map:
        m = temps.select(F.to_json(F.map_from_entries(F.collect_list(F.struct(
            F.concat_ws("_", "model", "dataset"), F.col("T"))))).alias("value"))
        m.coalesce(1).write.mode("overwrite").text(path)
    else:
        temps.write.mode("overwrite").parquet(path)
