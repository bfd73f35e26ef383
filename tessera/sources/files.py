"""File sources (SRC5-SRC8, SRC10, SCL7, SET5).

Line files are read line by line, so that a long one is split over tasks;
their line numbers come from the block that a line was read from.  A text
document is one row by its meaning, and a JSON map one value, so these are read
whole.  Columns of a partitioned folder pass through every reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import web as W
from tessera.functions.text import strip
from tessera.operators.corpus import keep_first
from tessera.session import materialize, small_side


def _columns(df: DataFrame) -> list[str]:
    """The folder columns of a partitioned text source."""
    return [c for c in df.columns if c != "value"]


#: Ends a document in a packed text file, and what stands for it (and for itself) in names and bodies.
RECORD, ESCAPE = "\x1e", "\x10"


def pack_text_files(files: DataFrame, path: str) -> None:
    """SRC5 writer: ``(file_name, raw)``, small text files, as a folder of a few
    large ones.  A record is the name, a line end and the body; a million files
    of their own would each be created, moved, listed and opened."""
    both = F.concat_ws("\n", F.col("file_name"), F.coalesce("raw", F.lit("")))
    coded = F.replace(F.replace(both, F.lit(ESCAPE), F.lit(ESCAPE + "p")), F.lit(RECORD), F.lit(ESCAPE + "s"))
    files.select(coded.alias("value")).write.option("lineSep", RECORD).text(path)


def _packed(spark: SparkSession, path: str) -> DataFrame:
    """The ``file_name, raw`` of ``pack_text_files``."""
    value = F.replace(F.replace("value", F.lit(ESCAPE + "s"), F.lit(RECORD)), F.lit(ESCAPE + "p"), F.lit(ESCAPE))
    return spark.read.text(path, lineSep=RECORD).select(value.alias("_v")).select(
        F.expr("substring(_v, 1, instr(_v, '\n') - 1)").alias("file_name"),
        F.expr("substring(_v, instr(_v, '\n') + 1)").alias("raw"))


def text_files(spark: SparkSession, path: str, suffix: str = ".txt", packed: bool = False) -> DataFrame:
    """SRC5 / SRC7: one row per file -- (file_name, file_id, text); only
    files with ``suffix``; id = name without the suffix; body stripped.
    ``packed``: the files lie in packed ones (``pack_text_files``)."""
    if packed:
        df = _packed(spark, path)
    else:
        df = spark.read.text(path, wholetext=True)
        df = df.select(F.col("_metadata.file_name").alias("file_name"), *_columns(df), F.col("value").alias("raw"))
    stem = F.expr(f"substring(file_name, 1, length(file_name) - {len(suffix)})")
    return df.where(F.col("file_name").endswith(suffix)).select(
        "file_name", stem.alias("file_id"), *[c for c in df.columns if c not in ("file_name", "raw")],
        strip("raw").alias("text"))


def labelled_text_dir(spark: SparkSession, text_dir: str, meta: DataFrame, keep_labels=None,
                      drop_labels=None, drop_empty: bool = True, id_col: str = "file_id",
                      packed: bool = False) -> DataFrame:
    """SRC5 + JN1 + PRJ3 + PRJ4: text files joined to (``id_col``, label)
    metadata (inner join: a file without metadata is dropped), label
    whitelist or blacklist, empty-text drop; ordered by file name.  ``id_col``
    is the file's stem or a column of the folder."""
    files = text_files(spark, text_dir, packed=packed)
    j = files.join(meta.select(id_col, "label"), id_col)
    if keep_labels is not None:
        j = j.where(F.col("label").isin(list(keep_labels)))
    if drop_labels is not None:
        j = j.where(~F.col("label").isin(list(drop_labels)))
    if drop_empty:
        j = j.where(F.length("text") > 0)
    return j.orderBy("file_name")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: (file_path, file_name, folder columns..., line_num, raw) of every
    line, numbered from 1 per file.

    Files are read in blocks by as many tasks as they have blocks.  Row ids grow
    by one from line to line of a block, so a line's place there is its id less
    the block's first; the lines of the file's earlier blocks come from the
    blocks' counts, one row a block."""
    df = spark.read.text(path)
    lines = materialize(df.select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), *_columns(df),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"),
        F.col("value").alias("raw")))
    blocks = lines.groupBy("file_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(small_side(blocks), ["file_path", "_block"]).select(
        "file_path", "file_name", *_columns(df), (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("line_num"), "raw")


def comment_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC6 / SRC7: (file_name, line_num, line) and folder columns of non-blank
    lines that do not start with '#', stripped, 1-based line numbers per file."""
    rows = numbered_lines(spark, path)
    return rows.select("file_name", *[c for c in rows.columns if c not in ("file_path", "file_name", "raw", "line_num")],
                       "line_num", strip("raw").alias("line")) \
        .where((F.col("line") != "") & ~F.col("line").startswith("#"))


def parse_source_lines(lines: DataFrame, default_label: str = "hate") -> DataFrame:
    """SCL7 + PRJ15: 'website,slug' split at the first comma, trimmed,
    trailing '/' of website and both slashes of slug removed; lines with no
    comma or an empty part are rejected (reason kept)."""
    parts = F.split(F.col("line"), ",", 2)
    website = F.regexp_replace(strip(F.element_at(parts, 1)), "/+$", "")
    slug = F.regexp_replace(strip(F.when(F.size(parts) > 1, F.element_at(parts, 2))), "^/+|/+$", "")
    out = lines.select("file_name", "line_num", "line", website.alias("website"), slug.alias("slug"))
    reason = (F.when(F.size(F.split(F.col("line"), ",", 2)) < 2, F.lit("no_comma"))
              .when((F.col("website") == "") | (F.col("slug") == "") | F.col("slug").isNull(),
                    F.lit("empty_website_or_slug")))
    return out.select("file_name", "line_num", "website", "slug",
                      F.concat_ws("/", "website", "slug").alias("url"),
                      W.source_of("website").alias("source"), F.lit(default_label).alias("label"),
                      reason.alias("reject_reason"))


def ordered_distinct_lines(lines: DataFrame) -> DataFrame:
    """SET5: distinct lines across files in first-seen order (file name,
    then line number)."""
    return keep_first(lines, ["line"], ["file_name", "line_num"])


def json_map(spark: SparkSession, path: str, value_type=T.DoubleType()) -> DataFrame:
    """SRC8: a JSON object file {key: value} -> (key, value) rows."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), T.MapType(T.StringType(), value_type))
    return raw.select(F.explode(m).alias("key", "value"))


def temperatures_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC8 for temperature files: 'model_dataset' keys split at the last
    '_' -> (model, dataset, T)."""
    kv = json_map(spark, path)
    return kv.select(F.regexp_extract("key", r"^(.*)_[^_]*$", 1).alias("model"),
                     F.regexp_extract("key", r"_([^_]*)$", 1).alias("dataset"),
                     F.col("value").alias("T"))


def listing_frontier(config: DataFrame) -> DataFrame:
    """SRC10: (source, base_url, pagination, start, end) -> one row per
    listing page with its URL; an unknown pagination gives url NULL and
    ``error`` set (the study raised)."""
    ex = config.select("*", F.explode(F.sequence(F.col("start"), F.col("end"))).alias("page_num"))
    url = W.page_url("base_url", "pagination", "page_num")
    return ex.select("source", "page_num", url.alias("page_url"),
                     F.when(url.isNull(), F.lit("unknown_pagination")).alias("error"))


def write_splits(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """SRC2 writer: a labelled corpus partitioned by its split column."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)


def read_split(spark: SparkSession, path: str, split: str, split_col: str = "split") -> DataFrame:
    """SRC2: one split of a multi-split dataset; the filter on the partition
    column prunes directories (PartitionFilters), other splits are never read."""
    return spark.read.parquet(path).where(F.col(split_col) == split)
