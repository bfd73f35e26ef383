"""Embeddings and exact similarity search (SCL26, DOM3-DOM10, JN4-JN6, WIN5).

Search is exhaustive inner product on L2-normalised vectors (cosine), the
semantics of a flat index; its plan is in ``block_search``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import tokens
from tessera.operators.block_search import search


def l2_normalize(c) -> Column:
    """SCL26: v / ||v|| in double; a zero vector is left unchanged."""
    v = (F.col(c) if isinstance(c, str) else c).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def hashed_embeddings(df: DataFrame, id_col: str, text_col: str = "text", dim: int = 64,
                      out_id: str | None = None) -> DataFrame:
    """DOM3 default encoder: bag of lower-cased whitespace tokens hashed to
    ``dim`` buckets (md5 of the token), counts, then L2-normalised.

    The buckets of a row's tokens are an array expression; Arrow batches of
    these arrays are counted with ``np.bincount``.  Nothing is exploded or
    shuffled: one row in, one vector out.  A text without a token gets the
    zero vector.
    """
    out_id = out_id or id_col
    # Tokens are lower-cased one by one: Spark's lower() takes a slow path
    # for a whole string as soon as it holds one non-ASCII character, while
    # most single tokens are ASCII.  Case mapping never creates or removes
    # whitespace, so this equals tokenising the lower-cased text.
    buckets = F.transform(tokens(F.col(text_col)), lambda t: (
        F.conv(F.substring(F.md5(F.lower(t)), 1, 8), 16, 10).cast("bigint") % dim).cast("int"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(1)
            n = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), n)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            table = np.bincount(row * dim + flat, minlength=batch.num_rows * dim).astype(np.float64)
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(table), dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=["_id", "_v"])

    id_type = df.schema[id_col].dataType.simpleString()
    got = df.select(F.col(id_col).alias("_id"), buckets.alias("_b")).mapInArrow(
        count, f"_id {id_type}, _v array<double>")
    return got.select(F.col("_id").alias(out_id), l2_normalize("_v").alias("embedding"))


def encode_with(df: DataFrame, text_col: str, encoder: Callable[[list[str]], np.ndarray],
                id_col: str = "chunk_id", batch_size: int = 64) -> DataFrame:
    """DOM3 / UDF5: run a caller-supplied batch encoder (texts -> (n, d)
    array) over Arrow batches, then L2-normalise."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for s in range(0, len(pdf), batch_size):
                part = pdf.iloc[s:s + batch_size]
                vecs = np.asarray(encoder(part[text_col].tolist()), dtype=np.float64)
                norms = np.linalg.norm(vecs, axis=1, keepdims=True)
                vecs = np.where(norms > 0, vecs / np.where(norms > 0, norms, 1.0), vecs)
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "embedding": list(vecs)})
    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} long, embedding array<double>")


TextEncoder = Callable[[list[str]], np.ndarray]


#: Tokens of which a task keeps the hash.
KNOWN_TOKENS = 100_000


def hashed_encoder(dim: int, known: dict[str, int] | None = None) -> TextEncoder:
    """The vectors of :func:`hashed_embeddings` before normalisation, as an
    encoder of text batches; hashes of tokens are kept for the task, in ``known``
    if several encoders share them, ``KNOWN_TOKENS`` at most."""
    known = {} if known is None else known

    def bucket(token: str) -> int:
        if token not in known:
            if len(known) >= KNOWN_TOKENS:
                known.clear()
            known[token] = int(hashlib.md5(token.lower().encode()).hexdigest()[:8], 16)
        return known[token] % dim

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            at = [bucket(t) for t in text.split()]
            if at:
                out[row] = np.bincount(at, minlength=dim)
        return out

    return encode


#: Texts as the variants of an index take them.
VARIANTS: dict[str, Callable[[str], str]] = {"full": lambda t: t, "head": lambda t: " ".join(t.split()[:20])}
#: Encoders by model name; callers add their own.
_known: dict[str, int] = {}
ENCODERS: dict[str, TextEncoder] = {"hashed32": hashed_encoder(32, _known), "hashed64": hashed_encoder(64, _known)}


def index_grid(chunks: DataFrame, models: Sequence[str], variants: Sequence[str], batch_size: int = 256,
               encoders: dict[str, TextEncoder] | None = None) -> DataFrame:
    """DOM3 for a grid: ``model, variant, source, chunk_id, embedding``
    (L2-normalised) of every chunk (source, chunk_id, text) under each model and
    variant.  The chunks are read once; a task encodes each batch of texts with
    all of the encoders.  A NULL text is encoded like an empty one."""
    chosen = {m: (encoders or ENCODERS)[m] for m in models}
    shapes = {v: VARIANTS[v] for v in variants}

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, batch_size):
                part = batch.slice(s, batch_size)
                texts = [t or "" for t in part.column(2).to_pylist()]
                for variant, shape in shapes.items():
                    shaped = [shape(t) for t in texts]
                    for model, encode in chosen.items():
                        vecs = np.asarray(encode(shaped), dtype=np.float64)
                        norms = np.linalg.norm(vecs, axis=1, keepdims=True)
                        vecs = vecs / np.where(norms > 0, norms, 1.0)
                        n, dim = vecs.shape
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([model] * n), pa.array([variant] * n), part.column(0), part.column(1),
                             pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(vecs.ravel()))],
                            names=["model", "variant", "source", "chunk_id", "embedding"])
            pa.default_memory_pool().release_unused()   # else a worker keeps the peak of all its batches

    return chunks.select(F.col("source").cast("string"), F.col("chunk_id").cast("long"), "text").mapInArrow(
        run, "model string, variant string, source string, chunk_id long, embedding array<double>")


def index_integrity(vectors: DataFrame, dims: dict[str, int]) -> DataFrame:
    """DOM10 per index: rows, distinct ids, rows of another width than the
    model's, vectors without a direction."""
    dim = F.element_at(F.create_map(*[F.lit(x) for kv in dims.items() for x in kv]), F.col("model"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return vectors.groupBy("model", "variant", "source").agg(
        F.count(F.lit(1)).alias("n_vectors"), F.count_distinct("chunk_id").alias("n_ids"),
        F.count_if(F.coalesce(F.size("embedding") != dim, F.lit(True))).alias("n_bad_width"),
        F.count_if(norm == 0).alias("n_zero"))


def integrity(vectors: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """DOM10: row count and rows whose width is not ``dim``."""
    return vectors.agg(F.count(F.lit(1)).alias("n_vectors"),
                       F.count_if(F.size(col) != dim).alias("n_bad_width"),
                       F.lit(dim).alias("dim"))


def self_queries(vectors: DataFrame, id_col: str = "vec_id", exclude_self: bool = True) -> DataFrame:
    """Every corpus vector as a query of its own (normalised)."""
    return vectors.select(F.col(id_col).alias("query_id"),
                          (F.col(id_col) if exclude_self else F.lit(None).cast("long")).alias("self_id"),
                          l2_normalize("embedding").alias("embedding"))


def corpus_of(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return vectors.select(F.col(id_col).alias("chunk_id"), l2_normalize("embedding").alias("embedding"))


def self_exclusion_audit(vectors: DataFrame, k: int = 3, id_col: str = "vec_id") -> DataFrame:
    """DOM8: with the self id the own vector never comes back; without it,
    it is found (it scores 1).  One search, with exclusion, answers both: the
    own vector would be among the first k if fewer than k of the hits come
    before it by score, then id."""
    queries = self_queries(vectors, id_col, True).where("embedding IS NOT NULL")
    own = F.round(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x), 12)
    hits = search(queries, corpus_of(vectors, id_col), k)
    before = (F.col("score") > F.col("_own")) | ((F.col("score") == F.col("_own")) & (F.col("chunk_id") < F.col("query_id")))
    per = queries.select("query_id", own.alias("_own")).join(hits, "query_id", "left").groupBy("query_id").agg(
        F.count_if(before).alias("_before"), F.count_if(F.col("chunk_id") == F.col("query_id")).alias("_back"))
    return per.agg(F.count(F.lit(1)).alias("n_queries"),
                   F.count_if(F.col("_before") < k).alias("n_self_found_without_exclusion"),
                   F.count_if(F.col("_back") > 0).alias("n_self_returned_with_exclusion"))


def id_offset(df: DataFrame, after: DataFrame, least: int, col: str = "chunk_id") -> DataFrame:
    """GEN2: shift the ids of ``df`` (the second corpus of a union) behind those
    of ``after``: by ``least``, or by max + 1 once the first corpus is larger.
    One number is read from ``after``, which should be a written table."""
    top = after.agg(F.max(col)).first()[0]
    return df.withColumn(col, F.col(col) + F.lit(max(least, -1 if top is None else top + 1)).cast("long"))
