"""DOM24 to the end: rows below the threshold are searched in the same stream.

A micro-batch is scored, calibrated and routed once and written in the shared
folder; kept and routed rows go to one sink, the hits of the routed ones
(DOM4/DOM6 against a static vector index) to another.  Both sinks have a folder
per batch id that is written as a whole, so a batch that a restarted process
plays again replaces what the first try left: every source row reaches the
sinks once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scoring import with_scores
from tessera.operators.block_search import search
from tessera.operators.calibration import apply_temperature
from tessera.operators.metrics import route
from tessera.operators.vectors import hashed_embeddings
from tessera.session import bounded_broadcast, materialize
from tessera.streaming.router import LOGITS_SCHEMA

Encoder = Callable[[DataFrame, str, str], DataFrame]
ROUTED = ("model", "dataset", "ex_id", "label", "predicted", "confidence", "T", "confidence_cal", "route")


def routed_rows(logits: DataFrame, temps: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Logits to ``ROUTED`` and the text."""
    return route(apply_temperature(with_scores(logits), temps), threshold).select(*ROUTED, "text")


def retrieved(routed: DataFrame, index: DataFrame, k: int = 3, min_score: float | None = None,
              encoder: Encoder = hashed_embeddings) -> DataFrame:
    """``model, dataset, ex_id, rank, chunk_id, score`` of the routed rows.

    ``routed`` should be a written table.  Every distinct text is encoded and
    searched once, whatever the number of models that route it; a NULL text is
    searched like an empty one."""
    rows = routed.where(F.col("route") == "rag").select(
        "model", "dataset", "ex_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.sha2("text", 256))
    texts = rows.groupBy("key").agg(F.min("text").alias("text"))
    queries = encoder(texts, "key", "text").select(
        F.col("key").alias("query_id"), F.lit(None).cast("long").alias("self_id"), "embedding")
    hits = materialize(search(queries, index, k=k, threshold=min_score).withColumnRenamed("query_id", "key"))
    # a text that very many rows share: its k hits are copied to them, not the rows moved, while hits are few
    return rows.drop("text").join(bounded_broadcast(hits), "key").select(
        "model", "dataset", "ex_id", "rank", "chunk_id", "score")


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """The rows of one batch, in place of any that an earlier try has written."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def run_retrieval(spark: SparkSession, source_dir: str, temps: DataFrame, index_dir: str, sink_dir: str,
                  checkpoint_location: str, threshold: float = 0.90, k: int = 3, min_score: float | None = None,
                  encoder: Encoder = hashed_embeddings, after_batch: Callable[[int], None] | None = None) -> None:
    """Process every file that ``checkpoint_location`` has not yet recorded.

    ``index_dir``: Parquet of (chunk_id, embedding), normalised.  ``after_batch``
    is called when a batch's sinks are written and its commit is not."""
    def process(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(routed_rows(batch, temps, threshold))
        write_batch(rows.select(*ROUTED), f"{sink_dir}/routed", batch_id)
        index = batch.sparkSession.read.parquet(index_dir)
        write_batch(retrieved(rows, index, k, min_score, encoder), f"{sink_dir}/hits", batch_id)
        if after_batch is not None:
            after_batch(batch_id)

    stream = spark.readStream.schema(LOGITS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source_dir)
    q = (stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_location)
         .trigger(availableNow=True).start())
    q.awaitTermination()
