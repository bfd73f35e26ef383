"""DOM24 as a stream: score -> calibrate -> route, row by row.

Routing is stateless (each row is scored, joined to a static temperature
table and compared with a threshold), so it runs unchanged on a streaming
DataFrame: a file source of logits, a stream-static broadcast join, and a
parquet sink.  The caller names the checkpoint location: it must be a fixed
folder on shared storage that belongs to the sink, so that a new process goes
on where the last one stopped.  ``availableNow`` processes what is there and
stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scoring import with_scores
from tessera.operators.calibration import apply_temperature
from tessera.operators.metrics import route

LOGITS_SCHEMA = ("model string, dataset string, ex_id long, text string, label int, "
                 "orig_class string, l0 double, l1 double")


def routed_stream(spark: SparkSession, source_dir: str, temps: DataFrame,
                  threshold: float = 0.90, schema: str = LOGITS_SCHEMA) -> DataFrame:
    stream = spark.readStream.schema(schema).parquet(source_dir)
    cal = apply_temperature(with_scores(stream), temps)
    return route(cal, threshold).select("model", "dataset", "ex_id", "label", "predicted",
                                        "confidence", "T", "confidence_cal", "route")


def run_router(spark: SparkSession, source_dir: str, temps: DataFrame, sink_dir: str,
               checkpoint_location: str, threshold: float = 0.90) -> None:
    """Process every file that ``checkpoint_location`` has not yet recorded."""
    q = (routed_stream(spark, source_dir, temps, threshold).writeStream
         .format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_location)
         .trigger(availableNow=True).outputMode("append").start())
    q.awaitTermination()


def route_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("model", "dataset", "route").agg(F.count(F.lit(1)).alias("n"))
