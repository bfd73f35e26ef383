"""The synthetic ``scored`` table derived from ``documents`` and ``labels``.

The driver tables carry no model predictions, so the analysis operators
are exercised on logits that Spark derives deterministically from every
labelled document.  They are synthetic and say nothing about model quality.

For model m in {0, 1, 2} and labelled document d:
    h  = int(first 8 hex digits of md5(d || ':' || m)) % 1000
    z  = s_m * ((2*toxic - 1) + (h / 500 - 1) * 2),   s = (1.5, 2.0, 3.0)
    l0 = -z / 2,  l1 = z / 2,  dataset = 'd' || (d % 3)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scoring import orig_class, with_scores
from tessera.sources.tables import read_table

# Fixed values of the synthetic fixture.
MODELS = ("m0", "m1", "m2")
MODEL_SCALES = (1.5, 2.0, 3.0)
DATASETS = ("d0", "d1", "d2")


def logits_table(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """scored(model, dataset, ex_id, text, label, orig_class, l0, l1)."""
    models = F.array(*[
        F.struct(F.lit(i).alias("m"), F.lit(name).alias("model"), F.lit(s).alias("scale"))
        for i, (name, s) in enumerate(zip(MODELS, MODEL_SCALES))])
    lab = labels.select("doc_id", "toxic", "quality")
    # labels is the small side in practice, but both sides grow with the data:
    # let the planner choose (AQE turns it into a broadcast when it is small).
    base = documents.select("doc_id", "text").join(lab, "doc_id")
    x = base.select("*", F.explode(models).alias("_m")).select("*", "_m.*").drop("_m")
    key = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("m").cast("string"))
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % 1000
    z = F.col("scale") * ((F.lit(2) * F.col("toxic") - 1).cast("double")
                          + (h.cast("double") / F.lit(500.0) - F.lit(1.0)) * F.lit(2.0))
    return x.select(
        "model",
        F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string")).alias("dataset"),
        F.col("doc_id").alias("ex_id"),
        "text",
        F.col("toxic").alias("label"),
        orig_class().alias("orig_class"),
        (-z / F.lit(2.0)).alias("l0"),
        (z / F.lit(2.0)).alias("l1"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits plus p_hs, confidence, predicted, correct."""
    # Only ids (and text for a few example reports) are read from
    # documents; no per-row heavy work, so the scan is not spread.
    docs = read_table(spark, sf_dir, "documents", spread_rows=False)
    labels = read_table(spark, sf_dir, "labels")
    return with_scores(logits_table(docs, labels))


# DuckDB twin of ``scored`` used by the oracle SQL (same expression order).
SCORED_SQL = """
scored_base AS (
  SELECT m.model,
         'd' || CAST(d.doc_id % 3 AS VARCHAR) AS dataset,
         d.doc_id AS ex_id, d.text, l.toxic AS label,
         CASE WHEN l.toxic = 0 THEN 'not_hate' WHEN l.quality = 0 THEN 'explicit_hate'
              ELSE 'implicit_hate' END AS orig_class,
         m.scale * (CAST(2 * l.toxic - 1 AS DOUBLE)
           + (CAST(('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || ':' || CAST(m.m AS VARCHAR)), 1, 8))::BIGINT % 1000 AS DOUBLE)
              / CAST(500.0 AS DOUBLE) - CAST(1.0 AS DOUBLE)) * CAST(2.0 AS DOUBLE)) AS z
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  CROSS JOIN (VALUES (0, 'm0', CAST(1.5 AS DOUBLE)), (1, 'm1', CAST(2.0 AS DOUBLE)),
                     (2, 'm2', CAST(3.0 AS DOUBLE))) AS m(m, model, scale)
),
scored_logits AS (
  SELECT model, dataset, ex_id, text, label, orig_class,
         -z / CAST(2.0 AS DOUBLE) AS l0, z / CAST(2.0 AS DOUBLE) AS l1
  FROM scored_base
),
scored_p AS (
  SELECT *, CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(l0 - l1)) AS p_hs,
         CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS predicted
  FROM scored_logits
),
scored AS (
  SELECT *, greatest(p_hs, CAST(1.0 AS DOUBLE) - p_hs) AS confidence,
         (predicted = label) AS correct
  FROM scored_p
)"""
