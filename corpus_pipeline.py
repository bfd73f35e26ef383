"""Corpus pipeline: toxicity, near-duplicates, decontamination, personal data, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all that its predecessor kept and returns a DataFrame, which is
written and read again before the next stage.  All but the last stage return
the columns of ``documents`` (and any extra ones).  The filtering stages and
the redaction work row by row after one fit or one link search, so no text is
shuffled for a decision.  The stages share the executors, whose memory stays
high from stage to stage: all of them work on small Arrow batches.
"""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tessera.llm import near_dups, packing, pii, tiling, toxicity
from tessera.llm.queries import tokenizer_path
from tessera.session import bounded_batches, materialize
from tessera.sources.tables import read_table


def small_batches(stage):
    """``stage`` with the session's Arrow batches bounded."""
    @functools.wraps(stage)
    def run_stage(spark, docs, sf_dir):
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


@small_batches
def drop_toxic(spark, docs, sf_dir):
    """Stage 1 (operator 10): documents scored 0.5 or more go.  The model is
    fitted on the labelled documents outside the held-out fold."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels", spread_rows=False))


@small_batches
def drop_near_duplicates(spark, docs, sf_dir):
    """Stage 2 (operator 2): one document of each near-duplicate group stays."""
    return near_dups.drop_near_duplicates(docs)


@small_batches
def drop_contaminated(spark, docs, sf_dir):
    """Stage 3 (operator 9): documents that cover a benchmark item go."""
    return tiling.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark", spread_rows=False))


@small_batches
def redact(spark, docs, sf_dir):
    """Stage 4 (operator 8): personal data and secrets become ``[KIND]`` marks;
    ``n_chars`` follows the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


@small_batches
def pack(spark, docs, sf_dir):
    """Stage 5 (operator 3): token pieces with sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact),
    ("packing", pack),
]

#: The fitted models and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    df = read_table(spark, sf_dir, "documents", spread_rows=False)
    for k, (_, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if k < len(STAGES) - 1:
            df = materialize(df)
    return df
