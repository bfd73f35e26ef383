"""Violin / KDE summaries (AGG15, DOM29) and retrieval context (DOM36).

The density of a group on a grid is a sum over its rows: each row adds
exp(-((x_g - x_i)/bw)^2 / 2) to every grid point.  A task adds its rows up in
one array per group, a matrix operation per Arrow batch, and hands on one row per
group; no row is multiplied.  Group statistics (n, sd, min, max) come from one
small aggregate (one row per group) that is broadcast after a check of its size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import hard_token_cap
from tessera.operators.prefix import exact_quantiles
from tessera.session import bounded_broadcast, materialize

GRID = 100
CUT = 2.0
#: Values met with the grid at once, and groups that a task holds.
TILE = 2048
GROUPS_HELD = 4096


def kde(df: DataFrame, group: Sequence[str], value: str, gridsize: int = GRID, cut: float = CUT,
        min_rows: int = 3) -> DataFrame:
    """AGG15: Gaussian KDE with Scott's bandwidth n^(-1/5) * sd (ddof 1)
    on ``gridsize`` points from min - cut*bw to max + cut*bw; groups with
    fewer than ``min_rows`` rows or zero spread are skipped."""
    group = list(group)
    v = F.col(value).cast("double")
    stats = df.groupBy(*group).agg(F.count(v).alias("_n"), F.stddev_samp(v).alias("_sd"),
                                   F.min(v).alias("_mn"), F.max(v).alias("_mx"))
    stats = stats.where((F.col("_n") >= min_rows) & (F.col("_sd") > 0)) \
        .withColumn("_bw", F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * F.col("_sd")) \
        .withColumn("_lo", F.col("_mn") - F.lit(cut) * F.col("_bw")) \
        .withColumn("_step", (F.col("_mx") - F.col("_mn") + F.lit(2 * cut) * F.col("_bw")) / F.lit(gridsize - 1))
    stats = materialize(stats.withColumn("_g", F.monotonically_increasing_id()))
    near = [F.col(f"d.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    rows = df.select(*group, v.alias("_v")).alias("d").join(bounded_broadcast(stats).alias("s"), near).select(
        "_g", "_lo", "_step", "_bw", "_v").where("_v IS NOT NULL")

    def add_up(batches):
        sums: dict[int, np.ndarray] = {}

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))],
                names=["_g", "_s"])

        for batch in batches:
            g, lo, step, bw, x = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            order = np.argsort(g, kind="stable")
            ids, first = np.unique(g[order], return_index=True)
            for k, at in zip(ids.tolist(), np.split(order, first[1:])):
                grid = lo[at[0]] + np.arange(gridsize) * step[at[0]]
                total = sums.setdefault(k, np.zeros(gridsize))
                for s in range(0, len(at), TILE):
                    total += np.exp(-0.5 * ((grid[:, None] - x[at[s:s + TILE]]) / bw[at[0]]) ** 2).sum(axis=1)
            if len(sums) > GROUPS_HELD:
                yield out()
                sums.clear()
        if sums:
            yield out()

    parts = rows.mapInArrow(add_up, "_g long, _s array<double>").select("_g", F.posexplode("_s").alias("i", "_k"))
    dens = parts.groupBy("_g", "i").agg(F.sum("_k").alias("_s")).join(bounded_broadcast(stats), "_g")
    norm = F.col("_n").cast("double") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi))
    return dens.select(*group, "i", F.round(F.col("_lo") + F.col("i").cast("double") * F.col("_step"), 6).alias("x"),
                       F.round(F.col("_s") / norm, 6).alias("density"))


def class_breakdown(scored: DataFrame, group: Sequence[str] = ("model", "dataset", "orig_class")) -> DataFrame:
    """DOM29: per original class -- n, accuracy, mean confidence and
    confidence quartiles (exact, distributed)."""
    group = list(group)
    base = scored.where(F.col(group[-1]).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg("confidence").alias("conf_mean"))
    q = exact_quantiles(scored.where(F.col(group[-1]).isNotNull()).select(*group, "confidence"),
                        group, "confidence", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    out = base.join(q, group)
    return out.select(*group, "n", *[F.round(c, 6).alias(c) for c in
                                     ("accuracy", "conf_mean", "q1", "median", "q3")])


def max_chunk_tokens(max_len: int = 512, query_tokens: int = 100, k: int = 5) -> int:
    """DOM36: query + k chunks + k separators must fit in max_len."""
    return (max_len - query_tokens - k) // k


def rag_context(hits: DataFrame, chunks: DataFrame, chunk_tokens: int = 64, sep: str = " [SEP] ") -> DataFrame:
    """DOM36: per query, the ranked hit texts joined with ``sep``.  Hits should
    be chunks that fit ``chunk_tokens``; longer ones are cut after the join.  A
    query holds at most k hits, so the list is bounded by k."""
    j = hits.join(chunks.select("chunk_id", "text"), "chunk_id").withColumn(
        "_t", hard_token_cap("text", chunk_tokens))
    agg = j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "_t"))).alias("_l"))
    return agg.select("query_id", F.array_join(F.transform("_l", lambda s: s["_t"]), sep).alias("context"),
                      F.size("_l").alias("n_hits"))
