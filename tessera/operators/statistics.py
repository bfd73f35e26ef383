"""Mergeable statistics of a scored table (DOM12, DOM17, DOM18, DOM22, DOM30).

Every metric that compares the confidence with fixed limits or bins the
probability is a function of a small table of counts: one row per group, cell
of the confidence between two limits, probability bin, label and prediction,
with the number of rows and the sums of confidence and probability.  The scored
rows are read once; tables of several days or shards are merged by adding their
rows up; and the derived reports read no scored row again.  (ROC and PR curves
need every distinct score and are not among them.)
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import (GROUP, HANDOFF_THRESHOLDS, HIGH_CONF, MIN_RETAINED_FOR_F1, SWEEP_THRESHOLDS,
                                       _bin_case, macro_columns)

# Fixed value: above it a missed positive counts as dangerous.
DANGEROUS = 0.85
#: All limits that a report compares the confidence with, ascending.
EDGES = tuple(sorted({*SWEEP_THRESHOLDS, *HANDOFF_THRESHOLDS, HIGH_CONF, DANGEROUS}))
SUMS = ("n", "sum_conf", "sum_p")


def cell_of(conf: Column, edges: Sequence[float] = EDGES) -> Column:
    """How many edges are at most ``conf``, by bisection in nested conditions."""
    def half(lo, hi):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(conf >= F.lit(edges[mid]), half(mid + 1, hi)).otherwise(half(lo, mid))
    return half(0, len(edges))


def statistics(df: DataFrame, group: Sequence[str] = GROUP, prob: str = "p_hs", conf: str = "confidence",
               label: str = "label", pred: str = "predicted") -> DataFrame:
    """``group..., cell, on_edge, bin, label, predicted, n, sum_conf, sum_p``.
    ``on_edge`` tells a confidence equal to its cell's lower edge."""
    c, p = F.col(conf), F.col(prob)
    cell = cell_of(c)
    lower = F.element_at(F.array(F.lit(-1.0), *[F.lit(e) for e in EDGES]), cell + 1)
    return df.groupBy(*group, cell.alias("cell"), (c == lower).alias("on_edge"), _bin_case(p, True).alias("bin"),
                      F.col(label).alias("label"), F.col(pred).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(c).alias("sum_conf"), F.sum(p).alias("sum_p"))


def merge(tables: Sequence[DataFrame]) -> DataFrame:
    """The statistics of all rows behind ``tables``."""
    rows = reduce(DataFrame.unionByName, tables)
    return rows.groupBy(*[c for c in rows.columns if c not in SUMS]).agg(*[F.sum(c).alias(c) for c in SUMS])


def at_least(t: float) -> Column:
    return F.col("cell") > F.lit(EDGES.index(t))


def above(t: float) -> Column:
    i = EDGES.index(t)
    return (F.col("cell") > F.lit(i + 1)) | ((F.col("cell") == F.lit(i + 1)) & ~F.col("on_edge"))


def _n(where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))


def _confusion() -> list[Column]:
    y, p = F.col("label"), F.col("predicted")
    return [_n((y == a) & (p == b)).alias(name) for name, a, b in
            (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))]


def _share(n, of) -> Column:
    return F.col(n).cast("double") / F.col(of).cast("double")


def ece_of(stats: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """DOM12 from statistics: ``group..., ece``."""
    bins = stats.groupBy(*group, "bin").agg(
        F.sum("n").alias("n"), _n(F.col("label") == 1).alias("sy"), F.sum("sum_p").alias("sp"))
    off = F.col("n").cast("double") * F.abs(F.col("sy") / F.col("n") - F.col("sp") / F.col("n"))
    return bins.groupBy(*group).agg((F.sum(F.when(F.col("bin").isNotNull(), off).otherwise(F.lit(0.0)))
                                     / F.sum("n").cast("double")).alias("ece"))


def summary_of(stats: DataFrame, group: Sequence[str] = GROUP, t: float = 0.90) -> DataFrame:
    """The bounded part of DOM17 and DOM30 (unrounded): ``n``, macro metrics,
    ECE, mean confidence of right and wrong rows, counts above ``HIGH_CONF``,
    under ``t`` and of dangerous misses."""
    ok = F.col("label") == F.col("predicted")

    def mean(where):
        return F.sum(F.when(where, F.col("sum_conf"))) / _n(where).cast("double")

    base = stats.groupBy(*group).agg(
        *_confusion(), F.sum("n").alias("n"), F.when(_n(ok) > 0, mean(ok)).alias("conf_correct"),
        F.when(_n(~ok) > 0, mean(~ok)).alias("conf_wrong"), _n(above(HIGH_CONF)).alias("n_high"),
        _n(~at_least(t)).alias("n_routed"),
        _n(above(DANGEROUS) & (F.col("label") == 1) & (F.col("predicted") == 0)).alias("n_high_conf_fn"))
    return base.select("*", *[v.alias(k) for k, v in macro_columns().items()]).join(ece_of(stats, group), list(group))


def sweep_of(stats: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """DOM18 and DOM19 from statistics, rows as ``selective_sweep`` has them."""
    steps = F.array(*[F.lit(sum(t <= e for t in SWEEP_THRESHOLDS)) for e in (-1.0, *EDGES)])
    counts = stats.withColumn("step", F.element_at(steps, F.col("cell") + 1)).groupBy(*group, "step").agg(
        F.sum("n").alias("n"), *_confusion())
    total = counts.groupBy(*group).agg(F.sum("n").alias("n_total"))
    grid = total.select(*group, "n_total", F.explode(F.sequence(F.lit(1), F.lit(len(SWEEP_THRESHOLDS)))).alias("step"))
    names = ("n", "tp", "fp", "tn", "fn")
    w = Window.partitionBy(*group).orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = grid.join(counts, [*group, "step"], "left").na.fill(0, list(names)).select(
        *group, "step", "n_total", *[F.sum(c).over(w).alias(c) for c in names])
    return run.select(
        *group, "step", F.element_at(F.array(*[F.lit(t) for t in SWEEP_THRESHOLDS]), F.col("step")).alias("threshold"),
        F.col("n").alias("n_retained"), F.round(_share("n", "n_total"), 6).alias("coverage"),
        F.round(F.when(F.col("n") > 0, (F.col("tp") + F.col("tn")).cast("double") / F.col("n").cast("double")), 6)
        .alias("accuracy"),
        F.round(F.when(F.col("n") >= MIN_RETAINED_FOR_F1, macro_columns()["macro_f1"]), 6).alias("macro_f1"))


def handoff_of(stats: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """DOM22 from statistics, rows as ``handoff_rates`` has them."""
    per = stats.groupBy(*group).agg(F.sum("n").alias("n"), F.array(*[
        F.struct(F.lit(t).alias("threshold"), _n(~at_least(t)).alias("n_routed")) for t in HANDOFF_THRESHOLDS]).alias("r"))
    return per.select(*group, "n", F.explode("r").alias("r")).select(*group, "n", "r.*").select(
        *group, "threshold", "n_routed", F.round(_share("n_routed", "n") * 100.0, 6).alias("pct_routed"))
