"""Classification metrics, calibration and selective prediction over a
scored table (AGG8-AGG14, WIN3, WIN6-WIN8, DOM12-DOM13, DOM16-DOM23, DOM30).

Every metric is a grouped aggregate keyed by ``group`` (default
``(model, dataset)``): one scan with map-side partial aggregation, then a
tiny shuffle of per-group counters.  Nothing collects a group's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.prefix import exact_quantiles, prefix_sums
from tessera.session import materialize, small_side

GROUP = ("model", "dataset")

# Hand-off thresholds of the study.
HANDOFF_THRESHOLDS = (0.60, 0.70, 0.80, 0.90, 0.95)
# Dense sweep: 50 evenly spaced values in [0.5, 1.0] exactly as NumPy's
# linspace produces them (not rebuilt by repeated addition).
SWEEP_THRESHOLDS = tuple(float(x) for x in np.linspace(0.5, 1.0, 50))
# Uniform calibration bin edges, again the linspace doubles (0.7 is
# 0.7000000000000001, so p = 0.7 lands in bin 6).
BIN_EDGES = tuple(float(x) for x in np.linspace(0.0, 1.0, 11))
HIGH_CONF = 0.9
MIN_RETAINED_FOR_F1 = 10


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _div0(n: Column, d: Column) -> Column:
    """n / d with 0 when d == 0 (zero_division=0)."""
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d.cast("double"))


# ---------------------------------------------------------------- AGG8-10

def confusion_aggs(label="label", pred="predicted") -> list[Column]:
    y, p = _c(label), _c(pred)
    return [F.count_if((y == 1) & (p == 1)).alias("tp"),
            F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 0) & (p == 0)).alias("tn"),
            F.count_if((y == 1) & (p == 0)).alias("fn")]


def confusion(df: DataFrame, group: Sequence[str] = GROUP, label="label",
              pred="predicted") -> DataFrame:
    """AGG8: TP/FP/TN/FN per group."""
    return df.groupBy(*group).agg(*confusion_aggs(label, pred))


def macro_columns(tp="tp", fp="fp", tn="tn", fn="fn") -> dict[str, Column]:
    """AGG9: macro precision / recall / F1 from confusion counters.

    Averaged over the labels present in y_true or y_pred only; an absent
    denominator counts as 0 (zero_division=0).
    """
    tp, fp, tn, fn = _c(tp), _c(fp), _c(tn), _c(fn)
    has1 = (tp + fn + fp) > 0
    has0 = (tn + fp + fn) > 0
    n_labels = has1.cast("int") + has0.cast("int")
    per = {
        "precision": (_div0(tn, tn + fn), _div0(tp, tp + fp)),
        "recall": (_div0(tn, tn + fp), _div0(tp, tp + fn)),
        "f1": (_div0(2 * tn, 2 * tn + fn + fp), _div0(2 * tp, 2 * tp + fp + fn)),
    }
    out = {}
    for name, (c0, c1) in per.items():
        total = F.when(has0, c0).otherwise(F.lit(0.0)) + F.when(has1, c1).otherwise(F.lit(0.0))
        out[f"macro_{name}"] = F.when(n_labels == 0, F.lit(None).cast("double")) \
            .otherwise(total / n_labels.cast("double"))
    return out


def macro_prf(df: DataFrame, group: Sequence[str] = GROUP, label="label",
              pred="predicted") -> DataFrame:
    cm = confusion(df, group, label, pred)
    cols = macro_columns()
    return cm.select(*group, "tp", "fp", "tn", "fn",
                     *[F.round(v, 6).alias(k) for k, v in cols.items()])


def classification_report(df: DataFrame, group: Sequence[str] = GROUP, label="label",
                          pred="predicted") -> DataFrame:
    """AGG10: per-class P/R/F1/support, macro avg, weighted avg, accuracy."""
    cm = confusion(df, group, label, pred)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    sup0, sup1 = tn + fp, tp + fn
    n = sup0 + sup1
    p0, r0, f0 = _div0(tn, tn + fn), _div0(tn, tn + fp), _div0(2 * tn, 2 * tn + fn + fp)
    p1, r1, f1 = _div0(tp, tp + fp), _div0(tp, tp + fn), _div0(2 * tp, 2 * tp + fp + fn)
    m = macro_columns()
    w = lambda a, b: _div0(a * sup0.cast("double") + b * sup1.cast("double"), n)
    acc = _div0(tp + tn, n)

    def row(cls, p, r, f, s):
        return F.struct(F.lit(cls).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("long").alias("support"))
    rows = F.array(
        row("0", p0, r0, f0, sup0), row("1", p1, r1, f1, sup1),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        row("macro avg", m["macro_precision"], m["macro_recall"], m["macro_f1"], n),
        row("weighted avg", w(p0, p1), w(r0, r1), w(f0, f1), n))
    ex = cm.select(*group, F.explode(rows).alias("r"), sup0.alias("_s0"), sup1.alias("_s1"),
                   (tp + fp).alias("_pp"), (tn + fn).alias("_pn"))
    # sklearn lists only labels seen in y_true or y_pred.
    keep = ((F.col("r.class") != "0") | (F.col("_s0") + F.col("_pn") > 0)) & \
           ((F.col("r.class") != "1") | (F.col("_s1") + F.col("_pp") > 0))
    return ex.where(keep).select(
        *group, F.col("r.class").alias("class"),
        F.round("r.precision", 6).alias("precision"), F.round("r.recall", 6).alias("recall"),
        F.round("r.f1", 6).alias("f1"), F.col("r.support").alias("support"))


# ---------------------------------------------------------------- AGG11-13

def confidence_stats(df: DataFrame, group: Sequence[str] = GROUP, conf="confidence",
                     correct="correct") -> DataFrame:
    """AGG11 + AGG12: mean confidence overall / correct / wrong, gap, % > 0.9."""
    cf, ok = _c(conf), _c(correct)
    agg = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(cf).alias("conf_mean"),
        F.avg(F.when(ok, cf)).alias("conf_correct"),
        F.avg(F.when(~ok, cf)).alias("conf_wrong"),
        F.count_if(cf > HIGH_CONF).alias("_hi"))
    return agg.select(
        *group, "n",
        F.round("conf_mean", 6).alias("conf_mean"),
        F.round("conf_correct", 6).alias("conf_correct"),
        F.round("conf_wrong", 6).alias("conf_wrong"),
        F.round(F.col("conf_correct") - F.col("conf_wrong"), 6).alias("conf_gap"),
        F.round(F.col("_hi").cast("double") / F.col("n").cast("double") * 100.0, 6)
        .alias("pct_conf_gt_90"))


def class_distribution(df: DataFrame, group=("dataset",), label="label") -> DataFrame:
    """AGG1: rows per (group, label)."""
    return df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("n"))


def per_class_accuracy(df: DataFrame, group: Sequence[str] = GROUP, cls="orig_class",
                       correct="correct", conf="confidence") -> DataFrame:
    """AGG13 / DOM29: accuracy, n and mean confidence per original class."""
    agg = df.where(_c(cls).isNotNull()).groupBy(*group, cls).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(_c(correct).cast("double")).alias("accuracy"),
        F.avg(_c(conf)).alias("conf_mean"))
    return agg.select(*group, cls, "n", F.round("accuracy", 6).alias("accuracy"),
                      F.round("conf_mean", 6).alias("conf_mean"))


# ---------------------------------------------------------------- DOM12-13

def _bin_case(p: Column, closed_left: bool) -> Column:
    """Bin index against the literal edge array.

    closed_left: [lo, hi) with p == 1.0 in no bin (NULL) -- the ECE rule.
    otherwise:   (lo, hi] with the first bin closed -- the reliability rule.
    """
    e = BIN_EDGES
    if closed_left:
        expr = F.when(p < F.lit(e[1]), F.lit(0))
        for i in range(1, 10):
            expr = expr.when(p < F.lit(e[i + 1]), F.lit(i))
        return expr
    expr = F.when(p <= F.lit(e[1]), F.lit(0))
    for i in range(1, 9):
        expr = expr.when(p <= F.lit(e[i + 1]), F.lit(i))
    return expr.otherwise(F.lit(9))


def ece(df: DataFrame, group: Sequence[str] = GROUP, prob="p_hs", label="label",
        out="ece") -> DataFrame:
    """DOM12: expected calibration error over 10 uniform [lo, hi) bins of
    P(HS); p = 1.0 falls in no bin but counts in the denominator."""
    p = _c(prob)
    bins = df.groupBy(*group, _bin_case(p, True).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_nb"),
        F.sum(_c(label).cast("double")).alias("_sy"),
        F.sum(p).alias("_sp"))
    term = F.col("_nb").cast("double") * F.abs(F.col("_sy") / F.col("_nb") - F.col("_sp") / F.col("_nb"))
    return bins.groupBy(*group).agg(
        (F.sum(F.when(F.col("_bin").isNotNull(), term).otherwise(F.lit(0.0)))
         / F.sum("_nb").cast("double")).alias(out))


def reliability_curve(df: DataFrame, group: Sequence[str] = GROUP, prob="p_hs",
                      label="label") -> DataFrame:
    """DOM13: fraction positive and mean prediction in non-empty (lo, hi] bins."""
    p = _c(prob)
    agg = df.groupBy(*group, _bin_case(p, False).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(_c(label).cast("double")).alias("prob_true"),
        F.avg(p).alias("prob_pred"))
    return agg.select(*group, "bin", "n", F.round("prob_true", 6).alias("prob_true"),
                      F.round("prob_pred", 6).alias("prob_pred"))


# ---------------------------------------------------------------- WIN6, DOM20-21

# Means over several models are compared to 12 decimals: the order in which an
# engine adds the terms can move the last bit, and exact ties would split.
TIE_DECIMALS = 12


def rank_key(df: DataFrame, prob: str = "p_hs") -> Column:
    """What rows are ranked by: ``l1 - l0`` where the logits are at hand (it
    orders like any temperature-scaled probability of the same row, does not
    saturate at 1.0, and its ties are ties of the data), else the unrounded
    probability."""
    return F.col("l1") - F.col("l0") if {"l0", "l1"} <= set(df.columns) else F.col(prob)


def _score_ties(df, group, prob, label):
    # + 0.0 makes -0.0 and 0.0 one group
    return df.groupBy(*group, (rank_key(df, prob) + F.lit(0.0)).alias("score")).agg(
        F.max(F.col(prob)).alias("prob"),
        F.count_if(_c(label) == 1).alias("npos"), F.count_if(_c(label) == 0).alias("nneg"))


def curve_points(df: DataFrame, group: Sequence[str] = GROUP, prob="p_hs",
                 label="label") -> DataFrame:
    """WIN6: cumulative TP / FP at every distinct score, descending.
    Ties are grouped first, so each score is one row; the running sums
    use range-partitioned prefix sums instead of a per-group window."""
    ties = _score_ties(df, group, prob, label)
    return prefix_sums(ties, group, [F.col("score").desc()], ["npos", "nneg"], prefix="cum_")


def roc_pr_curves(df: DataFrame, group: Sequence[str] = GROUP, prob="p_hs",
                  label="label") -> DataFrame:
    """DOM20 / DOM21 curves: one point per distinct threshold."""
    pts = curve_points(df, group, prob, label)
    tot = pts.groupBy(*group).agg(F.sum("npos").alias("P"), F.sum("nneg").alias("N"))
    j = pts.join(small_side(tot), list(group))
    tpr = F.when(F.col("P") > 0, F.col("cum_npos") / F.col("P"))
    fpr = F.when(F.col("N") > 0, F.col("cum_nneg") / F.col("N"))
    prec = F.col("cum_npos") / (F.col("cum_npos") + F.col("cum_nneg"))
    return j.select(*group, F.round("prob", 6).alias("threshold"),
                    F.col("cum_npos").alias("tp"), F.col("cum_nneg").alias("fp"),
                    F.round(tpr, 6).alias("tpr"), F.round(fpr, 6).alias("fpr"),
                    F.round(prec, 6).alias("precision"), F.round(tpr, 6).alias("recall"))


def _curve_areas() -> list[Column]:
    """Sums over curve points: twice the ROC area in pairs, and the AP terms."""
    return [F.sum(F.col("nneg") * (2 * F.col("cum_npos") - F.col("npos"))).alias("_auc2"),
            F.sum(F.col("npos").cast("double") * F.col("cum_npos")
                  / (F.col("cum_npos") + F.col("cum_nneg"))).alias("_ap")]


def _auc() -> Column:
    return F.when((F.col("P") > 0) & (F.col("N") > 0),
                  F.col("_auc2").cast("double") / (2.0 * F.col("P").cast("double") * F.col("N").cast("double")))


def _average_precision() -> Column:
    return F.when(F.col("P") > 0, F.col("_ap") / F.col("P").cast("double"))


def auc_ap(df: DataFrame, group: Sequence[str] = GROUP, prob="p_hs", label="label") -> DataFrame:
    """DOM20 ROC-AUC (trapezoids over tie groups, exact integer numerator)
    and DOM21 average precision sum((R_n - R_{n-1}) P_n); NULL for a
    single-class group."""
    pts = curve_points(df, group, prob, label)
    agg = pts.groupBy(*group).agg(F.sum("npos").alias("P"), F.sum("nneg").alias("N"), *_curve_areas())
    return agg.select(
        *group, "P", "N", _auc().alias("roc_auc"), _average_precision().alias("avg_precision"),
        (F.col("P").cast("double") / (F.col("P") + F.col("N")).cast("double")).alias("prevalence"))


# ---------------------------------------------------------------- DOM17, WIN3, WIN8

def performance_summary(df: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """DOM17: macro F1/P/R, ROC-AUC, AP, ECE, confidence stats per group.

    The scored rows are read once: rows of equal score (so of equal ``p_hs``)
    are folded into one with all counts that any of the metrics needs, and these
    ride through the running sums of the curves.  What remains are one
    aggregation per (group, probability bin) and one of these few rows.
    """
    group = list(group)
    ok, conf = F.col("correct"), F.col("confidence")
    counts = ("cnt", "tp", "fp", "tn", "fn", "n_ok", "sum_ok", "sum_wrong", "n_high")
    ties = df.groupBy(*group, (rank_key(df) + F.lit(0.0)).alias("score")).agg(
        F.max("p_hs").alias("prob"), F.count_if(F.col("label") == 1).alias("npos"),
        F.count_if(F.col("label") == 0).alias("nneg"), F.count(F.lit(1)).alias("cnt"), *confusion_aggs(),
        F.count_if(ok).alias("n_ok"), F.sum(F.when(ok, conf)).alias("sum_ok"),
        F.sum(F.when(~ok, conf)).alias("sum_wrong"), F.count_if(conf > HIGH_CONF).alias("n_high"))
    pts = prefix_sums(ties, group, [F.col("score").desc()], ["npos", "nneg"], prefix="cum_")
    cells = pts.groupBy(*group, _bin_case(F.col("prob"), True).alias("_bin")).agg(
        *[F.sum(c).alias(c) for c in counts], F.sum("npos").alias("P"), F.sum("nneg").alias("N"),
        F.sum(F.col("prob") * F.col("cnt")).alias("sp"), *_curve_areas())
    off = F.col("cnt").cast("double") * F.abs(F.col("P") / F.col("cnt") - F.col("sp") / F.col("cnt"))
    total = cells.groupBy(*group).agg(
        *[F.sum(c).alias(c) for c in (*counts, "P", "N", "_auc2", "_ap")],
        F.sum(F.when(F.col("_bin").isNotNull(), off).otherwise(F.lit(0.0))).alias("_off"))
    n, wrong = F.col("cnt").cast("double"), F.col("cnt") - F.col("n_ok")
    out = total.select(
        *group, F.col("cnt").alias("n"), *[v.alias(k) for k, v in macro_columns().items()], _auc().alias("roc_auc"),
        _average_precision().alias("avg_precision"), (F.col("_off") / n).alias("ece"),
        F.when(F.col("n_ok") > 0, F.col("sum_ok") / F.col("n_ok").cast("double")).alias("conf_correct"),
        F.when(wrong > 0, F.col("sum_wrong") / wrong.cast("double")).alias("conf_wrong"),
        F.round(F.col("n_high").cast("double") / n * 100.0, 6).alias("pct_conf_gt_90"))
    return out.select(
        *group, "n",
        *[F.round(k, 6).alias(k) for k in ("macro_f1", "macro_precision", "macro_recall",
                                             "roc_auc", "avg_precision", "ece",
                                             "conf_correct", "conf_wrong")],
        F.round(F.col("conf_correct") - F.col("conf_wrong"), 6).alias("conf_gap"), "pct_conf_gt_90")


def pick_best(per_model: DataFrame, by="dataset", metric="macro_f1", model="model") -> DataFrame:
    """WIN3 keeping all columns: one row per ``by`` of a small per-model table."""
    w = Window.partitionBy(by).orderBy(F.col(metric).desc(), F.col(model).asc())
    return per_model.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def best_model(summary: DataFrame, by="dataset", metric="macro_f1", model="model") -> DataFrame:
    """WIN3: the model with the highest metric per dataset (ties: model name)."""
    return pick_best(summary, by, metric, model).select(by, model, metric)


def best_model_of(df: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    cm = confusion(df, group)
    f1 = cm.select(*group, macro_columns()["macro_f1"].alias("macro_f1"))
    return best_model(f1)


def mark_extremes(summary: DataFrame, by="dataset",
                  maxima=("macro_f1", "conf_gap"), minima=("ece", "conf_wrong")) -> DataFrame:
    """WIN8: boolean best/worst markers per dataset (styling not built)."""
    w = Window.partitionBy(by)
    cols = [(F.col(c) == F.max(c).over(w)).alias(f"is_max_{c}") for c in maxima]
    cols += [(F.col(c) == F.min(c).over(w)).alias(f"is_min_{c}") for c in minima]
    return summary.select("*", *cols)


# ---------------------------------------------------------------- DOM18-19 sweep

def _sweep_bucket(conf: Column) -> Column:
    """Number of sweep thresholds <= conf (0..50)."""
    t = SWEEP_THRESHOLDS
    expr = F.when(conf >= F.lit(t[-1]), F.lit(len(t)))
    for j in range(len(t) - 1, 0, -1):
        expr = expr.when(conf >= F.lit(t[j - 1]), F.lit(j))
    return expr.otherwise(F.lit(0))


def selective_sweep(df: DataFrame, group: Sequence[str] = GROUP, conf="confidence",
                    label="label", pred="predicted") -> DataFrame:
    """DOM18 + DOM19: for each of the 50 sweep thresholds t, rows with
    conf >= t are retained: coverage, accuracy (NULL if none retained) and
    macro F1 (NULL under 10 retained).  One scan: rows are bucketed by how
    many thresholds they clear, then a reverse running sum over the 50
    buckets of each group (a tiny table) gives every threshold at once."""
    y, p = _c(label), _c(pred)
    bucketed = df.groupBy(*group, _sweep_bucket(_c(conf)).alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), *confusion_aggs(label, pred))
    totals = bucketed.groupBy(*group).agg(F.sum("_n").alias("n_total"))
    grid = totals.select(*group, "n_total",
                         F.explode(F.sequence(F.lit(1), F.lit(len(SWEEP_THRESHOLDS)))).alias("_j"))
    g = grid.join(bucketed.withColumnRenamed("_b", "_j"), [*group, "_j"], "left").na.fill(
        0, ["_n", "tp", "fp", "tn", "fn"])
    w = (Window.partitionBy(*group).orderBy(F.col("_j").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cum = g.select(*group, "_j", "n_total",
                   *[F.sum(c).over(w).alias(c) for c in ("_n", "tp", "fp", "tn", "fn")])
    m = macro_columns()
    thr = F.element_at(F.array(*[F.lit(t) for t in SWEEP_THRESHOLDS]), F.col("_j"))
    return cum.select(
        *group, F.col("_j").alias("step"), thr.alias("threshold"),
        F.col("_n").alias("n_retained"),
        F.round(F.col("_n").cast("double") / F.col("n_total").cast("double"), 6).alias("coverage"),
        F.round(F.when(F.col("_n") > 0, (F.col("tp") + F.col("tn")).cast("double")
                       / F.col("_n").cast("double")), 6).alias("accuracy"),
        F.round(F.when(F.col("_n") >= MIN_RETAINED_FOR_F1, m["macro_f1"]), 6).alias("macro_f1"))


# ---------------------------------------------------------------- DOM22-24 hand-off

def handoff_rates(df: DataFrame, group: Sequence[str] = GROUP, conf="confidence",
                  thresholds: Sequence[float] = HANDOFF_THRESHOLDS) -> DataFrame:
    """DOM22 (long form): % of rows with conf < t, one scan for all t."""
    cf = _c(conf)
    agg = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *[
        F.count_if(cf < F.lit(t)).alias(f"_r{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_r{i}").alias("n_routed"))
                     for i, t in enumerate(thresholds)])
    ex = agg.select(*group, "_n", F.explode(rows).alias("r"))
    return ex.select(*group, "r.threshold", "r.n_routed",
                     F.round(F.col("r.n_routed").cast("double") / F.col("_n").cast("double") * 100.0, 6)
                     .alias("pct_routed"))


def handoff_matrix(df: DataFrame, group: Sequence[str] = GROUP, conf="confidence",
                   thresholds: Sequence[float] = HANDOFF_THRESHOLDS) -> DataFrame:
    """DOM22 (pivoted): one row per threshold, one column per model/dataset."""
    long = handoff_rates(df, group, conf, thresholds)
    key = F.concat_ws("/", *[F.col(g) for g in group])
    # the column names are data: they come from the per-group table, written once
    small = materialize(long.withColumn("_k", key))
    names = sorted(r[0] for r in small.select("_k").distinct().collect())
    return small.groupBy("threshold").pivot("_k", names).agg(F.first("pct_routed"))


def handoff_composition(df: DataFrame, conf="confidence", label="label",
                        thresholds: Sequence[float] = HANDOFF_THRESHOLDS) -> DataFrame:
    """DOM23: among rows the best model (per dataset) routes at t: n, % HS,
    % non-HS; both shares 0 when nothing is routed."""
    cf, y = _c(conf), _c(label)
    # every model is counted in the one scan; the best is picked from the counts
    agg = df.groupBy("dataset", "model").agg(*confusion_aggs(label), *[
        F.struct(F.lit(t).alias("threshold"),
                 F.count_if(cf < F.lit(t)).alias("n_routed"),
                 F.count_if((cf < F.lit(t)) & (y == 1)).alias("n_hs")).alias(f"_t{i}")
        for i, t in enumerate(thresholds)])
    agg = pick_best(agg.withColumn("macro_f1", macro_columns()["macro_f1"]))
    ex = agg.select("dataset", "model", F.explode(F.array(*[F.col(f"_t{i}") for i in range(len(thresholds))])).alias("r"))
    n, hs = F.col("r.n_routed"), F.col("r.n_hs")
    return ex.select(
        "dataset", "model", "r.threshold", n.alias("n_routed"),
        F.round(F.when(n == 0, F.lit(0.0)).otherwise(hs.cast("double") / n.cast("double") * 100.0), 6).alias("pct_hs"),
        F.round(F.when(n == 0, F.lit(0.0)).otherwise((n - hs).cast("double") / n.cast("double") * 100.0), 6).alias("pct_non_hs"))


def route(df: DataFrame, threshold: float = 0.90, conf="confidence_cal") -> DataFrame:
    """DOM24: conf >= t keeps the prediction; below it, or without a (calibrated)
    confidence, the row goes to the retrieval branch."""
    return df.withColumn("route", F.when(_c(conf) >= F.lit(threshold), F.lit("keep"))
                         .otherwise(F.lit("rag")))


# ---------------------------------------------------------------- AGG14 box summary

QUADRANTS = ("TN", "FP", "TP", "FN")


def box_summary(df: DataFrame, by="dataset", conf="confidence") -> DataFrame:
    """AGG14: n, quartiles and 1.5*IQR whiskers of confidence per outcome
    quadrant, pooled across models; all four quadrants appear (n = 0)."""
    from tessera.functions.scoring import quadrant
    q = df.select(by, quadrant().alias("quadrant"), F.col(conf).alias("_v"))
    qs = exact_quantiles(q, [by, "quadrant"], "_v", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    bounds = qs.select(by, "quadrant", "q1", "median", "q3",
                       (F.col("q1") - 1.5 * iqr).alias("_lo"), (F.col("q3") + 1.5 * iqr).alias("_hi"))
    bounds = small_side(bounds)
    wh = q.join(bounds, [by, "quadrant"]).groupBy(by, "quadrant").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(F.col("_v") <= F.col("_hi"), F.col("_v"))).alias("whisker_hi"))
    stats = bounds.join(wh, [by, "quadrant"])
    grid = (df.select(by).distinct()
              .select(by, F.explode(F.array(*[F.lit(x) for x in QUADRANTS])).alias("quadrant")))
    out = grid.join(stats, [by, "quadrant"], "left")
    return out.select(by, "quadrant", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                      *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")])
