"""Registered queries over the scored table: metrics, calibration, sweep,
hand-off (SCL22-25, AGG1, AGG8-14, WIN3, WIN6-8, DOM12-13, DOM17-23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import statistics as ST
from tessera.plans.fixtures import scored
from tessera.plans.sql import (CONFUSION_SQL, ece_bin_sql, handoff_values, macro_sql,
                               reliability_bin_sql, sweep_bucket_sql, sweep_values, with_scored)
from tessera.session import materialize

G = ["model", "dataset"]
QUERIES: dict = {}
SQL: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# --- SCL22-SCL25: the scored table itself -----------------------------------
@register("scl22_scored_logits", with_scored() + """
SELECT model, dataset, ex_id, label, orig_class, round(l0, 6) AS l0, round(l1, 6) AS l1,
       round(p_hs, 6) AS p_hs, round(confidence, 6) AS confidence, predicted, correct,
       round(l1 - l0, 6) AS log_odds,
       CASE WHEN label = 0 AND predicted = 0 THEN 'TN' WHEN label = 0 AND predicted = 1 THEN 'FP'
            WHEN label = 1 AND predicted = 1 THEN 'TP' ELSE 'FN' END AS quadrant
FROM scored""")
def q_scored(spark, sf_dir):
    from tessera.functions.scoring import log_odds, quadrant
    s = scored(spark, sf_dir)
    return s.select("model", "dataset", "ex_id", "label", "orig_class",
                    F.round("l0", 6).alias("l0"), F.round("l1", 6).alias("l1"),
                    F.round("p_hs", 6).alias("p_hs"), F.round("confidence", 6).alias("confidence"),
                    "predicted", "correct", F.round(log_odds(), 6).alias("log_odds"),
                    quadrant().alias("quadrant"))


# --- AGG1 ------------------------------------------------------------------
@register("agg1_class_distribution", with_scored() + """
SELECT dataset, label, count(*) AS n FROM scored WHERE model = 'm0' GROUP BY dataset, label""")
def q_class_dist(spark, sf_dir):
    s = scored(spark, sf_dir).where(F.col("model") == "m0")
    return M.class_distribution(s, ["dataset"])


# --- AGG8 / AGG9 -----------------------------------------------------------
_mac = macro_sql()
@register("agg9_macro_prf", with_scored(f"""
cm AS (SELECT model, dataset, {CONFUSION_SQL} FROM scored GROUP BY model, dataset)""") + f"""
SELECT model, dataset, tp, fp, tn, fn,
       round({_mac['macro_precision']}, 6) AS macro_precision,
       round({_mac['macro_recall']}, 6) AS macro_recall,
       round({_mac['macro_f1']}, 6) AS macro_f1
FROM cm""")
def q_macro(spark, sf_dir):
    return M.macro_prf(scored(spark, sf_dir))


def _div0(n, d):
    return f"(CASE WHEN ({d}) = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END)"


@register("agg10_classification_report", with_scored(f"""
cm AS (SELECT model, dataset, {CONFUSION_SQL} FROM scored GROUP BY model, dataset),
r AS (
  SELECT model, dataset, '0' AS class, {_div0('tn', 'tn + fn')} AS precision, {_div0('tn', 'tn + fp')} AS recall,
         {_div0('2 * tn', '2 * tn + fn + fp')} AS f1, tn + fp AS support, (tn + fp + tn + fn) > 0 AS keep FROM cm
  UNION ALL
  SELECT model, dataset, '1', {_div0('tp', 'tp + fp')}, {_div0('tp', 'tp + fn')},
         {_div0('2 * tp', '2 * tp + fp + fn')}, tp + fn, (tp + fn + tp + fp) > 0 FROM cm
  UNION ALL
  SELECT model, dataset, 'accuracy', NULL, NULL, {_div0('tp + tn', 'tp + fp + tn + fn')}, tp + fp + tn + fn, TRUE FROM cm
  UNION ALL
  SELECT model, dataset, 'macro avg', {_mac['macro_precision']}, {_mac['macro_recall']}, {_mac['macro_f1']},
         tp + fp + tn + fn, TRUE FROM cm
  UNION ALL
  SELECT model, dataset, 'weighted avg',
         {_div0(f"{_div0('tn', 'tn + fn')} * CAST(tn + fp AS DOUBLE) + {_div0('tp', 'tp + fp')} * CAST(tp + fn AS DOUBLE)", 'tp + fp + tn + fn')},
         {_div0(f"{_div0('tn', 'tn + fp')} * CAST(tn + fp AS DOUBLE) + {_div0('tp', 'tp + fn')} * CAST(tp + fn AS DOUBLE)", 'tp + fp + tn + fn')},
         {_div0(f"{_div0('2 * tn', '2 * tn + fn + fp')} * CAST(tn + fp AS DOUBLE) + {_div0('2 * tp', '2 * tp + fp + fn')} * CAST(tp + fn AS DOUBLE)", 'tp + fp + tn + fn')},
         tp + fp + tn + fn, TRUE FROM cm
)""") + """
SELECT model, dataset, class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support
FROM r WHERE keep""")
def q_report(spark, sf_dir):
    return M.classification_report(scored(spark, sf_dir))


# --- AGG11 / AGG12 ---------------------------------------------------------
@register("agg11_confidence_stats", with_scored() + """
SELECT model, dataset, count(*) AS n, round(avg(confidence), 6) AS conf_mean,
       round(avg(confidence) FILTER (WHERE correct), 6) AS conf_correct,
       round(avg(confidence) FILTER (WHERE NOT correct), 6) AS conf_wrong,
       round(avg(confidence) FILTER (WHERE correct) - avg(confidence) FILTER (WHERE NOT correct), 6) AS conf_gap,
       round(CAST(count(*) FILTER (WHERE confidence > CAST('0.9' AS DOUBLE)) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0, 6) AS pct_conf_gt_90
FROM scored GROUP BY model, dataset""")
def q_conf_stats(spark, sf_dir):
    return M.confidence_stats(scored(spark, sf_dir))


# --- AGG13 / DOM29 ---------------------------------------------------------
@register("agg13_per_class_accuracy", with_scored() + """
SELECT model, dataset, orig_class, count(*) AS n,
       round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, round(avg(confidence), 6) AS conf_mean
FROM scored WHERE orig_class IS NOT NULL GROUP BY model, dataset, orig_class""")
def q_per_class(spark, sf_dir):
    return M.per_class_accuracy(scored(spark, sf_dir))


# --- DOM12 ECE ---------------------------------------------------------------
@register("dom12_ece", with_scored(f"""
bins AS (SELECT model, dataset, {ece_bin_sql('p_hs')} AS bin, count(*) AS nb,
                sum(CAST(label AS DOUBLE)) AS sy, sum(p_hs) AS sp
         FROM scored GROUP BY ALL)""") + """
SELECT model, dataset,
       round(sum(CASE WHEN bin IS NOT NULL THEN CAST(nb AS DOUBLE) * abs(sy / nb - sp / nb) ELSE CAST(0.0 AS DOUBLE) END)
             / CAST(sum(nb) AS DOUBLE), 6) AS ece
FROM bins GROUP BY model, dataset""")
def q_ece(spark, sf_dir):
    e = M.ece(scored(spark, sf_dir))
    return e.select(*G, F.round("ece", 6).alias("ece"))


# --- DOM13 reliability -----------------------------------------------------
@register("dom13_reliability_curve", with_scored() + f"""
SELECT model, dataset, {reliability_bin_sql('p_hs')} AS bin, count(*) AS n,
       round(avg(CAST(label AS DOUBLE)), 6) AS prob_true, round(avg(p_hs), 6) AS prob_pred
FROM scored GROUP BY ALL""")
def q_reliability(spark, sf_dir):
    return M.reliability_curve(scored(spark, sf_dir))


_TIES = """
ties AS (SELECT model, dataset, l1 - l0 + CAST(0.0 AS DOUBLE) AS score, max(p_hs) AS prob, count(*) FILTER (WHERE label = 1) AS npos,
                count(*) FILTER (WHERE label = 0) AS nneg FROM scored GROUP BY ALL),
cum AS (SELECT *, sum(npos) OVER w AS cum_npos, sum(nneg) OVER w AS cum_nneg FROM ties
        WINDOW w AS (PARTITION BY model, dataset ORDER BY score DESC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tot AS (SELECT model, dataset, sum(npos) AS P, sum(nneg) AS N FROM ties GROUP BY ALL)"""


# --- WIN6 / DOM20 / DOM21 curves -------------------------------------------
@register("dom20_roc_pr_curve", with_scored(_TIES) + """
SELECT c.model, c.dataset, round(prob, 6) AS threshold, CAST(cum_npos AS BIGINT) AS tp,
       CAST(cum_nneg AS BIGINT) AS fp,
       round(CASE WHEN P > 0 THEN cum_npos / P END, 6) AS tpr,
       round(CASE WHEN N > 0 THEN cum_nneg / N END, 6) AS fpr,
       round(cum_npos / (cum_npos + cum_nneg), 6) AS precision,
       round(CASE WHEN P > 0 THEN cum_npos / P END, 6) AS recall
FROM cum c JOIN tot t ON c.model = t.model AND c.dataset = t.dataset""")
def q_curves(spark, sf_dir):
    return M.roc_pr_curves(scored(spark, sf_dir))


@register("dom21_auc_ap", with_scored(_TIES) + """
SELECT model, dataset, CAST(sum(npos) AS BIGINT) AS P, CAST(sum(nneg) AS BIGINT) AS N,
       round(CASE WHEN sum(npos) > 0 AND sum(nneg) > 0 THEN
             CAST(sum(nneg * (2 * cum_npos - npos)) AS DOUBLE) / (2.0 * CAST(sum(npos) AS DOUBLE) * CAST(sum(nneg) AS DOUBLE)) END, 6) AS roc_auc,
       round(CASE WHEN sum(npos) > 0 THEN sum(CAST(npos AS DOUBLE) * cum_npos / (cum_npos + cum_nneg)) / CAST(sum(npos) AS DOUBLE) END, 6) AS avg_precision,
       round(CAST(sum(npos) AS DOUBLE) / CAST(sum(npos) + sum(nneg) AS DOUBLE), 6) AS prevalence
FROM cum GROUP BY model, dataset""")
def q_auc(spark, sf_dir):
    a = M.auc_ap(scored(spark, sf_dir))
    return a.select(*G, "P", "N", *[F.round(c, 6).alias(c) for c in ("roc_auc", "avg_precision", "prevalence")])


# --- DOM17 summary, WIN3 best model, WIN8 markers --------------------------
_SUMMARY_CTES = _TIES + f""",
aa AS (SELECT model, dataset,
         CASE WHEN sum(npos) > 0 AND sum(nneg) > 0 THEN
           CAST(sum(nneg * (2 * cum_npos - npos)) AS DOUBLE) / (2.0 * CAST(sum(npos) AS DOUBLE) * CAST(sum(nneg) AS DOUBLE)) END AS roc_auc,
         CASE WHEN sum(npos) > 0 THEN sum(CAST(npos AS DOUBLE) * cum_npos / (cum_npos + cum_nneg)) / CAST(sum(npos) AS DOUBLE) END AS avg_precision
       FROM cum GROUP BY model, dataset),
bins AS (SELECT model, dataset, {ece_bin_sql('p_hs')} AS bin, count(*) AS nb,
                sum(CAST(label AS DOUBLE)) AS sy, sum(p_hs) AS sp FROM scored GROUP BY ALL),
ec AS (SELECT model, dataset,
         sum(CASE WHEN bin IS NOT NULL THEN CAST(nb AS DOUBLE) * abs(sy / nb - sp / nb) ELSE CAST(0.0 AS DOUBLE) END)
           / CAST(sum(nb) AS DOUBLE) AS ece FROM bins GROUP BY model, dataset),
cm AS (SELECT model, dataset, {CONFUSION_SQL}, count(*) AS n,
         avg(confidence) FILTER (WHERE correct) AS conf_correct,
         avg(confidence) FILTER (WHERE NOT correct) AS conf_wrong,
         count(*) FILTER (WHERE confidence > CAST('0.9' AS DOUBLE)) AS hi
       FROM scored GROUP BY model, dataset),
summary AS (
  SELECT cm.model, cm.dataset, n,
         round({_mac['macro_f1']}, 6) AS macro_f1, round({_mac['macro_precision']}, 6) AS macro_precision,
         round({_mac['macro_recall']}, 6) AS macro_recall, round(roc_auc, 6) AS roc_auc,
         round(avg_precision, 6) AS avg_precision, round(ece, 6) AS ece,
         round(conf_correct, 6) AS conf_correct, round(conf_wrong, 6) AS conf_wrong,
         round(conf_correct - conf_wrong, 6) AS conf_gap,
         round(CAST(hi AS DOUBLE) / CAST(n AS DOUBLE) * 100.0, 6) AS pct_conf_gt_90,
         {_mac['macro_f1']} AS f1_exact
  FROM cm JOIN aa ON cm.model = aa.model AND cm.dataset = aa.dataset
          JOIN ec ON cm.model = ec.model AND cm.dataset = ec.dataset)"""

@register("dom17_performance_summary", with_scored(_SUMMARY_CTES) + """
SELECT * EXCLUDE (f1_exact) FROM summary""")
def q_summary(spark, sf_dir):
    return M.performance_summary(scored(spark, sf_dir))


@register("win3_best_model", with_scored(f"""
cm AS (SELECT model, dataset, {CONFUSION_SQL} FROM scored GROUP BY model, dataset),
f AS (SELECT model, dataset, {_mac['macro_f1']} AS macro_f1 FROM cm),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY macro_f1 DESC, model ASC) AS rn FROM f)""") + """
SELECT dataset, model, round(macro_f1, 6) AS macro_f1 FROM r WHERE rn = 1""")
def q_best(spark, sf_dir):
    b = M.best_model_of(scored(spark, sf_dir))
    return b.select("dataset", "model", F.round("macro_f1", 6).alias("macro_f1"))


@register("win8_summary_markers", with_scored(_SUMMARY_CTES) + """
SELECT model, dataset, macro_f1, conf_gap, ece, conf_wrong,
       macro_f1 = max(macro_f1) OVER (PARTITION BY dataset) AS is_max_macro_f1,
       conf_gap = max(conf_gap) OVER (PARTITION BY dataset) AS is_max_conf_gap,
       ece = min(ece) OVER (PARTITION BY dataset) AS is_min_ece,
       conf_wrong = min(conf_wrong) OVER (PARTITION BY dataset) AS is_min_conf_wrong
FROM summary""")
def q_markers(spark, sf_dir):
    s = M.performance_summary(scored(spark, sf_dir))
    s = s.select(*G, "macro_f1", "conf_gap", "ece", "conf_wrong")
    return M.mark_extremes(s)


# --- DOM18 / DOM19 selective prediction sweep --------------------------------
def _sweep_sql(conf: str, source: str = "scored") -> str:
    return f"""
b AS (SELECT model, dataset, {sweep_bucket_sql(conf)} AS bk, count(*) AS n,
             count(*) FILTER (WHERE label = 1 AND predicted = 1) AS tp,
             count(*) FILTER (WHERE label = 0 AND predicted = 1) AS fp,
             count(*) FILTER (WHERE label = 0 AND predicted = 0) AS tn,
             count(*) FILTER (WHERE label = 1 AND predicted = 0) AS fn
      FROM {source} GROUP BY ALL),
g AS (SELECT model, dataset, sum(n) AS n_total FROM b GROUP BY ALL),
c AS (SELECT g.model, g.dataset, sw.step, sw.threshold, g.n_total,
             coalesce(sum(b.n), 0) AS n, coalesce(sum(b.tp), 0) AS tp, coalesce(sum(b.fp), 0) AS fp,
             coalesce(sum(b.tn), 0) AS tn, coalesce(sum(b.fn), 0) AS fn
      FROM g CROSS JOIN {sweep_values()}
      LEFT JOIN b ON b.model = g.model AND b.dataset = g.dataset AND b.bk >= sw.step
      GROUP BY ALL)"""


def _sweep_select() -> str:
    return f"""
SELECT model, dataset, CAST(step AS INTEGER) AS step, threshold, CAST(n AS BIGINT) AS n_retained,
       round(CAST(n AS DOUBLE) / CAST(n_total AS DOUBLE), 6) AS coverage,
       round(CASE WHEN n > 0 THEN CAST(tp + tn AS DOUBLE) / CAST(n AS DOUBLE) END, 6) AS accuracy,
       round(CASE WHEN n >= 10 THEN {_mac['macro_f1']} END, 6) AS macro_f1
FROM c"""


@register("dom18_selective_sweep", with_scored(_sweep_sql("confidence")) + _sweep_select())
def q_sweep(spark, sf_dir):
    return M.selective_sweep(scored(spark, sf_dir))


# --- DOM22 / DOM23 hand-off ----------------------------------------------------
@register("dom22_handoff_rates", with_scored() + f"""
SELECT s.model, s.dataset, t.threshold, count(*) FILTER (WHERE s.confidence < t.threshold) AS n_routed,
       round(CAST(count(*) FILTER (WHERE s.confidence < t.threshold) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0, 6) AS pct_routed
FROM scored s CROSS JOIN {handoff_values()}
GROUP BY s.model, s.dataset, t.threshold""")
def q_handoff(spark, sf_dir):
    return M.handoff_rates(scored(spark, sf_dir))


def _pivot_cols():
    from tessera.plans.fixtures import DATASETS, MODELS
    return [f"{m}/{d}" for m in MODELS for d in DATASETS]


@register("dom22_handoff_matrix", with_scored(f"""
h AS (SELECT s.model || '/' || s.dataset AS k, t.threshold,
             round(CAST(count(*) FILTER (WHERE s.confidence < t.threshold) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0, 6) AS pct
      FROM scored s CROSS JOIN {handoff_values()} GROUP BY ALL)""") + """
SELECT threshold, """ + ", ".join(
    f"first(pct) FILTER (WHERE k = '{k}') AS \"{k}\"" for k in _pivot_cols()) + """
FROM h GROUP BY threshold""")
def q_handoff_matrix(spark, sf_dir):
    return M.handoff_matrix(scored(spark, sf_dir))


@register("dom23_handoff_composition", with_scored(f"""
cm AS (SELECT model, dataset, {CONFUSION_SQL} FROM scored GROUP BY model, dataset),
f AS (SELECT model, dataset, {_mac['macro_f1']} AS macro_f1 FROM cm),
best AS (SELECT model, dataset FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY macro_f1 DESC, model ASC) AS rn FROM f) WHERE rn = 1),
r AS (SELECT s.dataset, s.model, t.threshold,
             count(*) FILTER (WHERE s.confidence < t.threshold) AS n,
             count(*) FILTER (WHERE s.confidence < t.threshold AND s.label = 1) AS hs
      FROM scored s JOIN best USING (dataset, model) CROSS JOIN {handoff_values()} GROUP BY ALL)""") + """
SELECT dataset, model, threshold, n AS n_routed,
       round(CASE WHEN n = 0 THEN 0.0 ELSE CAST(hs AS DOUBLE) / CAST(n AS DOUBLE) * 100.0 END, 6) AS pct_hs,
       round(CASE WHEN n = 0 THEN 0.0 ELSE CAST(n - hs AS DOUBLE) / CAST(n AS DOUBLE) * 100.0 END, 6) AS pct_non_hs
FROM r""")
def q_handoff_comp(spark, sf_dir):
    return M.handoff_composition(scored(spark, sf_dir))


# --- AGG14 box summary ------------------------------------------------------
@register("agg14_box_summary", with_scored("""
q AS (SELECT dataset, CASE WHEN label = 0 AND predicted = 0 THEN 'TN' WHEN label = 0 AND predicted = 1 THEN 'FP'
                           WHEN label = 1 AND predicted = 1 THEN 'TP' ELSE 'FN' END AS quadrant,
             confidence AS v FROM scored),
st AS (SELECT dataset, quadrant, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
              quantile_cont(v, 0.75) AS q3 FROM q GROUP BY ALL),
wh AS (SELECT q.dataset, q.quadrant, min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
              max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)) AS whisker_hi
       FROM q JOIN st USING (dataset, quadrant) GROUP BY ALL),
grid AS (SELECT DISTINCT dataset, quadrant FROM scored CROSS JOIN (VALUES ('TN'), ('FP'), ('TP'), ('FN')) AS x(quadrant))""") + """
SELECT grid.dataset, grid.quadrant, CAST(coalesce(st.n, 0) AS BIGINT) AS n, round(q1, 6) AS q1, round(median, 6) AS median,
       round(q3, 6) AS q3, round(whisker_lo, 6) AS whisker_lo, round(whisker_hi, 6) AS whisker_hi
FROM grid LEFT JOIN st USING (dataset, quadrant) LEFT JOIN wh USING (dataset, quadrant)""")
def q_box(spark, sf_dir):
    return M.box_summary(scored(spark, sf_dir))


# --- DOM18 / DOM22 from statistics of two parts of the rows, merged -------------------
def _merged(spark, sf_dir):
    s = scored(spark, sf_dir)
    return materialize(ST.merge([ST.statistics(s.where(f"ex_id % 2 = {k}")) for k in (0, 1)]))


@register("dom18_sweep_of_merged_statistics", with_scored(_sweep_sql("confidence")) + _sweep_select())
def q_merged_sweep(spark, sf_dir):
    return ST.sweep_of(_merged(spark, sf_dir))


@register("dom22_rates_of_merged_statistics", SQL["dom22_handoff_rates"])
def q_merged_rates(spark, sf_dir):
    return ST.handoff_of(_merged(spark, sf_dir))


@register("dom17_bounded_part_of_merged_statistics", with_scored(_SUMMARY_CTES) + """
SELECT model, dataset, n, macro_f1, macro_precision, macro_recall, ece, conf_correct, conf_wrong, pct_conf_gt_90 FROM summary""")
def q_merged_summary(spark, sf_dir):
    out = ST.summary_of(_merged(spark, sf_dir))
    share = F.col("n_high").cast("double") / F.col("n").cast("double") * 100.0
    return out.select(*G, "n", *[F.round(c, 6).alias(c) for c in (
        "macro_f1", "macro_precision", "macro_recall", "ece", "conf_correct", "conf_wrong")],
        F.round(share, 6).alias("pct_conf_gt_90"))
