"""Hand tables for the edge rules of the analysis operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.scoring import with_scores
from tessera.operators import errors as ER
from tessera.operators import metrics as M
from tessera.operators import statistics as ST


def _scored(spark, rows):
    """rows: (model, dataset, ex_id, label, l0, l1)."""
    full = [tuple(r) + ("some words here", "not_hate") for r in rows]
    df = spark.createDataFrame(full, "model string, dataset string, ex_id long, label int, l0 double, "
                                     "l1 double, text string, orig_class string")
    return with_scores(df)


def _logit_for(p):
    """l1 - l0 giving P(HS) = p."""
    return math.log(p / (1 - p))


def test_ece_edges_literal_bins(spark):
    # p = 0.7 sits in bin 6 because edge 7 is 0.7000000000000001; p = 1.0 in no bin.
    ps = [0.0001, 0.1, 0.3, 0.6, 0.7, 0.999]
    rows = [("m", "d", i, i % 2, 0.0, _logit_for(p)) for i, p in enumerate(ps)]
    df = _scored(spark, rows)
    # Replace p_hs with exact values to test binning alone.
    exact = spark.createDataFrame([(i, p) for i, p in enumerate(ps + [1.0])], "ex_id long, p double")
    lab = spark.createDataFrame([(i, i % 2) for i in range(7)], "ex_id long, label int")
    t = exact.join(lab, "ex_id").withColumn("model", F.lit("m")).withColumn("dataset", F.lit("d"))
    got = M.ece(t, prob="p").first()["ece"]
    edges = np.linspace(0, 1, 11)
    y = np.array([i % 2 for i in range(7)], dtype=float)
    p = np.array(ps + [1.0])
    exp = 0.0
    for i in range(10):
        m = (p >= edges[i]) & (p < edges[i + 1])
        if m.sum():
            exp += m.sum() / len(y) * abs(y[m].mean() - p[m].mean())
    assert got == pytest.approx(exp, abs=1e-12)
    assert df.count() == 6


def test_reliability_bins_right_closed(spark):
    t = spark.createDataFrame([(0.0, 0), (0.1, 1), (0.7, 1), (1.0, 1)], "p double, label int") \
        .withColumn("model", F.lit("m")).withColumn("dataset", F.lit("d"))
    bins = {r["bin"]: r["n"] for r in M.reliability_curve(t, prob="p").collect()}
    # sklearn: searchsorted(edges[1:-1], p, 'left') -> 0.0 -> 0, 0.1 -> 0, 0.7 -> 6, 1.0 -> 9
    assert bins == {0: 2, 6: 1, 9: 1}


def test_argmax_tie_goes_to_class_zero(spark):
    df = _scored(spark, [("m", "d", 1, 1, 0.5, 0.5)])
    r = df.first()
    assert r["predicted"] == 0 and r["confidence"] == 0.5 and r["correct"] is False


def test_confidence_edges_strict_and_inclusive(spark):
    rows = [("m", "d", i, 1, 0.0, _logit_for(c)) for i, c in enumerate([0.6, 0.9, 0.95])]
    df = _scored(spark, rows).withColumn("confidence", F.col("confidence"))
    exact = df.withColumn("confidence", F.element_at(F.array(F.lit(0.6), F.lit(0.9), F.lit(0.95)),
                                                     (F.col("ex_id") + 1).cast("int")))
    h = {(r["threshold"]): r["n_routed"] for r in M.handoff_rates(exact).collect()}
    assert h[0.6] == 0 and h[0.9] == 1 and h[0.95] == 2      # conf < t
    s = M.confidence_stats(exact).first()
    assert s["pct_conf_gt_90"] == pytest.approx(100.0 / 3, abs=1e-6)  # strict > 0.9


def test_one_class_group(spark):
    rows = [("m", "d", i, 0, 1.0, -1.0) for i in range(5)]
    df = _scored(spark, rows)
    s = M.performance_summary(df).first()
    assert s["macro_f1"] == 1.0 and s["roc_auc"] is None and s["conf_wrong"] is None


def test_sweep_f1_needs_ten_rows_accuracy_does_not(spark):
    rows = [("m", "d", i, i % 2, 0.0, 3.0 if i % 2 else -3.0) for i in range(9)]
    sw = M.selective_sweep(_scored(spark, rows)).where(F.col("step") == 1).first()
    assert sw["n_retained"] == 9 and sw["accuracy"] == 1.0 and sw["macro_f1"] is None
    last = M.selective_sweep(_scored(spark, rows)).where(F.col("step") == 50).first()
    assert last["n_retained"] == 0 and last["accuracy"] is None and last["coverage"] == 0.0


def test_auc_ap_with_ties_match_brute_force(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 200)
    z = np.round(rng.normal(size=200), 1)           # many ties
    rows = [("m", "d", i, int(y[i]), 0.0, float(z[i])) for i in range(200)]
    got = M.auc_ap(_scored(spark, rows)).first()
    p = 1 / (1 + np.exp(-z))
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-12)
    order = np.unique(p)[::-1]
    ap, prev_r = 0.0, 0.0
    for t in order:
        sel = p >= t
        tp = (y[sel] == 1).sum()
        r, prec = tp / (y == 1).sum(), tp / sel.sum()
        ap += (r - prev_r) * prec
        prev_r = r
    assert got["avg_precision"] == pytest.approx(ap, abs=1e-12)


def test_handoff_plus_coverage_is_one(spark):
    rng = np.random.default_rng(3)
    rows = [("m", "d", i, int(rng.integers(0, 2)), 0.0, float(rng.normal() * 2)) for i in range(300)]
    df = _scored(spark, rows)
    for t in (0.6, 0.7, 0.8, 0.9):
        routed = df.where(F.col("confidence") < t).count()
        kept = df.where(F.col("confidence") >= t).count()
        assert routed + kept == 300


def test_three_models_overlap_regions_and_agreement(spark):
    # 8 examples, one per wrong/right pattern of three models; label 1.
    rows = []
    for ex in range(8):
        for mi, m in enumerate(("m0", "m1", "m2")):
            wrong = (ex >> mi) & 1
            rows.append((m, "d0", ex, 1, 1.0 if wrong else -1.0, -1.0 if wrong else 1.0))
    df = _scored(spark, rows)
    ov = {r["region"]: r["n_errors"] for r in ER.error_overlap(df).collect()}
    assert ov == {"only m0": 1, "only m1": 1, "only m2": 1, "m0+m1": 1, "m0+m2": 1, "m1+m2": 1, "all 3": 1}
    assert sum(ov.values()) == 7
    ag = {(r["model_a"], r["model_b"]): r["agreement"] for r in ER.agreement_matrix(df).collect()}
    assert ag[("m0", "m0")] == 1.0 and ag[("m0", "m1")] == ag[("m1", "m0")] == 0.5
    cons = ER.consensus_failures(df).first()
    assert cons["n_consensus"] == 1


def test_box_summary_keeps_empty_quadrants(spark):
    rows = [("m", "d", i, 1, 0.0, 2.0 + i / 10) for i in range(5)]
    b = {r["quadrant"]: r for r in M.box_summary(_scored(spark, rows)).collect()}
    assert set(b) == {"TN", "FP", "TP", "FN"}
    assert b["TP"]["n"] == 5 and b["FN"]["n"] == 0 and b["FN"]["median"] is None


def test_coverage_monotone_and_partition_independent(spark):
    from tessera.plans.fixtures import scored
    from .conftest import SF001
    s = scored(spark, SF001)
    sw = M.selective_sweep(s).orderBy("model", "dataset", "step").collect()
    by = {}
    for r in sw:
        by.setdefault((r["model"], r["dataset"]), []).append(r["coverage"])
    assert all(all(a >= b for a, b in zip(c, c[1:])) for c in by.values())
    one = sorted(tuple(r) for r in M.performance_summary(s.repartition(1)).collect())
    many = sorted(tuple(r) for r in M.performance_summary(s.repartition(7)).collect())
    assert one == many


def test_saturated_scores_keep_their_order(spark):
    # p is 1.0 to 12 decimals for all four rows; the logits still rank them
    rows = [("m", "d", i, y, 0.0, z) for i, (z, y) in enumerate([(31.0, 1), (30.4, 0), (29.6, 1), (29.0, 0)])]
    assert M.auc_ap(_scored(spark, rows)).first()["roc_auc"] == 0.75
    assert M.roc_pr_curves(_scored(spark, rows)).count() == 4


def test_any_models_and_any_number(spark):
    names = ["alpha", "beta", "gamma", "delta"]
    rows = []
    for ex in range(16):
        for mi, m in enumerate(sorted(names)):
            wrong = (ex >> mi) & 1
            rows.append((m, "d0", ex, 1, 1.0 if wrong else -1.0, -1.0 if wrong else 1.0))
    df = _scored(spark, rows + rows[:7])          # repeated rows change no mask
    ov = {r["region"]: r["n_errors"] for r in ER.error_overlap(df).collect()}
    assert len(ov) == 15 and set(ov.values()) == {1} and "all 4" in ov and "alpha+beta" in ov
    assert ER.consensus_failures(df).first()["n_consensus"] == 1
    assert ER.findings(df).count() == 4 and ER.agreement_matrix(df).count() == 16
    some = {r["region"] for r in ER.error_overlap(df, ["alpha", "beta"]).collect()}
    assert some == {"only alpha", "only beta", "all 2"}


def test_missing_temperature_keeps_rows(spark):
    from tessera.operators import calibration as C
    df = _scored(spark, [("m", "d", i, 1, 0.0, 1.0) for i in range(3)] + [("n", "d", i, 1, 0.0, 9.0) for i in range(2)])
    temps = spark.createDataFrame([("m", "d", 2.0)], "model string, dataset string, T double")
    cal = C.apply_temperature(df, temps)
    assert cal.count() == 5 and cal.where("T is null and p_hs_cal is null").count() == 2
    assert [tuple(r) for r in C.missing_temperatures(df, temps).collect()] == [("n", "d", 2)]
    assert M.route(cal).where("model = 'n' and route = 'rag'").count() == 2
    t = {r["model"]: r for r in C.calibration_table(cal).collect()}
    assert t["n"]["T"] is None and t["n"]["ece_cal"] is None and t["n"]["ece_raw"] is not None


def test_models_that_scored_a_part_of_the_examples(spark):
    """Absence is no prediction: agreement is out of shared examples, and a
    consensus failure is out of the examples that all models have scored."""
    rows = [("a", "d", 1, 1, 0.0, 1.0), ("b", "d", 1, 1, 0.0, 2.0),            # both positive
            ("a", "d", 2, 1, 0.0, 1.0), ("a", "d", 3, 1, 1.0, 0.0),            # only a
            ("b", "d", 4, 0, 0.0, 1.0), ("c", "d", 5, 0, 1.0, 0.0),            # only b, only c
            ("a", "d", 6, 1, 1.0, 0.0), ("b", "d", 6, 1, 1.0, 0.0), ("c", "d", 6, 1, 1.0, 0.0)]
    df = _scored(spark, rows)
    got = {(r["model_a"], r["model_b"]): r["agreement"] for r in ER.agreement_matrix(df.where("model <> 'c'")).collect()}
    assert got == {(x, y): 1.0 for x in "ab" for y in "ab"}
    apart = {(r["model_a"], r["model_b"]): r["agreement"] for r in ER.agreement_matrix(df.where("ex_id < 6")).collect()}
    assert apart["a", "c"] is None and apart["c", "c"] == 1.0
    c = ER.consensus_failures(df).first()
    assert (c["n_examples"], c["n_consensus"], c["pct_consensus"]) == (1, 1, 100.0)


def test_error_overlap_lists_or_refuses_empty_regions(spark):
    df = _scored(spark, [(f"m{k}", "d", 1, 1, 1.0, 0.0) for k in range(3)])
    assert ER.error_overlap(df).count() == 7
    assert [tuple(r) for r in ER.error_overlap(df, with_empty=False).collect()] == [("d", "all 3", 7, 1)]
    many = _scored(spark, [(f"m{k:02}", "d", 1, 1, 1.0, 0.0) for k in range(17)])
    with pytest.raises(ValueError, match="regions"):
        ER.error_overlap(many)
    assert ER.error_overlap(many, with_empty=False).count() == 1


def test_statistics_merge_and_agree_with_the_scans(spark):
    """Reports from merged statistics equal those from the rows, also where a
    confidence stands on a limit."""
    rng = np.random.default_rng(4)
    rows = [(f"m{i % 2}", f"d{i % 3}", i, int(rng.integers(0, 2)), 0.0, float(rng.normal() * 2)) for i in range(600)]
    rows += [("m0", "d0", 1000 + i, i % 2, 0.0, _logit_for(p)) for i, p in enumerate((0.6, 0.7, 0.85, 0.9, 0.95))]
    edges = F.array(*[F.lit(e) for e in ST.EDGES])
    df = _scored(spark, rows).withColumn("confidence", F.when(
        F.col("ex_id") % 7 == 0, F.element_at(edges, (F.col("ex_id") % len(ST.EDGES) + 1).cast("int"))).otherwise(F.col("confidence")))
    merged = ST.merge([ST.statistics(df.where(f"ex_id % 3 = {k}")) for k in range(3)])
    rounded = lambda d: sorted(tuple(r) for r in d.collect())
    assert rounded(ST.sweep_of(merged)) == rounded(M.selective_sweep(df))
    assert rounded(ST.handoff_of(merged)) == rounded(M.handoff_rates(df))
    whole = {(r["model"], r["dataset"]): r for r in M.performance_summary(df).collect()}
    for r in ST.summary_of(merged).collect():
        want = whole[r["model"], r["dataset"]]
        for c in ("macro_f1", "ece", "conf_correct", "conf_wrong"):
            assert r[c] == pytest.approx(want[c], abs=2e-6)
        assert r["n"] == want["n"] and r["n_high"] / r["n"] * 100 == pytest.approx(want["pct_conf_gt_90"], abs=1e-6)
        mine = df.where((F.col("model") == r["model"]) & (F.col("dataset") == r["dataset"]))
        assert r["n_high_conf_fn"] == mine.where("label = 1 and predicted = 0 and confidence > 0.85").count()
    ece = {(r["model"], r["dataset"]): r["ece"] for r in M.ece(df).collect()}
    assert all(r["ece"] == pytest.approx(ece[r["model"], r["dataset"]], abs=1e-12) for r in ST.ece_of(merged).collect())
