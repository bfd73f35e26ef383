"""Temperature scaling (DOM14-DOM16).

DOM14 fits one temperature T per group by minimising the mean negative
log-likelihood  -ln(clip(p_correct, 1e-12, 1)),  p = sigmoid(z / T),
T in [0.5, 20].  NLL is convex in u = 1/T, so its derivative has one zero: a
Newton iteration on the sums of gradient and curvature finds it, kept inside a
bracket by bisection.  Each pass is one aggregation of a compact (group, z,
label, count) table for *all* groups, and one row per group reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scoring import calibrated_p, confidence, log_odds
from tessera.operators.metrics import GROUP, _bin_case
from tessera.session import BROADCAST_MAX_ROWS, bounded_broadcast, materialize

P_CLIP = 1e-12
T_BOUNDS = (0.5, 20.0)


def _sums_at(u, z, y, c, name: str) -> list[F.Column]:
    """Sums of NLL, gradient and curvature in u; clipped rows have no slope."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(z * u)))
    right = F.when(y == 1, p).otherwise(F.lit(1.0) - p)
    free = right > F.lit(P_CLIP)
    slope = z * (p - F.when(y == 1, 1.0).otherwise(0.0))
    return [F.sum(-F.log(F.greatest(right, F.lit(P_CLIP))) * c).alias(f"{name}_nll"),
            F.sum(F.when(free, slope * c).otherwise(0.0)).alias(f"{name}_g"),
            F.sum(F.when(free, z * z * p * (F.lit(1.0) - p) * c).otherwise(0.0)).alias(f"{name}_h")]


def fit_temperature(df: DataFrame, group: Sequence[str] = GROUP, z: str = "log_odds",
                    label: str = "label", bounds=T_BOUNDS, passes: int = 40, tol: float = 1e-12) -> DataFrame:
    """DOM14: (group..., T, nll, n) per group.

    The first pass takes the sums at both bounds and at T = 1; a group whose
    slope does not change sign ends at a bound.  Every further pass makes one
    Newton step per group (a bisection where it would leave the bracket) and
    ends when all steps are below ``tol``: some six passes, no row multiplied.
    """
    spark = df.sparkSession
    group = list(group)
    base = df.select(*group, (F.col(z) if z in df.columns else log_odds()).alias("_z"), F.col(label).alias("_y"))
    # Compact the data once: identical (group, z, label) rows collapse.
    compact = materialize(base.groupBy(*group, "_z", "_y").agg(F.count(F.lit(1)).cast("double").alias("_c")))
    u_lo, u_hi = 1.0 / bounds[1], 1.0 / bounds[0]
    at = [F.col(k) for k in ("_z", "_y", "_c")]
    first = compact.groupBy(*group).agg(F.sum("_c").alias("_n"), *_sums_at(F.lit(u_lo), *at, "lo"),
                                        *_sums_at(F.lit(u_hi), *at, "hi"), *_sums_at(F.lit(1.0), *at, "u")).collect()
    done, open_ = {}, {}

    def step(k, n, lo, hi, u, nll, g, h):
        """Narrow the bracket and move on, or settle the group."""
        lo, hi = (lo, u) if g > 0 else (u, hi)
        to = u - g / h if h > 0 else lo
        if not lo < to < hi:
            to = (lo + hi) / 2
        if abs(to - u) <= tol or g == 0:
            done[k] = (u, nll / n, n)
        else:
            open_[k] = (n, lo, hi, to)

    for r in first:
        k, n = tuple(r[g] for g in group), r["_n"]
        if r["lo_g"] >= 0 or r["hi_g"] <= 0:
            end = "lo" if r["lo_g"] >= 0 else "hi"
            done[k] = (u_lo if end == "lo" else u_hi, r[f"{end}_nll"] / n, n)
        else:
            step(k, n, u_lo, u_hi, 1.0, r["u_nll"], r["u_g"], r["u_h"])
    keys = T.StructType([f for g in group for f in df.schema.fields if f.name == g])
    for left in range(passes, 0, -1):
        if not open_:
            break
        # One row per group; its size is the number of groups, known here.
        points = spark.createDataFrame([(*k, v[3]) for k, v in open_.items()],
                                       T.StructType([*keys.fields, T.StructField("_u", T.DoubleType())]))
        here = F.broadcast(points) if len(open_) <= BROADCAST_MAX_ROWS else points
        same = [compact[g].eqNullSafe(here[g]) for g in group]
        sums = compact.join(here, same).select(*[compact[g] for g in group], "_z", "_y", "_c", "_u") \
            .groupBy(*group).agg(*_sums_at(F.col("_u"), *at, "u")).collect()
        for r in sums:
            k = tuple(r[g] for g in group)
            n, lo, hi, u = open_.pop(k)
            step(k, n, lo, hi, u, r["u_nll"], r["u_g"], r["u_h"])
            if left == 1 and k in open_:
                open_.pop(k)
                done[k] = (u, r["u_nll"] / n, n)
    out_schema = T.StructType([*keys.fields, T.StructField("T", T.DoubleType()),
                               T.StructField("nll", T.DoubleType()), T.StructField("n", T.LongType())])
    return spark.createDataFrame([(*k, 1.0 / u, nll, int(n)) for k, (u, nll, n) in done.items()], out_schema)


def nll_at(df: DataFrame, temps: DataFrame, group: Sequence[str] = GROUP,
           label: str = "label") -> DataFrame:
    """Mean clipped NLL at given temperatures (for checking a fit)."""
    j = df.join(bounded_broadcast(temps.select(*group, "T")), list(group), "left")
    p = calibrated_p(log_odds(), F.col("T"))
    pc = F.when(F.col(label) == 1, p).otherwise(F.lit(1.0) - p)
    return j.groupBy(*group).agg(
        F.avg(-F.log(F.least(F.greatest(pc, F.lit(P_CLIP)), F.lit(1.0)))).alias("nll"))


def apply_temperature(df: DataFrame, temps: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """DOM15: add log_odds, T, p_hs_cal, confidence_cal.  ``temps`` holds one
    row per group; it is broadcast after a size check.  Rows of a group
    without a temperature stay, with NULL in the three calibrated columns
    (see :func:`missing_temperatures`)."""
    j = df.join(bounded_broadcast(temps.select(*group, "T")), list(group), "left")
    return (j.withColumn("log_odds", log_odds())
             .withColumn("p_hs_cal", calibrated_p("log_odds", "T"))
             .withColumn("confidence_cal", confidence("p_hs_cal")))


def missing_temperatures(df: DataFrame, temps: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Groups of ``df`` (with their row counts) that have no temperature."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes.join(temps.select(*group), list(group), "left_anti")


def temperatures_from_map(spark, mapping: dict[str, float], datasets: Sequence[str],
                          sep: str = "_") -> DataFrame:
    """Temperatures keyed ``model<sep>dataset`` (the JSON map layout) -> table."""
    rows = []
    for key, t in mapping.items():
        for d in datasets:
            if key.endswith(sep + d):
                rows.append((key[: -len(sep + d)], d, float(t)))
    return spark.createDataFrame(rows, "model string, dataset string, T double")


def calibration_table(cal: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """DOM16: T, ECE raw/cal, confidence gap raw/cal, conf(wrong) raw/cal.

    The scored rows are read once, into sums per (group, raw bin, calibrated
    bin, correct): at most 242 rows a group, which hold all of the figures."""
    group = list(group)
    cells = materialize(cal.groupBy(
        *group, _bin_case(F.col("p_hs"), True).alias("bin_raw"), _bin_case(F.col("p_hs_cal"), True).alias("bin_cal"),
        "correct").agg(
        F.first("T").alias("T"), F.count(F.lit(1)).alias("n"), F.count("confidence_cal").alias("n_cal"),
        F.sum(F.col("label").cast("double")).alias("y"), F.sum("p_hs").alias("p_raw"), F.sum("p_hs_cal").alias("p_cal"),
        F.sum("confidence").alias("c_raw"), F.sum("confidence_cal").alias("c_cal")))

    def mean(kind, n, where):
        return F.sum(F.when(where, F.col(f"c_{kind}"))) / F.nullif(F.sum(F.when(where, F.col(n))), F.lit(0)).cast("double")

    ok = F.col("correct")
    out = cells.groupBy(*group).agg(
        F.first("T").alias("T"), *[f.alias(f"{name}_{kind}") for kind, n in (("raw", "n"), ("cal", "n_cal"))
                                   for name, f in (("right", mean(kind, n, ok)), ("conf_wrong", mean(kind, n, ~ok)))])
    for kind in ("raw", "cal"):
        bins = cells.groupBy(*group, f"bin_{kind}").agg(
            F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum(f"p_{kind}").alias("p"))
        off = F.col("n").cast("double") * F.abs(F.col("y") / F.col("n") - F.col("p") / F.col("n"))
        out = out.join(bins.groupBy(*group).agg(
            (F.sum(F.when(F.col(f"bin_{kind}").isNotNull(), off).otherwise(F.lit(0.0)))
             / F.sum("n").cast("double")).alias(f"ece_{kind}")), group)
    return out.select(
        *group, F.round("T", 6).alias("T"),
        F.round("ece_raw", 6).alias("ece_raw"),
        F.when(F.col("T").isNotNull(), F.round("ece_cal", 6)).alias("ece_cal"),
        F.round(F.col("right_raw") - F.col("conf_wrong_raw"), 6).alias("conf_gap_raw"),
        F.round(F.col("right_cal") - F.col("conf_wrong_cal"), 6).alias("conf_gap_cal"),
        F.round("conf_wrong_raw", 6).alias("conf_wrong_raw"),
        F.round("conf_wrong_cal", 6).alias("conf_wrong_cal"))
