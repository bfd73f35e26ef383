"""Column functions over two-class logits (SCL22-SCL25, SCL27-SCL28).

All arithmetic is in double and stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_NAMES = {0: "Non-HS", 1: "HS"}


# The three-way classes of the study.
CLASS_NAMES = ("not_hate", "explicit_hate", "implicit_hate")


def orig_class(toxic="toxic", quality="quality") -> Column:
    """Three-way class from (toxic, quality)."""
    return (F.when(F.col(toxic) == 0, F.lit(CLASS_NAMES[0]))
            .when(F.col(quality) == 0, F.lit(CLASS_NAMES[1]))
            .otherwise(F.lit(CLASS_NAMES[2])))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def p_positive(l0="l0", l1="l1") -> Column:
    """SCL22: softmax over two logits, probability of class 1."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(_c(l0) - _c(l1)))


def predicted(l0="l0", l1="l1") -> Column:
    """SCL22: argmax; a tie goes to class 0."""
    return F.when(_c(l1) > _c(l0), F.lit(1)).otherwise(F.lit(0))


def confidence(p="p_hs") -> Column:
    """SCL22: probability of the chosen class, max(p, 1-p)."""
    return F.greatest(_c(p), F.lit(1.0) - _c(p))


def log_odds(l0="l0", l1="l1") -> Column:
    """SCL23: ln(p1/p0).  With logits at hand this is exactly l1 - l0 and
    never hits ln(0) (Spark returns NULL there, NumPy -inf)."""
    return _c(l1) - _c(l0)


def calibrated_p(z="log_odds", t="T") -> Column:
    """SCL24: sigmoid(z / T)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(_c(z) / _c(t))))


def quadrant(label="label", pred="predicted") -> Column:
    """SCL25: outcome quadrant."""
    y, p = _c(label), _c(pred)
    return (F.when((y == 0) & (p == 0), F.lit("TN"))
            .when((y == 0) & (p == 1), F.lit("FP"))
            .when((y == 1) & (p == 1), F.lit("TP"))
            .otherwise(F.lit("FN")))


def label_name(c) -> Column:
    """SCL27: 0/1 -> display name."""
    return F.when(_c(c) == 0, F.lit(LABEL_NAMES[0])).when(_c(c) == 1, F.lit(LABEL_NAMES[1]))


def safe_ratio(n, m) -> Column:
    """SCL28: n / max(m, 1)."""
    return _c(n) / F.greatest(_c(m), F.lit(1))


def with_scores(df, l0="l0", l1="l1", label="label"):
    """Add p_hs, confidence, predicted, correct to a logits table."""
    return (df.withColumn("p_hs", p_positive(l0, l1))
              .withColumn("confidence", confidence("p_hs"))
              .withColumn("predicted", predicted(l0, l1))
              .withColumn("correct", F.col("predicted") == _c(label)))
