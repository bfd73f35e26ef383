"""Per-group baseline training and scoring (DOM11, UDF2-UDF3).

The study fine-tuned one transformer per (dataset, model); here each
(dataset, model) cell is a ``pyspark.ml`` pipeline -- RegexTokenizer ->
HashingTF -> classifier -- fitted on the group's train split and applied
to its test split.  Every fit is a distributed job; the grid itself is a
short driver loop over the known cells (3 x 3), not over data.  The output
is the ``scored`` layout (logits l0, l1), so every analysis operator runs
on it unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scoring import with_scores
from tessera.functions.text import tokens
from tessera.session import materialize, small_side

NUM_FEATURES = 1 << 12
P_FLOOR = 1e-12
TOKEN_PATTERN = r"[^\s\p{Z}]+"


def _classifier(kind: str, seed: int):
    if kind == "logreg":
        return LogisticRegression(maxIter=30, regParam=0.01)
    if kind == "naive_bayes":
        return NaiveBayes(smoothing=1.0)
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed)
    raise ValueError(f"unknown model kind {kind!r}")


def to_logits(pred: DataFrame) -> DataFrame:
    """Probability vector -> (l0, l1) = log-probabilities, so a two-way
    softmax of the logits gives the model's probabilities back."""
    p = vector_to_array("probability")
    return pred.withColumn("l0", F.log(F.greatest(p[0], F.lit(P_FLOOR)))) \
               .withColumn("l1", F.log(F.greatest(p[1], F.lit(P_FLOOR))))


def featurize(df: DataFrame, num_features: int = NUM_FEATURES) -> DataFrame:
    """RegexTokenizer -> HashingTF once for all cells (stateless stages)."""
    tok = RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=TOKEN_PATTERN, gaps=False,
                         toLowercase=True)
    tf = HashingTF(inputCol="_tokens", outputCol="features", numFeatures=num_features)
    return tf.transform(tok.transform(df)).drop("_tokens")


def train_and_score(labelled: DataFrame, datasets: Sequence[str],
                    models: Sequence[str] = ("logreg", "naive_bayes", "random_forest"),
                    seed: int = 42) -> DataFrame:
    """DOM11: ``labelled`` has (ex_id, dataset, split, text, label,
    orig_class).  Returns scored rows for every test example of every
    (dataset, model) cell.  Features are computed once and written to the
    shared checkpoint folder (nothing stays cached); each cell fits its
    classifier on its dataset's train split and scores the test split, and
    the scored rows are written as well, so readers do not fit again."""
    data = materialize(featurize(labelled.select("ex_id", "dataset", "split", "text", "label", "orig_class")))
    out = None
    for d in datasets:
        train = data.where((F.col("dataset") == d) & (F.col("split") == "train"))
        test = data.where((F.col("dataset") == d) & (F.col("split") == "test"))
        for m in models:
            fitted = _classifier(m, seed).fit(train)
            scored = to_logits(fitted.transform(test)).select(
                F.lit(m).alias("model"), "dataset", "ex_id", "text", "label", "orig_class", "l0", "l1")
            out = scored if out is None else out.unionByName(scored)
    return with_scores(materialize(out))


NB_BUCKETS = 4096
LOGIT_DECIMALS = 9


def hashed_naive_bayes(labelled: DataFrame, buckets: int = NB_BUCKETS, alpha: float = 1.0,
                       model: str = "hashed_nb") -> DataFrame:
    """DOM11 in closed form: multinomial naive Bayes per dataset over md5
    buckets of lower-cased tokens, fitted on the train split by counting and
    applied to the test split.  Two aggregations and a join with the count
    table (at most ``buckets`` rows per dataset); logits are rounded to
    ``LOGIT_DECIMALS``, since they are sums taken in any order.  A dataset
    whose train split lacks a class scores no row of it (log of 0 prior)."""
    bucket = (F.conv(F.substring(F.md5(F.lower("_t")), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")
    toks = labelled.select("dataset", "split", "ex_id", "label", F.explode(tokens("text")).alias("_t")).select(
        "dataset", "split", "ex_id", "label", bucket.alias("_b"))
    y1, y0 = F.col("label") == 1, F.col("label") == 0
    counts = (toks.where("split = 'train'").groupBy("dataset", "_b")
              .agg(F.count_if(y0).alias("_n0"), F.count_if(y1).alias("_n1")))
    counts = materialize(counts)
    sums = counts.groupBy("dataset").agg(F.sum("_n0").alias("_t0"), F.sum("_n1").alias("_t1"))
    docs = (labelled.where("split = 'train'").groupBy("dataset")
            .agg(F.count_if(y0).alias("_d0"), F.count_if(y1).alias("_d1")).where("_d0 > 0 and _d1 > 0"))
    totals = small_side(docs.join(sums, "dataset", "left").na.fill(0))
    per = toks.where("split = 'test'").groupBy("dataset", "ex_id", "_b").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    per = per.join(small_side(counts), ["dataset", "_b"], "left").join(totals, "dataset")
    term = [F.col("_c") * F.log((F.coalesce(F.col(f"_n{y}"), F.lit(0)) + F.lit(alpha))
                                / (F.col(f"_t{y}") + F.lit(alpha * buckets))) for y in (0, 1)]
    per = per.groupBy("dataset", "ex_id").agg(F.sum(term[0]).alias("_s0"), F.sum(term[1]).alias("_s1"))
    test = labelled.where("split = 'test'").select("dataset", "ex_id", "text", "label", "orig_class")
    prior = [F.log(F.col(f"_d{y}") / (F.col("_d0") + F.col("_d1"))) for y in (0, 1)]
    logit = [F.round(prior[y] + F.coalesce(F.col(f"_s{y}"), F.lit(0.0)), LOGIT_DECIMALS) for y in (0, 1)]
    out = test.join(per, ["dataset", "ex_id"], "left").join(totals, "dataset").select(
        F.lit(model).alias("model"), "dataset", "ex_id", "text", "label", "orig_class",
        logit[0].alias("l0"), logit[1].alias("l1"))
    return with_scores(out)


MetricFn = Callable[[DataFrame], DataFrame]
_METRICS: dict[str, MetricFn] = {}


def register_metric(name: str, fn: MetricFn) -> None:
    """UDF3: a user metric over a scored table, registered by name."""
    _METRICS[name] = fn


def compute_metric(name: str, scored: DataFrame) -> DataFrame:
    return _METRICS[name](scored)
