"""Error analysis across models (DOM25-DOM28, DOM30).

Cross-model questions are answered per example without pairing rows:
each example's models are folded into bitmasks (``bit_or(1 << model_index)``,
so that a repeated row changes nothing)
by one group-by on (dataset, ex_id), and every agreement / overlap figure
is a count over (dataset, mask) -- at most 2^#models rows per dataset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scoring import label_name, safe_ratio
from tessera.functions.text import first_chars, word_count
from tessera.operators import statistics as ST
from tessera.operators.metrics import (GROUP, TIE_DECIMALS, best_model_of, confusion_aggs, macro_columns, pick_best,
                                       rank_key)
from tessera.session import materialize, small_side

TOP_N = 8
TEXT_CHARS = 110

# The example categories of the study (id, name, sort order).
CATEGORIES = (
    (1, "prototypical_hs", "desc"),
    (2, "dangerous_fn", "desc"),
    (3, "overconfident_fp", "desc"),
    (4, "rag_candidates", "asc"),
    (6, "implicit_missed", "desc"),
    (7, "short_text_confident_failure", "desc"),
    (8, "uncertain_correct", "asc"),
)


# The limits of the category rules.
SURE, RATHER_SURE, UNSURE, SHORT_WORDS = 0.95, 0.85, 0.65, 12
IMPLICIT = "implicit_hate"
MAX_MODELS = 62


def _category_masks(class_dataset: str, short_dataset: str) -> dict[int, Column]:
    ok, y, p, cf = F.col("correct"), F.col("label"), F.col("predicted"), F.col("confidence")
    return {
        1: ok & (y == 1) & (cf > SURE),
        2: ~ok & (y == 1) & (p == 0) & (cf > RATHER_SURE),
        3: ~ok & (y == 0) & (p == 1) & (cf > RATHER_SURE),
        4: cf < UNSURE,
        6: (F.col("dataset") == class_dataset) & (F.col("orig_class") == IMPLICIT) & (p == 0),
        7: (F.col("dataset") == short_dataset) & ~ok & (cf > RATHER_SURE) & (F.col("words") < SHORT_WORDS),
        8: ok & (cf < UNSURE),
    }


def categorised(df: DataFrame, class_dataset: str = "d0", short_dataset: str = "d1") -> DataFrame:
    """PRJ14: rows of every model, exploded into each category they match (one
    pass, no join; callers keep the best model's)."""
    rows = df.withColumn("words", word_count("text"))
    masks = _category_masks(class_dataset, short_dataset)
    cats = F.filter(F.array(*[F.when(m, F.lit(i)) for i, m in masks.items()]),
                    lambda x: x.isNotNull())
    return rows.withColumn("category", F.explode(cats))


def example_counts(df: DataFrame, class_dataset="d0", short_dataset="d1") -> DataFrame:
    """DOM25 counts of the best model per dataset: matches per category, % of
    the dataset's test rows, the correct share of the matches (of interest for
    the RAG candidates) and the rows they are out of (category 6: the implicit
    ones, else all of the dataset).

    One aggregation per (dataset, model) holds the confusion counts and every
    category's counts; the best model is picked from that small table.
    """
    masks = _category_masks(class_dataset, short_dataset)
    per = df.withColumn("words", word_count("text")).groupBy("dataset", "model").agg(
        *confusion_aggs(), F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("orig_class") == IMPLICIT).alias("_implicit"),
        *[F.count_if(m).alias(f"_f{i}") for i, m in masks.items()],
        *[F.count_if(m & F.col("correct")).alias(f"_c{i}") for i, m in masks.items()])
    best = pick_best(per.withColumn("macro_f1", macro_columns()["macro_f1"]))
    rows = F.array(*[F.struct(F.lit(i).alias("category"), F.lit(nm).alias("name"),
                              F.col(f"_f{i}").alias("n_found"), F.col(f"_c{i}").alias("n_correct"))
                     for i, nm, _ in CATEGORIES])
    out = best.select("dataset", "model", "_n", "_implicit", F.explode(rows).alias("r")).select(
        "dataset", "model", "_n", "_implicit", "r.*")
    out = out.where(((F.col("category") != 6) | (F.col("dataset") == class_dataset))
                    & ((F.col("category") != 7) | (F.col("dataset") == short_dataset)))
    share = safe_ratio(F.col("n_correct").cast("double"), F.col("n_found")) * 100.0
    return out.select("dataset", "model", "category", "name", "n_found", "n_correct",
                      F.round(F.col("n_found").cast("double") / F.col("_n").cast("double") * 100.0, 6)
                      .alias("pct_of_set"),
                      F.round(share, 6).alias("pct_correct"),
                      F.when(F.col("category") == 6, F.col("_implicit")).otherwise(F.col("_n")).alias("out_of"))


def top_examples(df: DataFrame, class_dataset="d0", short_dataset="d1", n: int = TOP_N) -> DataFrame:
    """DOM25 / WIN4: the top ``n`` examples per (dataset, category) by
    confidence (descending, or ascending for the low-confidence ones); ties
    by ex_id.  The best model is picked first, from per-model counts; only its
    rows are ranked, with the text already cut to what is shown
    (``row_number() <= n`` cuts each partition to n rows before the shuffle)."""
    asc = [i for i, _, o in CATEGORIES if o == "asc"]
    best = small_side(best_model_of(df).select("dataset", "model"))
    # the confidence of a row grows with |l1 - l0|
    mine = df.withColumn("_sure", F.abs(rank_key(df, "confidence"))).join(best, ["dataset", "model"])
    cat = categorised(mine, class_dataset, short_dataset).withColumn("text", first_chars("text", TEXT_CHARS))
    key = F.when(F.col("category").isin(asc), F.col("_sure")).otherwise(-F.col("_sure"))
    w = Window.partitionBy("dataset", "category").orderBy(key, F.col("ex_id"))
    return cat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(
        "dataset", "category", "rank", "model", "ex_id", "text",
        label_name("label").alias("true_label"), label_name("predicted").alias("pred_label"),
        F.round("confidence", 6).alias("confidence"), "orig_class", "words")


def models_of(df: DataFrame, models: Sequence[str] | None = None) -> list[str]:
    """The models to compare: the given ones, or all that the data holds."""
    found = [r[0] for r in df.where(F.col("model").isNotNull()).select("model").distinct()
             .orderBy("model").limit(MAX_MODELS + 1).collect()] if models is None else list(models)
    if len(found) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models do not fit a mask; name the ones to compare")
    return found


def _model_index(models: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model")) - 1


def per_example(df: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """One row per (dataset, ex_id) with bitmasks over ``models``: which scored
    it (``seen_mask``), which were wrong, which predicted positive; and the mean
    confidence (no text: it would ride through the shuffle for every example)."""
    bit = F.expr("shiftleft(1L, _idx)")
    models = models_of(df, models)
    return df.withColumn("_idx", _model_index(models).cast("int")).where(F.col("_idx") >= 0) \
        .groupBy("dataset", "ex_id").agg(
        F.bit_or(bit).alias("seen_mask"),
        F.bit_or(F.when(~F.col("correct"), bit).otherwise(F.lit(0).cast("long"))).alias("err_mask"),
        F.bit_or(F.when(F.col("predicted") == 1, bit).otherwise(F.lit(0).cast("long"))).alias("pos_mask"),
        F.avg("confidence").alias("avg_conf"))


def consensus_failures(df: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """DOM26 counts: examples that every model gets wrong, per dataset.  The
    share is out of the examples that every model has scored."""
    models = models_of(df, models)
    full = (1 << len(models)) - 1
    ex = per_example(df, models)
    return ex.groupBy("dataset").agg(
        F.count_if(F.col("seen_mask") == full).alias("n_examples"),
        F.count_if(F.col("err_mask") == full).alias("n_consensus")).select(
        "dataset", "n_examples", "n_consensus",
        F.round(safe_ratio(F.col("n_consensus").cast("double"), F.col("n_examples")) * 100.0, 6)
        .alias("pct_consensus"))


def consensus_examples(df: DataFrame, models: Sequence[str] | None = None, n: int = TOP_N) -> DataFrame:
    """DOM26 examples: top ``n`` consensus failures per dataset by mean
    confidence, with each model's (wrong) prediction.  Ranking runs on the
    text-free masks; text, label and class are joined for the top rows only."""
    models = models_of(df, models)
    full = (1 << len(models)) - 1
    ex = per_example(df, models).where(F.col("err_mask") == full)
    w = Window.partitionBy("dataset").orderBy(F.round("avg_conf", TIE_DECIMALS).desc(), F.col("ex_id"))
    top = ex.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    info = df.where(F.col("model") == (models[0] if models else None)).select(
        "dataset", "ex_id", "text", "label", "orig_class")
    top = info.join(small_side(top), ["dataset", "ex_id"])
    preds = [label_name(F.when(F.col("pos_mask").bitwiseAND(F.lit(1 << i)) != 0, 1).otherwise(0)).alias(m)
             for i, m in enumerate(models)]
    return top.select("dataset", "rank", "ex_id", first_chars("text", TEXT_CHARS).alias("text"),
                      label_name("label").alias("true_label"), *preds,
                      F.round("avg_conf", 6).alias("avg_conf"), "orig_class")


def agreement_matrix(df: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """DOM27: share of the examples scored by both a and b on which they
    predict the same label (symmetric, diagonal 1; NULL where they share no
    example), from bitmasks of presence and of positive predictions."""
    models = models_of(df, models)
    mc = per_example(df, models).groupBy("dataset", "seen_mask", "pos_mask").agg(F.count(F.lit(1)).alias("_k"))
    pairs = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                               F.lit(i).alias("_i"), F.lit(j).alias("_j"))
                      for i, a in enumerate(models) for j, b in enumerate(models)])
    ex = mc.select("dataset", "seen_mask", "pos_mask", "_k", F.explode(pairs).alias("p"))
    both = F.expr("(shiftright(seen_mask, p._i) & shiftright(seen_mask, p._j) & 1) = 1")
    same = F.expr("(shiftright(pos_mask, p._i) & 1) = (shiftright(pos_mask, p._j) & 1)")
    agg = ex.groupBy("dataset", F.col("p.model_a").alias("model_a"), F.col("p.model_b").alias("model_b")).agg(
        F.sum(F.when(both & same, F.col("_k")).otherwise(0)).alias("_same"),
        F.sum(F.when(both, F.col("_k")).otherwise(0)).alias("_n"))
    return agg.select("dataset", "model_a", "model_b",
                      F.round(F.when(F.col("_n") > 0, F.col("_same").cast("double") / F.col("_n").cast("double")), 6)
                      .alias("agreement"))


def region_names(models: Sequence[str]) -> list[tuple[int, str]]:
    """All 2^k - 1 exclusive error regions: only one model, some, all."""
    k = len(models)

    def name(mask):
        on = [m for i, m in enumerate(models) if mask >> i & 1]
        return f"only {on[0]}" if len(on) == 1 else f"all {k}" if len(on) == k else "+".join(on)

    return [(mask, name(mask)) for mask in range(1, 1 << k)]


#: Models of which all 2^k - 1 regions are listed at most.
MAX_REGION_MODELS = 16


def error_overlap(df: DataFrame, models: Sequence[str] | None = None, with_empty: bool = True) -> DataFrame:
    """DOM28: errors per exclusive region, for any number of models.  Empty
    regions are listed with 0 unless ``with_empty`` is False, which more than
    ``MAX_REGION_MODELS`` models ask for (there are 2^k regions)."""
    models = models_of(df, models)
    if with_empty and len(models) > MAX_REGION_MODELS:
        raise ValueError(f"{len(models)} models have 2^{len(models)} regions: name fewer, or pass with_empty=False")
    mc = per_example(df, models).groupBy("dataset", "err_mask").agg(F.count(F.lit(1)).alias("_k"))
    if with_empty:
        # all regions of the datasets that the masks hold: no second scan
        mc = materialize(mc)
        grid = mc.select("dataset").distinct().select("dataset", F.explode(
            F.sequence(F.lit(1).cast("long"), F.lit((1 << len(models)) - 1).cast("long"))).alias("err_mask"))
        mc = grid.join(mc, ["dataset", "err_mask"], "left") if models else mc.limit(0)
    else:
        mc = mc.where("err_mask <> 0")
    on = F.filter(F.array(*[F.when(F.col("err_mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(m))
                            for i, m in enumerate(models)]), lambda m: m.isNotNull())
    region = (F.when(F.size(on) == 1, F.concat(F.lit("only "), on[0]))
              .when(F.size(on) == len(models), F.lit(f"all {len(models)}")).otherwise(F.array_join(on, "+")))
    return mc.select("dataset", region.alias("region"), F.col("err_mask").cast("long").alias("err_mask"),
                     F.coalesce("_k", F.lit(0)).cast("long").alias("n_errors"))


def findings(df: DataFrame, models: Sequence[str] | None = None, t: float = 0.90) -> DataFrame:
    """DOM30: per (model, dataset) macro F1, ECE, confidence gap, % routed
    at t = 0.90, dangerous FN count; plus the dataset's consensus share.  The
    scored rows are read once, and written without their texts; the models are
    taken from the statistics."""
    slim = materialize(df.select(*GROUP, "ex_id", "label", "predicted", "correct", "confidence", "p_hs"))
    stats = materialize(ST.statistics(slim))
    found = consensus_failures(slim, models_of(stats, models))
    out = ST.summary_of(stats, GROUP, t).join(found.select("dataset", "pct_consensus"), "dataset")
    return out.select(
        *GROUP, F.round("macro_f1", 6).alias("macro_f1"), F.round("ece", 6).alias("ece"),
        F.round(F.col("conf_correct") - F.col("conf_wrong"), 6).alias("conf_gap"),
        F.round(F.col("n_routed").cast("double") / F.col("n").cast("double") * 100.0, 6).alias("pct_to_rag"),
        "n_high_conf_fn", "pct_consensus")
