"""Registered queries: calibration (DOM14-16), router (DOM24) and error
analysis (DOM25-28, DOM30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import WS, sql_word_count
from tessera.operators import calibration as C
from tessera.operators import errors as ER
from tessera.operators import metrics as M
from tessera.plans.fixtures import DATASETS, MODELS, scored
from tessera.plans.sql import CONFUSION_SQL, dbl, ece_bin_sql, macro_sql, with_scored
from tessera.session import materialize

QUERIES: dict = {}
SQL: dict = {}
_mac = macro_sql()


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# The temperature map handed to DOM15/DOM16 (the layout of a
# ``model_dataset -> T`` JSON file).  A parameter, not a fit result.
TEMPERATURES = {f"{m}_{d}": t for m, t in zip(MODELS, (1.5, 2.0, 3.0)) for d in DATASETS}

_TEMPS_SQL = "(VALUES " + ", ".join(
    f"('{k.split('_')[0]}', '{k.split('_')[1]}', {dbl(v)})" for k, v in TEMPERATURES.items()) + ") AS tt(model, dataset, T)"

_CAL_CTE = f"""
cal AS (SELECT s.*, tt.T, l1 - l0 AS log_odds,
               CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-((l1 - l0) / tt.T))) AS p_hs_cal
        FROM scored s LEFT JOIN {_TEMPS_SQL} USING (model, dataset)),
cal2 AS (SELECT *, greatest(p_hs_cal, CAST(1.0 AS DOUBLE) - p_hs_cal) AS confidence_cal FROM cal)"""


def _calibrated(spark, sf_dir):
    s = scored(spark, sf_dir)
    temps = C.temperatures_from_map(spark, TEMPERATURES, DATASETS)
    return C.apply_temperature(s, temps)


# --- DOM14 fit: the grid passes as chained CTEs ------------------------------
# The twin narrows a grid of candidates; six passes reach 2e-9 in 1/T.
_FIT_GRID, _FIT_PASSES = 64, 6


def _fit_sql() -> str:
    lo, hi = dbl(1.0 / C.T_BOUNDS[1]), dbl(1.0 / C.T_BOUNDS[0])
    p = "(CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-(z * u))))"
    ctes = ["""compact AS (SELECT model, dataset, l1 - l0 AS z, label AS y, CAST(count(*) AS DOUBLE) AS c
                        FROM scored GROUP BY ALL)""",
            f"b0 AS (SELECT model, dataset, {lo} AS lo, {hi} AS hi, sum(c) AS n FROM compact GROUP BY ALL)"]
    for k in range(_FIT_PASSES):
        ctes.append(f"""c{k} AS (SELECT model, dataset, lo, hi, n, i,
            lo + (hi - lo) / {dbl(_FIT_GRID - 1)} * CAST(i AS DOUBLE) AS u FROM b{k}, range(0, {_FIT_GRID}) AS r(i)),
s{k} AS (SELECT model, dataset, lo, hi, n, i, u, sum(c * -ln(least(greatest(
            CASE WHEN y = 1 THEN {p} ELSE CAST(1.0 AS DOUBLE) - {p} END, {dbl(C.P_CLIP)}), CAST(1.0 AS DOUBLE)))) AS s
         FROM compact JOIN c{k} USING (model, dataset) GROUP BY ALL),
m{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, dataset ORDER BY s, i) AS rn FROM s{k}) WHERE rn = 1),
b{k + 1} AS (SELECT model, dataset, greatest({lo}, u - (hi - lo) / {dbl(_FIT_GRID - 1)}) AS lo,
                    least({hi}, u + (hi - lo) / {dbl(_FIT_GRID - 1)}) AS hi, n FROM m{k})""")
    return with_scored(*ctes) + f"""
SELECT model, dataset, round(CAST(1.0 AS DOUBLE) / u, 4) AS T, round(s / n, 6) AS nll, CAST(n AS BIGINT) AS n
FROM m{_FIT_PASSES - 1}"""


@register("dom14_temperature_fit", _fit_sql())
def q_fit(spark, sf_dir):
    t = C.fit_temperature(scored(spark, sf_dir))
    return t.select("model", "dataset", F.round("T", 4).alias("T"), F.round("nll", 6).alias("nll"), "n")


# --- DOM15 apply ---------------------------------------------------------------
@register("dom15_temperature_apply", with_scored(_CAL_CTE) + """
SELECT model, dataset, ex_id, T, round(log_odds, 6) AS log_odds, round(p_hs_cal, 6) AS p_hs_cal,
       round(confidence_cal, 6) AS confidence_cal, predicted,
       CASE WHEN p_hs_cal > CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS predicted_cal
FROM cal2""")
def q_apply(spark, sf_dir):
    c = _calibrated(spark, sf_dir)
    return c.select("model", "dataset", "ex_id", "T", F.round("log_odds", 6).alias("log_odds"),
                    F.round("p_hs_cal", 6).alias("p_hs_cal"),
                    F.round("confidence_cal", 6).alias("confidence_cal"), "predicted",
                    F.when(F.col("p_hs_cal") > 0.5, 1).otherwise(0).alias("predicted_cal"))


# --- DOM16 before/after table --------------------------------------------------
def _ece_sql(p, name):
    return f"""
b_{name} AS (SELECT model, dataset, {ece_bin_sql(p)} AS bin, count(*) AS nb,
                    sum(CAST(label AS DOUBLE)) AS sy, sum({p}) AS sp FROM cal2 GROUP BY ALL),
e_{name} AS (SELECT model, dataset, sum(CASE WHEN bin IS NOT NULL THEN CAST(nb AS DOUBLE) * abs(sy / nb - sp / nb)
                    ELSE CAST(0.0 AS DOUBLE) END) / CAST(sum(nb) AS DOUBLE) AS {name} FROM b_{name} GROUP BY ALL)"""


@register("dom16_calibration_table", with_scored(_CAL_CTE + "," + _ece_sql("p_hs", "ece_raw") + ","
                                                 + _ece_sql("p_hs_cal", "ece_cal") + """,
st AS (SELECT model, dataset, first(T) AS T,
              avg(confidence) FILTER (WHERE correct) AS cr, avg(confidence) FILTER (WHERE NOT correct) AS conf_wrong_raw,
              avg(confidence_cal) FILTER (WHERE correct) AS cc, avg(confidence_cal) FILTER (WHERE NOT correct) AS conf_wrong_cal
       FROM cal2 GROUP BY ALL)""") + """
SELECT model, dataset, round(T, 6) AS T, round(ece_raw, 6) AS ece_raw, round(ece_cal, 6) AS ece_cal,
       round(cr - conf_wrong_raw, 6) AS conf_gap_raw, round(cc - conf_wrong_cal, 6) AS conf_gap_cal,
       round(conf_wrong_raw, 6) AS conf_wrong_raw, round(conf_wrong_cal, 6) AS conf_wrong_cal
FROM st JOIN e_ece_raw USING (model, dataset) JOIN e_ece_cal USING (model, dataset)""")
def q_cal_table(spark, sf_dir):
    return C.calibration_table(_calibrated(spark, sf_dir))


# --- DOM18 on calibrated confidence ---------------------------------------------
def _cal_sweep_sql():
    from tessera.plans.analysis_queries import _sweep_select, _sweep_sql
    return with_scored(_CAL_CTE + "," + _sweep_sql("confidence_cal", "cal2")) + _sweep_select()


@register("dom18_selective_sweep_calibrated", _cal_sweep_sql())
def q_sweep_cal(spark, sf_dir):
    c = _calibrated(spark, sf_dir)
    return M.selective_sweep(c, conf="confidence_cal")


# --- DOM24 router ----------------------------------------------------------------
@register("dom24_router", with_scored(_CAL_CTE) + """
SELECT model, dataset, ex_id, round(confidence_cal, 6) AS confidence_cal,
       CASE WHEN confidence_cal >= CAST('0.9' AS DOUBLE) THEN 'keep' ELSE 'rag' END AS route
FROM cal2""")
def q_router(spark, sf_dir):
    c = M.route(_calibrated(spark, sf_dir), 0.90)
    return c.select("model", "dataset", "ex_id", F.round("confidence_cal", 6).alias("confidence_cal"), "route")


# --- DOM24 with its retrieval branch: routed rows searched among the benchmark items ---
def _retrieval_sql():
    from tessera.plans.vector_queries import _hashed_sql, _norm_sql
    return with_scored(_CAL_CTE, f"hd AS {_hashed_sql('documents', 'doc_id')}", f"nd AS {_norm_sql('hd', 'doc_id', 'embedding')}",
                       f"hb AS {_hashed_sql('benchmark', 'item_id')}", f"nb AS {_norm_sql('hb', 'item_id', 'embedding')}",
                       """pairs AS (SELECT q.doc_id, c.item_id, round(list_inner_product(q.e, c.e), 12) AS s FROM nd q, nb c),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, item_id) AS rank FROM pairs)
        WHERE rank <= 3)""") + """
SELECT model, dataset, ex_id, CAST(rank AS INTEGER) AS rank, item_id AS chunk_id, round(s, 6) AS score
FROM cal2 JOIN top ON top.doc_id = cal2.ex_id WHERE NOT coalesce(confidence_cal >= CAST('0.9' AS DOUBLE), false)"""


@register("dom24_router_retrieval", _retrieval_sql())
def q_router_retrieval(spark, sf_dir):
    from tessera.operators.vectors import hashed_embeddings
    from tessera.plans.fixtures import logits_table
    from tessera.sources.tables import read_table
    from tessera.streaming.retrieval import retrieved, routed_rows
    temps = C.temperatures_from_map(spark, TEMPERATURES, DATASETS)
    logits = logits_table(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    index = hashed_embeddings(read_table(spark, sf_dir, "benchmark"), "item_id", "text", out_id="chunk_id")
    hits = retrieved(materialize(routed_rows(logits, temps)), index, k=3)
    return hits.withColumn("score", F.round("score", 6))


# --- DOM25 example categories ------------------------------------------------------
_BEST = f"""
cm AS (SELECT model, dataset, {CONFUSION_SQL} FROM scored GROUP BY model, dataset),
f AS (SELECT model, dataset, {_mac['macro_f1']} AS macro_f1 FROM cm),
best AS (SELECT model, dataset FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY macro_f1 DESC, model ASC) AS rn FROM f) WHERE rn = 1),
br AS (SELECT s.*, {sql_word_count('s.text')} AS words FROM scored s JOIN best USING (dataset, model)),
cat AS (SELECT *, unnest(list_filter([
          CASE WHEN correct AND label = 1 AND confidence > 0.95 THEN 1 END,
          CASE WHEN NOT correct AND label = 1 AND predicted = 0 AND confidence > 0.85 THEN 2 END,
          CASE WHEN NOT correct AND label = 0 AND predicted = 1 AND confidence > 0.85 THEN 3 END,
          CASE WHEN confidence < 0.65 THEN 4 END,
          CASE WHEN dataset = 'd0' AND orig_class = 'implicit_hate' AND predicted = 0 THEN 6 END,
          CASE WHEN dataset = 'd1' AND NOT correct AND confidence > 0.85 AND words < 12 THEN 7 END,
          CASE WHEN correct AND confidence < 0.65 THEN 8 END], lambda x: x IS NOT NULL)) AS category
        FROM br)"""

_NAMES = "(VALUES " + ", ".join(f"({i}, '{nm}')" for i, nm, _ in ER.CATEGORIES) + ") AS nm(category, name)"


@register("dom25_example_counts", with_scored(_BEST + f""",
grid AS (SELECT b.dataset, b.model, nm.category, nm.name FROM best b CROSS JOIN {_NAMES}
         WHERE (nm.category <> 6 OR b.dataset = 'd0') AND (nm.category <> 7 OR b.dataset = 'd1')),
cnt AS (SELECT dataset, category, count(*) AS n_found, count(*) FILTER (WHERE correct) AS n_correct FROM cat GROUP BY ALL),
sz AS (SELECT dataset, count(*) AS n, count(*) FILTER (WHERE orig_class = 'implicit_hate') AS ni FROM br GROUP BY ALL)""") + """
SELECT g.dataset, g.model, g.category, g.name, CAST(coalesce(c.n_found, 0) AS BIGINT) AS n_found,
       CAST(coalesce(c.n_correct, 0) AS BIGINT) AS n_correct,
       round(CAST(coalesce(c.n_found, 0) AS DOUBLE) / CAST(sz.n AS DOUBLE) * 100.0, 6) AS pct_of_set,
       round(CAST(coalesce(c.n_correct, 0) AS DOUBLE)
            / CAST(greatest(coalesce(c.n_found, 0), 1) AS DOUBLE) * 100.0, 6) AS pct_correct,
       CASE WHEN g.category = 6 THEN sz.ni ELSE sz.n END AS out_of
FROM grid g LEFT JOIN cnt c USING (dataset, category) JOIN sz USING (dataset)""")
def q_example_counts(spark, sf_dir):
    return ER.example_counts(scored(spark, sf_dir))


def _label_sql(x):
    return f"CASE WHEN {x} = 0 THEN 'Non-HS' WHEN {x} = 1 THEN 'HS' END"


def _text_sql(x):
    return f"regexp_replace(substring({x}, 1, 110), '^{WS}+|{WS}+$', '', 'g')"


@register("dom25_top_examples", with_scored(_BEST + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY dataset, category ORDER BY
          CASE WHEN category IN (4, 8) THEN abs(l1 - l0) ELSE -abs(l1 - l0) END, ex_id) AS rank FROM cat)""") + f"""
SELECT dataset, category, CAST(rank AS INTEGER) AS rank, model, ex_id, {_text_sql('text')} AS text,
       {_label_sql('label')} AS true_label, {_label_sql('predicted')} AS pred_label,
       round(confidence, 6) AS confidence, orig_class, words
FROM rk WHERE rank <= 8""")
def q_examples(spark, sf_dir):
    return ER.top_examples(scored(spark, sf_dir))


# --- DOM26-28 cross-model ---------------------------------------------------------------
_MODEL_LIST = "[" + ", ".join(f"'{m}'" for m in MODELS) + "]"
_PE = f"""
sx AS (SELECT *, list_position({_MODEL_LIST}, model) - 1 AS idx FROM scored),
pe AS (SELECT dataset, ex_id, CAST(bit_or(1 << idx) AS BIGINT) AS seen_mask,
              CAST(bit_or(CASE WHEN NOT correct THEN (1 << idx) ELSE 0 END) AS BIGINT) AS err_mask,
              CAST(bit_or(CASE WHEN predicted = 1 THEN (1 << idx) ELSE 0 END) AS BIGINT) AS pos_mask,
              avg(confidence) AS avg_conf, first(label) AS label, first(text) AS text,
              first(orig_class) AS orig_class
       FROM sx WHERE idx >= 0 GROUP BY dataset, ex_id)"""


@register("dom26_consensus_failures", with_scored(_PE) + """
SELECT dataset, count(*) FILTER (WHERE seen_mask = 7) AS n_examples, count(*) FILTER (WHERE err_mask = 7) AS n_consensus,
       round(CAST(count(*) FILTER (WHERE err_mask = 7) AS DOUBLE)
             / CAST(greatest(count(*) FILTER (WHERE seen_mask = 7), 1) AS DOUBLE) * 100.0, 6) AS pct_consensus
FROM pe GROUP BY dataset""")
def q_consensus(spark, sf_dir):
    return ER.consensus_failures(scored(spark, sf_dir))


@register("dom26_consensus_examples", with_scored(_PE + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(avg_conf, 12) DESC, ex_id) AS rank
       FROM pe WHERE err_mask = 7)""") + f"""
SELECT dataset, CAST(rank AS INTEGER) AS rank, ex_id, {_text_sql('text')} AS text, {_label_sql('label')} AS true_label,
       """ + ", ".join(f"{_label_sql(f'((pos_mask >> {i}) & 1)')} AS {m}" for i, m in enumerate(MODELS)) + """,
       round(avg_conf, 6) AS avg_conf, orig_class
FROM rk WHERE rank <= 8""")
def q_consensus_examples(spark, sf_dir):
    return ER.consensus_examples(scored(spark, sf_dir))


_PAIRS = "(VALUES " + ", ".join(f"('{a}', '{b}', {i}, {j})" for i, a in enumerate(MODELS)
                                for j, b in enumerate(MODELS)) + ") AS pr(model_a, model_b, i, j)"


_AGREE = f"""
SELECT pe.dataset, pr.model_a, pr.model_b,
       round(CAST(count(*) FILTER (WHERE (seen_mask >> pr.i) & (seen_mask >> pr.j) & 1 = 1
                                   AND ((pos_mask >> pr.i) & 1) = ((pos_mask >> pr.j) & 1)) AS DOUBLE)
             / CAST(nullif(count(*) FILTER (WHERE (seen_mask >> pr.i) & (seen_mask >> pr.j) & 1 = 1), 0) AS DOUBLE), 6) AS agreement
FROM pe CROSS JOIN {_PAIRS} GROUP BY ALL"""


@register("dom27_agreement_matrix", with_scored(_PE) + _AGREE)
def q_agreement(spark, sf_dir):
    return ER.agreement_matrix(scored(spark, sf_dir))


# Models that have scored a part of the examples only: each lacks a fifth, and
# m2 all of d0.
_PARTIAL = """NOT (ex_id % 5 = CASE model WHEN 'm0' THEN 0 WHEN 'm1' THEN 1 ELSE 2 END OR (model = 'm2' AND dataset = 'd0'))"""


@register("dom27_partial_coverage", with_scored(_PE.replace("FROM scored)", f"FROM scored WHERE {_PARTIAL})")) + _AGREE)
def q_agreement_partial(spark, sf_dir):
    return ER.agreement_matrix(scored(spark, sf_dir).where(_PARTIAL), MODELS)


_REGIONS = "(VALUES " + ", ".join(f"({m}, '{nm}')" for m, nm in ER.region_names(MODELS)) + ") AS rg(err_mask, region)"


@register("dom28_error_overlap", with_scored(_PE) + f"""
SELECT d.dataset, rg.region, CAST(rg.err_mask AS BIGINT) AS err_mask,
       (SELECT count(*) FROM pe WHERE pe.dataset = d.dataset AND pe.err_mask = rg.err_mask) AS n_errors
FROM (SELECT DISTINCT dataset FROM pe) d CROSS JOIN {_REGIONS}""")
def q_overlap(spark, sf_dir):
    return ER.error_overlap(scored(spark, sf_dir))


# --- DOM30 findings ---------------------------------------------------------------------
@register("dom30_findings", with_scored(_PE + f""",
bins AS (SELECT model, dataset, {ece_bin_sql('p_hs')} AS bin, count(*) AS nb,
                sum(CAST(label AS DOUBLE)) AS sy, sum(p_hs) AS sp FROM scored GROUP BY ALL),
ec AS (SELECT model, dataset, sum(CASE WHEN bin IS NOT NULL THEN CAST(nb AS DOUBLE) * abs(sy / nb - sp / nb)
              ELSE CAST(0.0 AS DOUBLE) END) / CAST(sum(nb) AS DOUBLE) AS ece FROM bins GROUP BY ALL),
cons AS (SELECT dataset, round(CAST(count(*) FILTER (WHERE err_mask = 7) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0, 6)
                AS pct_consensus FROM pe GROUP BY dataset),
base AS (SELECT model, dataset, {CONFUSION_SQL}, count(*) AS n,
                avg(confidence) FILTER (WHERE correct) AS cc, avg(confidence) FILTER (WHERE NOT correct) AS cw,
                count(*) FILTER (WHERE confidence < CAST('0.9' AS DOUBLE)) AS routed,
                count(*) FILTER (WHERE NOT correct AND label = 1 AND predicted = 0 AND confidence > 0.85) AS n_high_conf_fn
         FROM scored GROUP BY model, dataset)""") + f"""
SELECT model, dataset, round({_mac['macro_f1']}, 6) AS macro_f1, round(ece, 6) AS ece, round(cc - cw, 6) AS conf_gap,
       round(CAST(routed AS DOUBLE) / CAST(n AS DOUBLE) * 100.0, 6) AS pct_to_rag, n_high_conf_fn, pct_consensus
FROM base JOIN ec USING (model, dataset) JOIN cons USING (dataset)""")
def q_findings(spark, sf_dir):
    return ER.findings(scored(spark, sf_dir))
