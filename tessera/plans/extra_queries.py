"""Registered queries: ML scoring (DOM11), KDE (AGG15), class breakdown
(DOM29) and retrieval context (DOM36)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import TOKEN
from tessera.operators import density as DN
from tessera.operators import metrics as M
from tessera.operators import vectors as V
from tessera.operators import errors as ER
from tessera.operators.classify import hashed_naive_bayes, train_and_score
from tessera.operators.corpus import build_chunks, labelled_corpus
from tessera.plans.fixtures import DATASETS, SCORED_SQL, scored
from tessera.plans.sql import with_scored
from tessera.plans.analysis_queries import _TIES
from tessera.plans.corpus_queries import CHUNKS_CTE, LABELLED_CTE, _labelled
from tessera.plans.vector_queries import _hashed_sql, _norm_sql
from tessera.session import materialize
from tessera.sources.tables import read_table

QUERIES: dict = {}
SQL: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _ml_scored(spark, sf_dir):
    lab = labelled_corpus(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    lab = lab.withColumn("dataset", F.concat(F.lit("d"), (F.col("ex_id") % 3).cast("string")))
    return train_and_score(lab, DATASETS)


# --- DOM11: real training / scoring; no SQL twin (iterative fits) ----------
@register("dom11_ml_scored")
def q_ml(spark, sf_dir):
    s = _ml_scored(spark, sf_dir)
    return s.select("model", "dataset", "ex_id", "label", "predicted", F.round("confidence", 6).alias("confidence"))


@register("dom11_ml_summary")
def q_ml_summary(spark, sf_dir):
    return M.performance_summary(_ml_scored(spark, sf_dir))


# --- DOM11 in closed form: hashed naive Bayes, and the summary on its scores ------
_B = "CAST(('0x' || substr(md5(lower(t)), 1, 8))::BIGINT % 4096 AS INTEGER)"
_NB = LABELLED_CTE + f""",
ds AS (SELECT *, 'd' || CAST(ex_id % 3 AS VARCHAR) AS dataset FROM lab2),
tk AS (SELECT dataset, split, ex_id, label, {_B} AS b
       FROM (SELECT dataset, split, ex_id, label, unnest(regexp_extract_all(text, '{TOKEN}')) AS t FROM ds)),
ct AS (SELECT dataset, b, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1
       FROM tk WHERE split = 'train' GROUP BY ALL),
su AS (SELECT dataset, CAST(sum(n0) AS BIGINT) AS t0, CAST(sum(n1) AS BIGINT) AS t1 FROM ct GROUP BY ALL),
dc AS (SELECT dataset, count(*) FILTER (WHERE label = 0) AS d0, count(*) FILTER (WHERE label = 1) AS d1
       FROM ds WHERE split = 'train' GROUP BY ALL),
tt AS (SELECT dc.*, coalesce(t0, 0) AS t0, coalesce(t1, 0) AS t1 FROM dc LEFT JOIN su USING (dataset)
       WHERE d0 > 0 AND d1 > 0),
pt AS (SELECT dataset, ex_id, b, CAST(count(*) AS DOUBLE) AS c FROM tk WHERE split = 'test' GROUP BY ALL),
ps AS (SELECT pt.dataset, pt.ex_id,
              sum(c * ln((coalesce(n0, 0) + CAST(1.0 AS DOUBLE)) / (t0 + CAST(4096.0 AS DOUBLE)))) AS s0,
              sum(c * ln((coalesce(n1, 0) + CAST(1.0 AS DOUBLE)) / (t1 + CAST(4096.0 AS DOUBLE)))) AS s1
       FROM pt JOIN tt USING (dataset) LEFT JOIN ct USING (dataset, b) GROUP BY ALL),
scored_logits AS (SELECT 'hashed_nb' AS model, ds.dataset, ds.ex_id, text, label, orig_class,
       round(ln(CAST(d0 AS DOUBLE) / (d0 + d1)) + coalesce(s0, 0), 9) AS l0,
       round(ln(CAST(d1 AS DOUBLE) / (d0 + d1)) + coalesce(s1, 0), 9) AS l1
       FROM ds JOIN tt USING (dataset) LEFT JOIN ps USING (dataset, ex_id) WHERE split = 'test'),
""" + SCORED_SQL[SCORED_SQL.index("scored_p AS"):]


def _nb_scored(spark, sf_dir):
    lab = _labelled(spark, sf_dir).withColumn("dataset", F.concat(F.lit("d"), (F.col("ex_id") % 3).cast("string")))
    return hashed_naive_bayes(lab)


@register("dom11_naive_bayes", _NB + """
SELECT model, dataset, ex_id, label, predicted, round(l1 - l0, 6) AS log_odds, round(confidence, 6) AS confidence
FROM scored""")
def q_nb(spark, sf_dir):
    s = _nb_scored(spark, sf_dir)
    return s.select("model", "dataset", "ex_id", "label", "predicted", F.round(F.col("l1") - F.col("l0"), 6).alias("log_odds"),
                    F.round("confidence", 6).alias("confidence"))


@register("dom17_naive_bayes_auc", _NB + "," + _TIES + """
SELECT model, dataset, CAST(sum(npos) AS BIGINT) AS P, CAST(sum(nneg) AS BIGINT) AS N,
       coalesce(round(CASE WHEN sum(npos) > 0 AND sum(nneg) > 0 THEN
             CAST(sum(nneg * (2 * cum_npos - npos)) AS DOUBLE) / (2.0 * CAST(sum(npos) AS DOUBLE) * CAST(sum(nneg) AS DOUBLE)) END, 6), -1) AS roc_auc
FROM cum GROUP BY model, dataset""")
def q_nb_auc(spark, sf_dir):
    a = M.auc_ap(materialize(_nb_scored(spark, sf_dir)))
    return a.select("model", "dataset", "P", "N", F.coalesce(F.round("roc_auc", 6), F.lit(-1.0)).alias("roc_auc"))


@register("dom28_naive_bayes_errors", _NB + """
SELECT dataset, 'only hashed_nb' AS region, CAST(1 AS BIGINT) AS err_mask, count(*) FILTER (WHERE NOT correct) AS n_errors
FROM scored GROUP BY dataset""")
def q_nb_errors(spark, sf_dir):
    return ER.error_overlap(materialize(_nb_scored(spark, sf_dir)))


# --- AGG15 KDE of confidence, per (model, dataset, correct) -----------------------
@register("agg15_confidence_kde", with_scored("""
st AS (SELECT model, dataset, correct, count(confidence) AS n, stddev_samp(confidence) AS sd,
              min(confidence) AS mn, max(confidence) AS mx FROM scored GROUP BY ALL),
st2 AS (SELECT *, pow(CAST(n AS DOUBLE), -0.2) * sd AS bw FROM st WHERE n >= 3 AND sd > 0),
st3 AS (SELECT *, mn - 2.0 * bw AS lo, (mx - mn + 4.0 * bw) / 99 AS step FROM st2),
g AS (SELECT s.model, s.dataset, s.correct, CAST(r.i AS INTEGER) AS i, st3.lo + CAST(r.i AS DOUBLE) * st3.step AS x,
             exp(-0.5 * pow(((st3.lo + CAST(r.i AS DOUBLE) * st3.step) - s.confidence) / st3.bw, 2)) AS k, st3.n, st3.bw
      FROM scored s JOIN st3 USING (model, dataset, correct), range(0, 100) AS r(i))""") + """
SELECT model, dataset, correct, i, round(first(x), 6) AS x,
       round(sum(k) / (CAST(first(n) AS DOUBLE) * first(bw) * sqrt(2 * pi())), 6) AS density
FROM g GROUP BY model, dataset, correct, i""")
def q_kde(spark, sf_dir):
    return DN.kde(scored(spark, sf_dir), ["model", "dataset", "correct"], "confidence")


# --- DOM29 implicit vs explicit breakdown ---------------------------------------------
@register("dom29_class_breakdown", with_scored() + """
SELECT model, dataset, orig_class, count(*) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy,
       round(avg(confidence), 6) AS conf_mean, round(quantile_cont(confidence, 0.25), 6) AS q1,
       round(quantile_cont(confidence, 0.5), 6) AS median, round(quantile_cont(confidence, 0.75), 6) AS q3
FROM scored WHERE orig_class IS NOT NULL GROUP BY ALL""")
def q_breakdown(spark, sf_dir):
    return DN.class_breakdown(scored(spark, sf_dir))


# --- DOM36 retrieval context for text queries ------------------------------------------
@register("dom36_rag_context", CHUNKS_CTE + f""",
hd AS {_hashed_sql('chunks', 'chunk_id')},
nd AS {_norm_sql('hd', 'chunk_id', 'embedding')},
hb AS {_hashed_sql('benchmark', 'item_id')},
nb AS {_norm_sql('hb', 'item_id', 'embedding')},
pairs AS (SELECT q.item_id AS query_id, c.chunk_id, round(list_inner_product(q.e, c.e), 12) AS s FROM nb q, nd c),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM pairs)
        WHERE rank <= 3),
tx AS (SELECT top.query_id, top.rank, array_to_string(regexp_extract_all(d.text, '{TOKEN}')[1:64], ' ') AS t
       FROM top JOIN chunks d ON d.chunk_id = top.chunk_id)
SELECT query_id, string_agg(t, ' [SEP] ' ORDER BY rank) AS context, CAST(count(*) AS INTEGER) AS n_hits
FROM tx GROUP BY query_id""")
def q_context(spark, sf_dir):
    bench = read_table(spark, sf_dir, "benchmark")
    chunks = materialize(build_chunks(_labelled(spark, sf_dir)).select("chunk_id", "text"))
    corpus = materialize(V.hashed_embeddings(chunks, "chunk_id", "text", 64))
    queries = V.hashed_embeddings(bench, "item_id", "text", 64, out_id="query_id") \
        .withColumn("self_id", F.lit(None).cast("long"))
    hits = V.search(queries, corpus, k=3)
    return DN.rag_context(hits, chunks, 64)
