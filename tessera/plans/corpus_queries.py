"""Registered corpus queries over ``documents`` / ``labels``
(SCL1-3, SCL19-21, PRJ1, PRJ5-8, WIN1-2, JN2-3, SET3-4, GEN1, AGG2, AGG4-7,
AGG16, SMP1, SRT1, DOM31-32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import corpus as CO
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


def _rows(spark, sf_dir):
    return CO.corpus_rows(read_table(spark, sf_dir, "documents"))


def _labelled(spark, sf_dir):
    return CO.labelled_corpus(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_NORM = TX.sql_strip("lower(text)")
ROWS_CTE = f"""WITH rows AS (
  SELECT doc_id AS row_idx,
         CASE WHEN n < 7 THEN 'A' WHEN n < 14 THEN 'B' ELSE 'C' END AS corpus,
         CASE WHEN n < 7 THEN 0 WHEN n < 14 THEN 1 ELSE 2 END AS priority,
         text, {_NORM} AS norm
  FROM (SELECT *, TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS n FROM documents))"""

_MD5_BUCKET = "CAST(('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 AS INTEGER)"
LABELLED_CTE = f"""WITH lab AS (
  SELECT d.doc_id AS ex_id,
         CASE WHEN n < 7 THEN 'A' WHEN n < 14 THEN 'B' ELSE 'C' END AS corpus,
         CASE WHEN n < 7 THEN 0 WHEN n < 14 THEN 1 ELSE 2 END AS priority,
         CASE WHEN {_MD5_BUCKET} < 10 THEN 'test' ELSE 'train' END AS split,
         d.text,
         CASE WHEN l.toxic = 0 THEN 'not_hate' WHEN l.quality = 0 THEN 'explicit_hate' ELSE 'implicit_hate' END AS orig_class
  FROM (SELECT *, TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS n FROM documents) d
  JOIN labels l ON d.doc_id = l.doc_id),
lab2 AS (SELECT *, CASE WHEN orig_class = 'not_hate' THEN 0 ELSE 1 END AS label,
                CASE WHEN orig_class = 'not_hate' THEN 'not_hate' ELSE 'hate' END AS label_name FROM lab)"""

CHUNKS_CTE = LABELLED_CTE + f""",
tr AS (SELECT *, {TX.sql_strip('lower(text)')} AS norm FROM lab2 WHERE split = 'train'),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY priority, ex_id) AS rn FROM tr) WHERE rn = 1),
pre AS (SELECT priority, ex_id, '[' || replace(label_name, '_', ' ') || '] ' || text AS text FROM kept),
ids AS (SELECT *, row_number() OVER (ORDER BY priority, ex_id) - 1 AS chunk_id0,
               {TX.sql_word_count('text')} AS token_length FROM pre),
chunks AS (SELECT row_number() OVER (ORDER BY chunk_id0) - 1 AS chunk_id, text, token_length, chunk_id0
           FROM ids WHERE token_length <= 64)"""


# --- SCL1-3, SCL19-21 -----------------------------------------------------------
@register("scl1_text_normalisers", f"""
SELECT doc_id, {_NORM} AS norm, {TX.sql_collapse_ws('text')} AS collapsed,
       CASE WHEN length({TX.sql_collapse_ws('text')}) > 300 THEN substring({TX.sql_collapse_ws('text')}, 1, 300) || '...'
            ELSE {TX.sql_collapse_ws('text')} END AS preview,
       {TX.sql_word_count('text')} AS n_words,
       array_to_string({TX.sql_tokens('text')}[1:64], ' ') AS capped_64
FROM documents""")
def q_normalisers(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.dedup_norm("text").alias("norm"), TX.collapse_ws("text").alias("collapsed"),
                    TX.preview("text", 300).alias("preview"), TX.word_count("text").alias("n_words"),
                    TX.hard_token_cap("text", 64).alias("capped_64"))


# --- PRJ1 / PRJ5 labelled corpus ---------------------------------------------------
@register("prj1_labelled_corpus", LABELLED_CTE + """
SELECT ex_id, corpus, priority, split, orig_class, label, label_name FROM lab2""")
def q_labelled(spark, sf_dir):
    return _labelled(spark, sf_dir).select("ex_id", "corpus", "priority", "split", "orig_class",
                                           "label", "label_name")


@register("prj5_holdout_split", LABELLED_CTE + """
SELECT split, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_positive FROM lab2 GROUP BY split""")
def q_split(spark, sf_dir):
    lab = _labelled(spark, sf_dir)
    return lab.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n_positive"))


@register("prj5_exact_holdout", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT)
                         <= ceil(count(*) OVER () / 10.0) THEN 'test' ELSE 'train' END AS split FROM documents""")
def q_exact_split(spark, sf_dir):
    return CO.exact_holdout(read_table(spark, sf_dir, "documents", spread_rows=False).select("doc_id"))


# --- WIN1 / WIN2 / JN2 dedup ------------------------------------------------------------
@register("win1_internal_dedup", ROWS_CTE + """
SELECT row_idx, corpus FROM (
  SELECT *, row_number() OVER (PARTITION BY corpus, norm ORDER BY row_idx) AS rn FROM rows) WHERE rn = 1""")
def q_internal(spark, sf_dir):
    return CO.internal_dedup(_rows(spark, sf_dir)).select("row_idx", "corpus")


_CASCADE_SQL = ROWS_CTE + """
SELECT row_idx, corpus FROM (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY priority, row_idx) AS rn FROM rows) WHERE rn = 1"""


@register("win2_cascade_dedup", _CASCADE_SQL)
def q_cascade(spark, sf_dir):
    return CO.cascade_dedup(_rows(spark, sf_dir)).select("row_idx", "corpus")


@register("jn2_cascade_antijoin", _CASCADE_SQL)
def q_cascade_anti(spark, sf_dir):
    return CO.cascade_dedup_anti(_rows(spark, sf_dir)).select("row_idx", "corpus")


# --- AGG16 / SET3 / DOM31 ----------------------------------------------------------------
@register("agg16_duplicate_stats", ROWS_CTE + """,
k AS (SELECT corpus, norm, count(*) AS c FROM rows GROUP BY ALL)
SELECT corpus, CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(c) - count(*) AS BIGINT) AS extra_copies,
       CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS BIGINT) AS in_duplicate_groups
FROM k GROUP BY corpus""")
def q_dup_stats(spark, sf_dir):
    return CO.duplicate_stats(_rows(spark, sf_dir))


@register("set3_pairwise_overlap", ROWS_CTE + """,
a AS (SELECT DISTINCT corpus, norm FROM rows)
SELECT x.corpus AS corpus_a, y.corpus AS corpus_b, count(*) AS n_overlap
FROM (SELECT * FROM (VALUES ('A', 'B'), ('A', 'C'), ('B', 'C')) AS p(ca, cb)) p
JOIN a x ON x.corpus = p.ca JOIN a y ON y.corpus = p.cb AND x.norm = y.norm
GROUP BY ALL""")
def q_overlap(spark, sf_dir):
    return CO.pairwise_overlap(_rows(spark, sf_dir))


@register("dom31_dedup_report", ROWS_CTE + """,
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY priority, row_idx) AS rn FROM rows) WHERE rn = 1),
b AS (SELECT corpus, count(*) AS before, count(*) - count(DISTINCT norm) AS internal_copies FROM rows GROUP BY corpus),
a AS (SELECT corpus, count(*) AS after FROM kept GROUP BY corpus)
SELECT b.corpus, before, coalesce(after, 0) AS after, before - coalesce(after, 0) AS removed, internal_copies,
       before - coalesce(after, 0) - internal_copies AS cross_copies
FROM b LEFT JOIN a USING (corpus)""")
def q_dedup_report(spark, sf_dir):
    return CO.dedup_report(_rows(spark, sf_dir))


@register("dom31_sample_group", ROWS_CTE + """,
g AS (SELECT norm, count(*) AS n, min(row_idx) AS f FROM rows GROUP BY norm HAVING count(*) > 1
      ORDER BY n DESC, f LIMIT 1)
SELECT row_idx, corpus, n AS group_size FROM rows JOIN g USING (norm) ORDER BY row_idx LIMIT 3""")
def q_sample_group(spark, sf_dir):
    return CO.sample_group(_rows(spark, sf_dir))


@register("set4_union_keys", ROWS_CTE + """
SELECT DISTINCT norm FROM rows WHERE corpus IN ('A', 'B')""")
def q_union_keys(spark, sf_dir):
    r = _rows(spark, sf_dir)
    a = r.where(F.col("corpus") == "A").select("norm")
    b = r.where(F.col("corpus") == "B").select("norm")
    return a.union(b).distinct()


# --- AGG2 / AGG4 / AGG5 -----------------------------------------------------------------
@register("agg2_value_counts_source", """
SELECT coalesce(CAST(source AS VARCHAR), '') AS value, count(*) AS n FROM documents GROUP BY ALL
ORDER BY n DESC, value LIMIT 50""")
def q_value_counts(spark, sf_dir):
    return CO.value_counts(read_table(spark, sf_dir, "documents"), "source", 50)


@register("agg4_group_sizes_with_nulls", """
SELECT d.lang, CAST(l.toxic AS VARCHAR) AS toxic, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
GROUP BY ALL""")
def q_group_nulls(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    l = read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("toxic"))
    return d.join(l, "doc_id", "left").groupBy("lang", "toxic").agg(F.count(F.lit(1)).alias("n"))


@register("agg5_distinct_counts", ROWS_CTE + """,
j AS (SELECT r.*, d.lang, d.source FROM rows r JOIN documents d ON d.doc_id = r.row_idx)
SELECT count(DISTINCT lang) AS n_langs, count(DISTINCT source) AS n_sources, count(DISTINCT norm) AS n_texts,
       count(DISTINCT (lang, norm)) AS n_lang_text_pairs FROM j""")
def q_distinct(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    n = F.md5(TX.dedup_norm("text"))     # digests: the texts themselves are not expanded
    return d.agg(F.countDistinct("lang").alias("n_langs"), F.countDistinct("source").alias("n_sources"),
                 F.countDistinct(n).alias("n_texts"), F.countDistinct("lang", n).alias("n_lang_text_pairs"))


# --- DOM32 corpus build, GEN1, PRJ6-8, AGG6-7, SMP1 ---------------------------------------
@register("dom32_corpus_build", CHUNKS_CTE + """
SELECT chunk_id, text, token_length FROM chunks""")
def q_chunks(spark, sf_dir):
    return CO.build_chunks(_labelled(spark, sf_dir)).select("chunk_id", "text", "token_length")


@register("gen1_contiguous_ids", CHUNKS_CTE + """
SELECT ex_id, chunk_id0 AS chunk_id FROM ids""")
def q_ids(spark, sf_dir):
    from tessera.operators.prefix import contiguous_ids
    lab = _labelled(spark, sf_dir).where(F.col("split") == "train").withColumn("norm", TX.dedup_norm("text"))
    kept = CO.keep_first(lab, ["norm"], ["priority", "ex_id"])
    return contiguous_ids(kept.select("priority", "ex_id"), [F.col("priority"), F.col("ex_id")],
                          "chunk_id").select("ex_id", "chunk_id")


@register("prj8_length_filter", CHUNKS_CTE + """
SELECT (SELECT count(*) FROM ids) AS before, (SELECT count(*) FROM chunks) AS after,
       (SELECT count(*) FROM ids) - (SELECT count(*) FROM chunks) AS removed""")
def q_len_filter(spark, sf_dir):
    lab = _labelled(spark, sf_dir).where(F.col("split") == "train").withColumn("norm", TX.dedup_norm("text"))
    kept = CO.keep_first(lab, ["norm"], ["priority", "ex_id"])
    sized = kept.select(TX.word_count(CO.label_prefix("text", "label_name")).alias("t"))
    return sized.agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("t") <= 64).alias("after"),
                     F.count_if(F.col("t") > 64).alias("removed"))


@register("prj7_strip_label_prefix", CHUNKS_CTE + """
SELECT chunk_id, CASE WHEN strpos(t1, '[not hate] ') > 0
                      THEN substr(t1, 1, strpos(t1, '[not hate] ') - 1) || substr(t1, strpos(t1, '[not hate] ') + 11)
                      ELSE t1 END AS text
FROM (SELECT chunk_id, CASE WHEN strpos(text, '[hate] ') > 0
                            THEN substr(text, 1, strpos(text, '[hate] ') - 1) || substr(text, strpos(text, '[hate] ') + 7)
                            ELSE text END AS t1 FROM chunks)""")
def q_strip_prefix(spark, sf_dir):
    c = CO.build_chunks(_labelled(spark, sf_dir))
    return c.select("chunk_id", CO.strip_label_prefix("text").alias("text"))


_PREFIXED = LABELLED_CTE + f""",
pl AS (SELECT corpus, {TX.sql_word_count("'[' || replace(label_name, '_', ' ') || '] ' || text")} AS token_length FROM lab2)"""


@register("agg6_length_profile", _PREFIXED + """
SELECT corpus, count(*) AS n, round(avg(token_length), 6) AS mean,
       round(quantile_cont(CAST(token_length AS DOUBLE), 0.5), 6) AS median,
       round(quantile_cont(CAST(token_length AS DOUBLE), 0.95), 6) AS p95,
       max(token_length) AS max, count(*) FILTER (WHERE token_length > 64) AS n_over_limit
FROM pl GROUP BY corpus""")
def q_profile(spark, sf_dir):
    lab = _labelled(spark, sf_dir)
    t = lab.select("corpus", TX.word_count(CO.label_prefix("text", "label_name")).alias("token_length"))
    return CO.length_profile(t, "token_length", 64, ["corpus"])


@register("agg7_length_histogram", _PREFIXED + """,
m0 AS (SELECT CAST(min(token_length) AS DOUBLE) AS a, CAST(max(token_length) AS DOUBLE) AS z FROM pl),
mm AS (SELECT CASE WHEN a = z THEN a - 0.5 ELSE a END AS mn, CASE WHEN a = z THEN z + 0.5 ELSE z END AS mx FROM m0),
raw AS (SELECT CAST(token_length AS DOUBLE) AS v, mn, mx,
               CAST(least(greatest(coalesce(floor((CAST(token_length AS DOUBLE) - mn) * (50.0 / (mx - mn))), 0), 0), 49) AS INTEGER) AS i0
        FROM pl, mm),
b AS (SELECT CASE WHEN v < (CASE WHEN i0 >= 50 THEN mx ELSE mn + CAST(i0 AS DOUBLE) * ((mx - mn) / 50.0) END) THEN i0 - 1
                  WHEN i0 <> 49 AND v >= (CASE WHEN i0 + 1 >= 50 THEN mx ELSE mn + CAST(i0 + 1 AS DOUBLE) * ((mx - mn) / 50.0) END) THEN i0 + 1
                  ELSE i0 END AS bin FROM raw),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
g AS (SELECT CAST(k AS INTEGER) AS bin, mn, mx FROM mm, range(0, 50) AS r(k))
SELECT g.bin, round(CASE WHEN g.bin >= 50 THEN mx ELSE mn + CAST(g.bin AS DOUBLE) * ((mx - mn) / 50.0) END, 6) AS lo,
       round(CASE WHEN g.bin + 1 >= 50 THEN mx ELSE mn + CAST(g.bin + 1 AS DOUBLE) * ((mx - mn) / 50.0) END, 6) AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM g LEFT JOIN c USING (bin)""")
def q_hist(spark, sf_dir):
    lab = _labelled(spark, sf_dir)
    t = lab.select(TX.word_count(CO.label_prefix("text", "label_name")).alias("token_length"))
    return CO.histogram(t, "token_length", 50)


@register("smp1_seeded_sample", CHUNKS_CTE + """
SELECT chunk_id, text FROM chunks ORDER BY md5('42:' || CAST(chunk_id AS VARCHAR)), chunk_id LIMIT 3""")
def q_sample(spark, sf_dir):
    c = CO.build_chunks(_labelled(spark, sf_dir)).select("chunk_id", "text")
    return CO.seeded_sample(c, "chunk_id", 3, 42)


@register("srt1_top_longest_documents", """
SELECT doc_id, n_chars, lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10""")
def q_top_longest(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return d.orderBy(F.col("n_chars").desc(), F.col("doc_id")).limit(10)
