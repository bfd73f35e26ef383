"""Quality rules, line first (DataFrame functions only).

Every line is judged by punctuation, navigation, symbol, shouting and
boilerplate rules; failing lines are removed, then a document that loses
too large a share of its words is rejected.  All work stays inside the row
(array functions, no explode, no shuffle), so a hot source or key does not
matter and the scan is the only stage.

Repeated 5-word windows are found on sorted 64-bit hashes of the windows;
the positions are looked up only in texts that have a repeat.

Defined results: null and empty texts have no word, fail the base rules and
are not kept; null ids and repeated rows are judged like any other; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed by the contract: blanks, symbols, window of words, base limits.
BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20

#: Line rules.
SENTENCE_END = r"[.!?…:;\"'”’»)\]][\x20\x09-\x0D]*$"
SHORT_LINE = 3
SHOUT = r"[!?][!?]+"
SEPARATOR = r"[|»•·>]"
MARK_PCT = 10
SHORT_PARAGRAPH = 25
BOILERPLATE = (r"(?i)(all rights reserved|licensed under|public license|privacy policy|terms of (use|service)"
               r"|cookie(s)? (policy|settings|consent)|accept (all )?cookies|enable javascript|lorem ipsum"
               r"|subscribe to our newsletter|sign up|log in|click here|read more|skip to (main )?content"
               r"|copyright ©|© [0-9]{4})")
MIN_KEPT_PCT = 50


def line_fails(line: Column, n: Column) -> Column:
    """Whether a line of ``n`` words, one at least, breaks a rule."""
    marks = F.length(F.regexp_replace(line, NOT_SYMBOL, ""))
    return (
        ((n <= SHORT_LINE) & ~F.rlike(line, F.lit(SENTENCE_END)))
        | (100 * F.regexp_count(line, F.lit(SHOUT)) > MARK_PCT * n)
        | (100 * F.regexp_count(line, F.lit(SEPARATOR)) > MARK_PCT * n)
        | (100 * marks > 2 * MARK_PCT * n)
        | ((n <= SHORT_PARAGRAPH) & F.rlike(line, F.lit(BOILERPLATE))))


def quality_rules(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept`` and, after them, ``n_bad_lines, kept_words``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    line = lambda x: F.struct(x.alias("x"), F.split(F.btrim(x, F.lit(BLANKS)), BLANK).alias("w"))
    step = docs.select(
        "doc_id", F.length(F.regexp_replace(text, NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
        F.filter(F.transform(F.split(text, "\n", -1), line),
                 lambda s: F.get(s["w"], F.lit(0)) != "").alias("lines"))
    bad = F.filter("lines", lambda s: line_fails(s["x"], F.size(s["w"])))
    step = step.select(
        "doc_id", "n_symbols", F.col("lines.x").alias("lines"), F.flatten("lines.w").alias("w"),
        F.transform(bad, lambda s: F.size(s["w"])).alias("bad"))
    step = step.select(
        "doc_id", "n_symbols", "lines", "bad", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    step = step.select(
        "*", F.when(F.size("w") >= WINDOW, F.transform(
            F.slice("w", 1, F.greatest(F.size("w") - (WINDOW - 1), F.lit(1))),
            lambda x, i: F.xxhash64(x, *(F.get(F.col("w"), i + j) for j in range(1, WINDOW)))))
        .otherwise(F.array().cast("array<bigint>")).alias("win"))
    step = step.select("*", F.sort_array("win").alias("sorted")).drop("w")
    has_repeat = F.size("sorted") > F.size(F.array_distinct("sorted"))
    placed = F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "bad",
        F.when(has_repeat, placed).alias("placed"))
    twins = F.transform("placed", lambda x, k: F.when(
        (F.get(F.col("placed"), k - 1)["h"] == x["h"]) | (F.get(F.col("placed"), k + 1)["h"] == x["h"]), x["i"]))
    step = step.withColumn("twins", F.when(F.col("placed").isNotNull(), F.sort_array(
        F.filter(twins, lambda i: i.isNotNull()))).otherwise(F.array().cast("array<int>"))).drop("placed")
    covered = F.transform("twins", lambda p, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get(F.col("twins"), k + 1) - p, F.lit(WINDOW))))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    step = step.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        total(covered).alias("n_repeat_words"),
        F.size("bad").cast("long").alias("n_bad_lines"),
        (F.col("n_words") - total(F.col("bad"))).alias("kept_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return step.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (100 * F.col("kept_words") >= MIN_KEPT_PCT * F.col("n_words"))).alias("kept"),
        "n_bad_lines", "kept_words")


#: The same in DuckDB SQL.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]+')) AS lines
  FROM d
), win AS (
  SELECT r, i, list_slice(w, i, i + 4) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, CAST(count(DISTINCT i + j) AS BIGINT) AS n
  FROM twice, (SELECT unnest(range(0, 5)) AS j) GROUP BY r
), lines AS (
  SELECT r, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT r, unnest(lines) AS x FROM t)
), bad AS (
  SELECT r, CAST(count(*) AS BIGINT) AS n_bad, CAST(sum(n) AS BIGINT) AS n_words
  FROM lines
  WHERE (n <= 3 AND NOT regexp_matches(x, '[.!?…:;"''”’»)\]][\x20\x09-\x0D]*$'))
     OR 100 * len(regexp_extract_all(x, '[!?][!?]+')) > 10 * n
     OR 100 * len(regexp_extract_all(x, '[|»•·>]')) > 10 * n
     OR 100 * length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) > 20 * n
     OR (n <= 25 AND regexp_matches(x, '<BOILERPLATE>'))
  GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, coalesce(bad.n_bad, 0) AS n_bad_lines,
         CAST(len(w) AS BIGINT) - coalesce(bad.n_words, 0) AS kept_words
  FROM t LEFT JOIN rep USING (r) LEFT JOIN bad USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND 100 * kept_words >= 50 * n_words AS kept,
       n_bad_lines, kept_words
FROM m
""".replace("<BOILERPLATE>", BOILERPLATE)
