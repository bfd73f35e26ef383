"""Lexicon tables from markdown listing pages (PRJ13, SCL13-SCL16, SCL20,
AGG18-AGG19, DOM34) and publisher profile pages (SCL10-SCL11).

Input rows carry one fetched listing page each: (filter_group,
filter_name, target_category, url, markdown[, filter_order]).  Table rows
are exploded per page with their position, so "first occurrence" is
(filter_order, line position) -- an explicit order, not file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import web as W
from tessera.functions.text import WS, collapse_ws, hard_token_cap, strip, word_count
from tessera.operators.corpus import keep_first
from tessera.session import dealt, written

# Fixed values of the listing-page parser: table-cell cleanup in order
# (SCL13), the row filters (PRJ13), the result counter (SCL15), the coverage
# note and the two entry templates (SCL16).
CELL_RULES = [
    (r"(?i)<br\s*/?>", " "),
    (r"\[([^\]]+)\]\([^\)]+\)", "{1}"),
    (r"\*+", ""),
    (r"<[^>]+>", " "),
]
SEPARATOR_ROW = r"^\|\s*:?-+:?\s*(\|\s*:?-+:?\s*)+\|?$"
HEADER_TERMS = ["term", "vocabulary", "read faqs"]
HEADER_LANGUAGES = ["language", "select"]
SHOWING = r"(?i)Showing\s+([\d,]+)\s*-\s*([\d,]+)\s+of\s+([\d,]+)\s+results"
LEXICON_MAX_TOKENS = 50
COVERAGE_NOTE = "selected_english_filters"
ENTRY = ("[%s] %s: Hatebase entry. Target category: %s. Filter group: %s. Language: %s. "
         "Offensiveness: %s. Sightings: %s.")
BODY = ("Hatebase entry for %s. Target category: %s. Filter group: %s. Language: %s. "
        "Offensiveness: %s. Sightings: %s.")


def clean_cell(c: Column) -> Column:
    """SCL13."""
    return collapse_ws(W.apply_rules(strip(c), CELL_RULES))


def table_rows(pages: DataFrame, md: str = "markdown") -> DataFrame:
    """SCL14 + PRJ13: markdown table rows -> (…, row_pos, term, language,
    sightings, offensiveness), skipping separators, short rows, header/UI
    rows and rows whose three other cells are empty.  A page may hold very many
    rows, so its lines are dealt over the tasks before they are parsed."""
    lines = pages.select("*", F.posexplode(F.split(F.col(md), r"\r?\n")).alias("row_pos", "_raw")).drop(md)
    lines = dealt(lines.where(F.col("_raw").contains("|")))
    line = strip("_raw")
    lines = lines.withColumn("_line", line).where(F.col("_line").startswith("|")) \
        .where(~F.col("_line").rlike(SEPARATOR_ROW))
    inner = F.regexp_replace(F.col("_line"), r"^\|+|\|+$", "")
    parts = F.split(inner, r"\|")
    lines = lines.withColumn("_parts", parts).where(F.size("_parts") >= 4)
    cells = [clean_cell(F.element_at("_parts", i + 1)).alias(n)
             for i, n in enumerate(("term", "language", "sightings", "offensiveness"))]
    # generated, not projected: filters on a projection would parse the cells once more each
    rows = lines.select(*[c for c in pages.columns if c != md], "row_pos", F.inline(F.array(F.struct(*cells))))
    return rows.where((F.col("term") != "")
                      & ~F.lower("term").isin(HEADER_TERMS)
                      & ~F.lower("language").isin(HEADER_LANGUAGES)
                      & ~((F.col("language") == "") & (F.col("sightings") == "") & (F.col("offensiveness") == "")))


def showing_range(md: str = "markdown") -> Column:
    """SCL15: 'Showing a - b of n results' -> struct(start, end, total, raw),
    NULL when absent."""
    m = F.col(md)
    raw = F.regexp_extract(m, SHOWING, 0)
    return F.when(raw != "", F.struct(F.regexp_extract(m, SHOWING, 1).alias("start"),
                                      F.regexp_extract(m, SHOWING, 2).alias("end"),
                                      F.regexp_extract(m, SHOWING, 3).alias("total"),
                                      raw.alias("raw")))


def lexicon_entries(pages: DataFrame, label: str = "hate", source: str = "hatebase") -> DataFrame:
    """DOM34: table rows with provenance, keep-first per (term, language)
    in (filter_order, row_pos) order, rendered as entries and chunks."""
    pages = pages if "filter_order" in pages.columns else pages.withColumn("filter_order", F.lit(0))
    pages = pages.withColumns({"showing_range": F.coalesce(showing_range()["raw"], F.lit("")),
                               "coverage_note": F.lit(COVERAGE_NOTE)})
    rows = table_rows(pages).withColumn("source", F.lit(source)).withColumn("label", F.lit(label)) \
        .withColumnRenamed("url", "source_url")
    kept = keep_first(written(rows), ["term", "language"], ["filter_order", "row_pos"])
    entry = F.format_string(
        ENTRY, "label", "term", "target_category", "filter_group", "language", "offensiveness", "sightings")
    body = F.format_string(
        BODY, "term", F.coalesce("target_category", F.lit("")), F.coalesce("filter_group", F.lit("")),
        F.coalesce("language", F.lit("")), F.coalesce("offensiveness", F.lit("")),
        F.coalesce("sightings", F.lit("")))
    chunk = collapse_ws(F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col("term"), F.lit(": "), body))
    return kept.select("*", entry.alias("entry_text"),
                       hard_token_cap(chunk, LEXICON_MAX_TOKENS).alias("text"))


def filter_log(pages: DataFrame, n: int = 5) -> DataFrame:
    """DOM34 audit log: per filter page the table rows found, the result
    counter, the first ``n`` terms and ok / failed (no content)."""
    key = ["filter_group", "filter_name", "target_category", "url"]
    rows = table_rows(pages)
    w = Window.partitionBy(*key).orderBy("row_pos")
    firsts = (rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
              .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_rn", "term"))).alias("_l")))
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return (pages.join(counts, key, "left").join(firsts, key, "left").select(
        *key, F.length(F.coalesce("markdown", F.lit(""))).alias("markdown_length"),
        F.coalesce("_n", F.lit(0)).alias("rows_found"),
        F.coalesce(showing_range()["raw"], F.lit("")).alias("showing_range"),
        F.coalesce(F.array_join(F.transform("_l", lambda s: s["term"]), ", "), F.lit("")).alias("first_terms"),
        F.when(F.col("markdown").isNull(), "failed: no content").otherwise("ok").alias("status")))


def first_terms(rows: DataFrame, by: str = "target_category", n: int = 15) -> DataFrame:
    """AGG18: the first n distinct terms per group (row_number <= n, so the
    partial top-n is cut before the shuffle; the list is bounded by n)."""
    d = keep_first(written(rows.select(by, "term", "filter_order", "row_pos")), [by, "term"], ["filter_order", "row_pos"])
    w = Window.partitionBy(by).orderBy("filter_order", "row_pos")
    top = d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return top.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_rn", "term"))).alias("_l")) \
        .select(by, F.transform("_l", lambda s: s["term"]).alias("first_terms"))


def quality_counts(entries: DataFrame, max_tokens: int = LEXICON_MAX_TOKENS) -> DataFrame:
    """AGG19: non-English rows, residual HTML, empty text, over the cap."""
    return entries.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.lower(F.coalesce("language", F.lit(""))) != "english").alias("n_non_english"),
        F.count_if(F.col("text").rlike("<[^>]+>")).alias("n_residual_html"),
        F.count_if(F.coalesce(strip(F.col("text")), F.lit("")) == "").alias("n_empty_text"),
        F.count_if(word_count("text") > max_tokens).alias("n_over_limit"))


# ---------------------------------------------------------------- profile pages

# Fixed values of the profile-page parser (publisher-specific boilerplate).
PROFILE_NAME_CLEAN = [
    (f"{WS}*\\|.*$", ""),
    (f"{WS}*- Southern Poverty Law Center.*$", ""),
    (f"{WS}*Southern Poverty Law Center{WS}*", ""),
]
PROFILE_BAD_NAMES = ["", "in this article", "notifications", "extremist files", "share", "related", "resources"]
PROFILE_BAD_TITLE_NAMES = ["extremist files", "in this article"]
PROFILE_BAD_LINE_STARTS = ["related:", "born:", "location:", "share", "open dialog", "in this article",
                           "notifications", "citations", "get the latest", "email", "subscribe"]
PROFILE_NAV = [(r"(?is)^.*?Toggle Search\s*", " "), (r"(?is)^.*?Open Menu\s*", " ")]
PROFILE_BODY = [
    (r"(?im)^Related:\s*.*$", " "), (r"(?im)^Born:\s*.*$", " "), (r"(?im)^Location:\s*.*$", " "),
    (r"(?im)^Share\s*$", " "), (r"(?im)^\(Open dialog with sharing options\)\s*$", " "),
    (r"(?im)^SPLC-Extremist-Files-[^\n]+$", " "), (r"(?im)^In this article\s*$", " "),
    (r"(?im)^\s*In his own words\s*$", " In his own words "), (r"(?im)^\s*Background\s*$", " Background "),
    (r"(?is)\bCitations\s+Get the latest updates from.*$", " "),
    (r"(?is)\bGet the latest updates from\s+Southern Poverty Law Center.*$", " "),
    (r"(?is)\bRacial Justice Issues\s+Find Resources.*$", " "),
    (r"(?is)\bPrivacy & Terms\s+Accessibility Statement.*$", " "),
    (r"(?is)Some areas of this page may shift around if you resize the browser window\.?\s*"
     r"Be sure to check heading and document order\.?", " "),
]
PROFILE_EXTRA = [(r"(?i)\bSkip to content\b", " "), (r"(?i)\bClose Alert\b", " "), (r"(?i)\bSPLC Home\b", " "),
                 (r"(?i)\bToggle Search\b", " "), (r"(?i)\bOpen Menu\b", " "), (r"(?i)\bIn this article\b", " ")]


def title_case(c: Column) -> Column:
    """Python ``str.title()``: upper after any non-letter, lower otherwise
    (Spark's initcap only looks at spaces)."""
    chars = F.split(c, "")
    return F.array_join(F.transform(chars, lambda ch, i: F.when(
        (i == 0) | ~F.element_at(chars, i).rlike(r"^\p{L}$"), F.upper(ch)).otherwise(F.lower(ch))), "")


def _profile_name(c: Column, slug: Column) -> Column:
    n = collapse_ws(strip(W.apply_rules(strip(c), PROFILE_NAME_CLEAN)))
    return F.when(F.lower(n).isin(PROFILE_BAD_NAMES), title_case(F.translate(slug, "-", " "))).otherwise(n)


def profile_records(pages: DataFrame, md: str = "md", title: str = "title", slug: str = "slug") -> DataFrame:
    """SCL10 + SCL11: entity name and article body of a profile page; skip
    reasons splc_no_lines / splc_body_too_short."""
    m = W.apply_rules(F.col(md), PROFILE_NAV)
    lines = F.filter(F.transform(F.split(m, r"\n"), lambda x: strip(x)), lambda x: x != "")
    cand = _profile_name(F.coalesce(F.col(title), F.lit("")), F.col(slug))
    title_name = F.when((F.coalesce(F.col(title), F.lit("")) != "") & (cand != "")
                        & ~F.lower(cand).isin(PROFILE_BAD_TITLE_NAMES), cand)
    cleaned = F.transform(F.slice(lines, 1, 30), lambda x: strip(F.regexp_replace(x, r"^#{1,6}\s*", "")))

    def ok(x):
        low = F.lower(x)
        bad = None
        for s in PROFILE_BAD_LINE_STARTS:
            b = low.startswith(s)
            bad = b if bad is None else bad | b
        return ~bad & ~low.contains("splc-extremist-files") & (F.length(x) >= 2)
    line_name = F.element_at(F.filter(cleaned, ok), 1)
    name0 = F.coalesce(title_name, F.when(line_name.isNotNull(), _profile_name(line_name, F.col(slug))),
                       title_case(F.translate(F.col(slug), "-", " ")))
    df = pages.select("*", m.alias("_m"), F.size(lines).alias("_nlines"),
                      _profile_name(name0, F.col(slug)).alias("name"))
    cut = F.regexp_replace(F.col("_m"), F.concat(F.lit("(?isu)^.*?\\Q"), F.col("name"), F.lit("\\E\\s*")), F.lit(" "))
    body = W.apply_rules(cut, PROFILE_BODY)
    body = collapse_ws(W.apply_rules(W.clean_body(body), PROFILE_EXTRA))
    df = df.withColumn("body", body)
    reason = (F.when(F.col("_nlines") == 0, F.lit("splc_no_lines"))
              .when(F.length("body") < W.MIN_CHARS, F.lit("splc_body_too_short"))
              .otherwise(F.lit("parsed_successfully")))
    return df.withColumn("skip_reason", reason).drop("_m", "_nlines")
