"""Registered web-page / glossary queries over ``pages`` (SRC9, SCL4-6,
SCL9, SCL12, PRJ9-12, PRJ15, AGG3, AGG17, WIN1, SRT2, DOM1-2, DOM9, DOM33,
DOM35, SET2, GEN2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import web as W
from tessera.functions.text import TOKEN, sql_collapse_ws, sql_strip
from tessera.operators import lexicon as LX
from tessera.operators import webdocs as WD
from tessera.plans.corpus_queries import CHUNKS_CTE, _labelled
from tessera.sources.tables import read_table

QUERIES: dict = {}
SQL: dict = {}
OFFSET = 100000


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _pages(spark, sf_dir):
    return read_table(spark, sf_dir, "pages")


def _q(s):
    return "'" + s.replace("'", "''") + "'"


_BAD = ", ".join(_q(t) for t in W.BAD_TITLES)
_SRC = " ".join(f"WHEN contains(lower(website), {_q(d)}) THEN {_q(n)}" for d, n in W.SOURCE_DOMAINS)
def _tok(x):
    return "regexp_extract_all(" + x + ", '" + TOKEN + "')"


RECORDS_CTE = f"""WITH p0 AS (
  SELECT page_id, {W.sql_canonical_url('url')} AS url, {W.sql_html_to_markdown('html')} AS md,
         {W.sql_page_title('html')} AS title FROM pages),
p1 AS (SELECT *, regexp_replace(url, '/+$', '', 'g') AS u2 FROM p0),
p2 AS (SELECT *, regexp_extract(u2, '^(.*)/[^/]*$', 1) AS website, regexp_extract(u2, '([^/]*)$', 1) AS slug,
              regexp_extract(md, {_q(W.HEADING)}, 1) AS hfull, regexp_extract(md, {_q(W.HEADING)}, 2) AS hname FROM p1),
p3 AS (SELECT *, CASE WHEN starts_with(md, hfull) THEN 1 ELSE strpos(md, chr(10) || hfull) + 1 END AS pos FROM p2),
p4 AS (SELECT *, CASE WHEN hfull <> '' THEN {sql_strip('hname')} WHEN {sql_strip('title')} <> '' THEN {sql_strip('title')}
                      ELSE {sql_strip("replace(slug, '-', ' ')")} END AS name_raw,
                 CASE WHEN hfull <> '' THEN {sql_strip('substr(md, pos + length(hfull))')} ELSE {sql_strip('md')} END AS body_raw
       FROM p3),
p5 AS (SELECT page_id, url, website, slug, title, md, {W.sql_clean_name('name_raw')} AS name,
              {W.sql_clean_body('body_raw')} AS body FROM p4),
records AS (
  SELECT page_id, url, website, slug, name, body, CASE {_SRC} ELSE 'external' END AS source, 'hate' AS label,
         CASE WHEN contains(substring(md, 1, 500), 'Page Not Found') OR contains(lower(substring(md, 1, 1000)), 'couldn''t find the page')
                   OR contains(lower(title), '404') OR contains(lower(title), 'page not found') THEN 'not_found'
              WHEN length({sql_strip('md')}) >= 50 THEN 'ok' ELSE 'too_short' END AS status,
         CASE WHEN length({sql_strip('md')}) < 50 THEN 'markdown_too_short'
              WHEN contains(substring(md, 1, 500), 'Page Not Found') OR contains(lower(substring(md, 1, 1000)), 'couldn''t find the page') THEN 'page_not_found'
              WHEN name = '' THEN 'missing_name'
              WHEN lower({sql_strip('name')}) IN ({_BAD}) THEN 'index_or_listing_page'
              WHEN length(body) < 50 THEN 'body_too_short_after_cleaning'
              ELSE 'parsed_successfully' END AS skip_reason,
         CAST(length(md) AS INTEGER) AS markdown_length
  FROM p5)"""

_SKIP = " AND ".join(f"NOT regexp_matches(link, {_q(p)})" for p in WD.SKIP_PATTERNS)
LINKS_CTE = f"""WITH lx AS (
  SELECT page_id, {W.sql_canonical_url('url')} AS page_url,
         regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) AS o,
         regexp_extract_all(html, '(?is)<a\\b[^>]*?href="([^"]*)"', 1) AS hrefs FROM pages),
lu AS (SELECT page_id, page_url, o, CAST(i - 1 AS INTEGER) AS pos, hrefs[i] AS href
       FROM lx, LATERAL (SELECT unnest(generate_series(1, len(hrefs))) AS i)),
lr AS (SELECT page_id, page_url, pos, {sql_strip("split_part(split_part(href, '#', 1), '?', 1)")} AS h, o FROM lu WHERE contains(href, {_q(WD.DETAIL_PATH)})),
links0 AS (SELECT page_id, page_url, pos,
           {W.sql_canonical_url(W.sql_resolve_href('h', 'o'))} AS link
           FROM lr),
links AS (SELECT * FROM links0 WHERE {_SKIP})"""


@register("scl12_page_records", RECORDS_CTE + """
SELECT page_id, url, website, slug, name, body, source, label, status, skip_reason, markdown_length FROM records""")
def q_records(spark, sf_dir):
    return WD.page_records(_pages(spark, sf_dir))


@register("agg17_skip_counts", RECORDS_CTE + """
SELECT skip_reason, count(*) AS n FROM records GROUP BY skip_reason""")
def q_skip(spark, sf_dir):
    return WD.skip_counts(WD.page_records(_pages(spark, sf_dir)))


@register("scl6_page_links", LINKS_CTE + """
SELECT page_id, page_url, pos, link FROM links""")
def q_links(spark, sf_dir):
    return WD.page_links(_pages(spark, sf_dir))


@register("dom35_link_harvest_log", LINKS_CTE + f""",
lc AS (SELECT page_id, count(*) AS links_found FROM links GROUP BY page_id)
SELECT p.page_id, {W.sql_canonical_url('p.url')} AS page_url, CAST(coalesce(length({W.sql_html_to_markdown('p.html')}), 0) AS INTEGER) AS markdown_length,
       coalesce(lc.links_found, 0) AS links_found,
       CASE WHEN p.html IS NULL THEN 'failed: no content' ELSE 'ok' END AS status
FROM pages p LEFT JOIN lc USING (page_id)""")
def q_harvest(spark, sf_dir):
    return WD.link_harvest_log(_pages(spark, sf_dir))


@register("srt2_unique_links", LINKS_CTE + """
SELECT link, page_id AS first_page_id FROM (
  SELECT *, row_number() OVER (PARTITION BY link ORDER BY page_id, pos) AS rn FROM links) WHERE rn = 1""")
def q_unique_links(spark, sf_dir):
    return WD.unique_links(_pages(spark, sf_dir))


@register("agg3_links_per_source", LINKS_CTE + f""",
ls AS (SELECT *, regexp_extract(page_url, '^[^:]+://([^/]+)', 1) AS site FROM links)
SELECT CASE {_SRC.replace('website', 'site')} ELSE 'external' END AS source, site, count(*) AS links,
       count(DISTINCT link) AS unique_links
FROM ls GROUP BY ALL""")
def q_links_per_source(spark, sf_dir):
    return WD.links_per_source(_pages(spark, sf_dir))


_MAXT, _STRIDE, _MARGIN = WD.WINDOW_MAX_TOKENS, WD.WINDOW_STRIDE, WD.WINDOW_MARGIN
WINDOWS_CTE = RECORDS_CTE + f""",
rec AS (SELECT * FROM records WHERE skip_reason = 'parsed_successfully' AND status = 'ok'),
w0 AS (SELECT *, {sql_collapse_ws("'[' || label || '] ' || name || ': ' || body")} AS full_text,
              '[' || label || '] ' || name || ': ' AS prefix FROM rec),
w1 AS (SELECT *, CAST(len({_tok('full_text')}) AS INTEGER) AS original_token_length, {_tok('prefix')} AS pt,
              {_tok('body')} AS bt FROM w0),
w2 AS (SELECT *, {_MAXT} - len(pt) - {_MARGIN} AS budget, len(bt) AS nb FROM w1),
w3 AS (SELECT *, CASE WHEN nb <= 0 THEN 0 ELSE least(greatest(ceil((nb - budget) / {float(_STRIDE)}), 0),
                                                     ceil(nb / {float(_STRIDE)}) - 1) + 1 END AS k FROM w2),
w4 AS (SELECT *, CASE WHEN original_token_length <= {_MAXT} THEN [full_text]
                      WHEN budget <= 0 THEN [array_to_string(list_concat(pt, bt)[1:{_MAXT}], ' ')]
                      ELSE list_transform(generate_series(0, CAST(k AS BIGINT) - 1),
                             lambda i: {sql_collapse_ws("prefix || array_to_string(bt[i * " + str(_STRIDE) + " + 1 : i * " + str(_STRIDE) + " + budget], ' ')")})
                 END AS texts FROM w3),
w5 AS (SELECT page_id, url, website, slug, name, source, label, original_token_length,
              CAST(i - 1 AS INTEGER) AS "window",
              array_to_string({_tok('texts[i]')}[1:{_MAXT}], ' ') AS text
       FROM w4, LATERAL (SELECT unnest(generate_series(1, len(texts))) AS i)),
chunks_g AS (SELECT row_number() OVER (ORDER BY page_id, "window") - 1 AS chunk_id, *,
                    CAST(len({_tok('text')}) AS INTEGER) AS token_length FROM w5)"""


@register("dom1_token_windows", WINDOWS_CTE + """
SELECT page_id, "window", text, original_token_length FROM w5""")
def q_windows(spark, sf_dir):
    rec = WD.parsed_records(_pages(spark, sf_dir))
    return WD.token_windows(rec).select("page_id", "window", "text", "original_token_length")


@register("dom33_glossary_chunks", WINDOWS_CTE + """
SELECT chunk_id, text, source, label, url, name AS symbol_name, slug, website, original_token_length, token_length
FROM chunks_g""")
def q_glossary(spark, sf_dir):
    g = WD.glossary_chunks(_pages(spark, sf_dir))
    return g.select("chunk_id", "text", "source", "label", "url", "symbol_name", "slug", "website",
                    "original_token_length", "token_length")


@register("dom2_window_cap_check", WINDOWS_CTE + f"""
SELECT count(*) AS n_chunks, max(token_length) AS max_token_length,
       count(*) FILTER (WHERE token_length > {_MAXT}) AS n_over_cap FROM chunks_g""")
def q_cap(spark, sf_dir):
    return WD.window_cap_check(WD.glossary_chunks(_pages(spark, sf_dir)))


# --- DOM33 to the end: several address columns, profile pages, error pages, the lexicon
def _mixed_pages(spark, sf_dir):
    """Every fifth page stands at a profile address (in the first address
    column), every eleventh has an error title, the others have an empty or
    NULL first address."""
    p = _pages(spark, sf_dir)
    k = F.col("page_id")
    return p.select(
        "page_id", F.when(k % 5 == 0, F.concat(F.lit("https://www.splcenter.org/files/entry-"), k.cast("string")))
        .when(k % 5 == 1, "").alias("sourceURL"), F.lit("").alias("source_url"), "url",
        F.when(k % 11 == 0, F.replace("html", F.lit("<title>"), F.lit("<title>404 "))).otherwise(F.col("html")).alias("html"))


def _listings(spark, sf_dir):
    """One listing page per brand, a table row per part; terms recur on other pages."""
    cell = F.concat_ws(" | ", F.concat(F.lit("| **"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("**")),
                       F.when(F.col("p_partkey") % 3 == 0, "English").otherwise(F.col("p_type")),
                       F.col("p_size").cast("string"), F.concat(F.lit("["), F.col("p_brand"), F.lit("](x) |")))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", cell.alias("c")))), lambda x: x["c"]), "\n")
    head = "Showing 1 - 9 of 99 results\n| Term | Language | Sightings | Offensiveness |\n|---|---|---|---|\n"
    return read_table(spark, sf_dir, "part").groupBy("p_brand").agg(F.concat(F.lit(head), rows).alias("markdown")).select(
        F.col("p_brand").alias("filter_group"), F.lit("f").alias("filter_name"), F.lit("group").alias("target_category"),
        F.concat(F.lit("https://x.org/"), F.col("p_brand")).alias("url"), "markdown",
        F.col("p_brand").alias("filter_order"))


def _title(x):
    return (f"array_to_string(list_transform(string_split({x}, ''), lambda ch, i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches(string_split({x}, '')[i - 1], '^\\p{{L}}$') THEN upper(ch) ELSE lower(ch) END), '')")


def _profile_name_sql(x):
    cleaned = sql_collapse_ws(sql_strip(W.sql_apply_rules(sql_strip(x), LX.PROFILE_NAME_CLEAN)))
    bad = ", ".join(_q(b) for b in LX.PROFILE_BAD_NAMES)
    return f"CASE WHEN lower({cleaned}) IN ({bad}) THEN {_title(_SLUG)} ELSE {cleaned} END"


_SLUG = "replace(slug, '-', ' ')"
_LINE_OK = " AND ".join([f"NOT starts_with(lower(x), {_q(b)})" for b in LX.PROFILE_BAD_LINE_STARTS]
                        + ["NOT contains(lower(x), 'splc-extremist-files')", "length(x) >= 2"])
_BAD_TITLE = ", ".join(_q(b) for b in LX.PROFILE_BAD_TITLE_NAMES)
_MIXED_PAGES = """SELECT page_id, coalesce(nullif(CASE WHEN page_id % 5 = 0 THEN 'https://www.splcenter.org/files/entry-' || page_id
       WHEN page_id % 5 = 1 THEN '' END, ''), url) AS url,
       CASE WHEN page_id % 11 = 0 THEN replace(html, '<title>', '<title>404 ') ELSE html END AS html FROM pages"""
_PROFILE_BODY_SQL = sql_collapse_ws(W.sql_apply_rules(W.sql_clean_body(W.sql_apply_rules(
    "regexp_replace(m, '(?is)^.*?\\Q' || pname || '\\E\\s*', ' ')", LX.PROFILE_BODY)), LX.PROFILE_EXTRA))
MIXED_RECORDS = (RECORDS_CTE.replace("FROM pages)", f"FROM ({_MIXED_PAGES}))").replace("records AS (", "generic AS (") + f""",
q0 AS (SELECT *, {W.sql_apply_rules('md', LX.PROFILE_NAV)} AS m FROM p2 WHERE contains(lower(website), 'splcenter.org')),
q1 AS (SELECT *, list_filter(list_transform(string_split(m, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS lines,
              {_profile_name_sql("coalesce(title, '')")} AS cand FROM q0),
q2 AS (SELECT *, CASE WHEN title <> '' AND cand <> '' AND lower(cand) NOT IN ({_BAD_TITLE}) THEN cand END AS title_name,
              list_filter(list_transform(lines[1:30], lambda x: {sql_strip("regexp_replace(x, '^#{1,6}" + chr(92) + "s*', '')")}),
                          lambda x: {_LINE_OK})[1] AS line_name FROM q1),
q3 AS (SELECT *, coalesce(title_name, CASE WHEN line_name IS NOT NULL THEN {_profile_name_sql('line_name')} END, {_title(_SLUG)}) AS n0 FROM q2),
q4 AS (SELECT *, {_profile_name_sql('n0')} AS pname FROM q3),
q5 AS (SELECT *, {_PROFILE_BODY_SQL} AS pbody FROM q4),
records AS (
  SELECT g.page_id, g.url, g.website, g.slug, coalesce(q.pname, g.name) AS name, coalesce(q.pbody, g.body) AS body, g.source, g.label,
         g.status, CASE WHEN q.page_id IS NULL OR g.skip_reason IN ('markdown_too_short', 'page_not_found') THEN g.skip_reason
                        WHEN len(q.lines) = 0 THEN 'splc_no_lines' WHEN length(q.pbody) < 50 THEN 'splc_body_too_short'
                        ELSE 'parsed_successfully' END AS skip_reason, g.markdown_length
  FROM generic g LEFT JOIN q5 q ON q.page_id = g.page_id)""")
MIXED_WINDOWS = MIXED_RECORDS + WINDOWS_CTE[len(RECORDS_CTE):]

_LEXICON_CTE = """
lx0 AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 2 AS row_pos, split_part(p_name, ' ', 1) AS term,
               CASE WHEN p_partkey % 3 = 0 THEN 'English' ELSE p_type END AS language, CAST(p_size AS VARCHAR) AS sightings,
               p_brand AS offensiveness FROM part),
lx1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term, language ORDER BY p_brand, row_pos) AS rn FROM lx0) WHERE rn = 1),
lx AS (SELECT *, '[hate] ' || term || ': Hatebase entry for ' || term || '. Target category: group. Filter group: ' || p_brand
              || '. Language: ' || language || '. Offensiveness: ' || offensiveness || '. Sightings: ' || sightings || '.' AS text FROM lx1)"""


@register("scl11_mixed_records", MIXED_RECORDS + """
SELECT page_id, url, website, slug, name, body, source, label, status, skip_reason, markdown_length FROM records""")
def q_mixed_records(spark, sf_dir):
    return WD.page_records(_mixed_pages(spark, sf_dir))


@register("dom33_full_glossary", MIXED_WINDOWS + "," + _LEXICON_CTE + """
SELECT chunk_id, text, source, label, url, name AS symbol_name, slug, website, original_token_length, token_length, '' AS language,
       '' AS offensiveness, '' AS sightings, '' AS filter_group, '' AS filter_name, '' AS target_category, '' AS showing_range,
       '' AS coverage_note FROM chunks_g
UNION ALL
SELECT row_number() OVER (ORDER BY p_brand, row_pos) - 1 + (SELECT coalesce(max(chunk_id) + 1, 0) FROM chunks_g), text, 'hatebase', 'hate',
       'https://x.org/' || p_brand, term, '', '', n, n, language, offensiveness, sightings, p_brand, 'f', 'group',
       'Showing 1 - 9 of 99 results', 'selected_english_filters'
FROM (SELECT *, CAST(len(string_split(text, ' ')) AS INTEGER) AS n FROM lx)""")
def q_full_glossary(spark, sf_dir):
    return WD.full_glossary(_mixed_pages(spark, sf_dir), _listings(spark, sf_dir))


@register("dom2_window_offenders", WINDOWS_CTE + """
SELECT chunk_id, source, url, name AS symbol_name, token_length, token_length - 40 AS over_by FROM chunks_g WHERE token_length > 40""")
def q_offenders(spark, sf_dir):
    return WD.window_offenders(WD.glossary_chunks(_pages(spark, sf_dir)), 40)


# pages of one source have lost their links
@register("dom35_links_of_sources", MIXED_RECORDS.replace("records AS (", "unused AS (").split(",\nq0 AS")[0].replace("generic AS", "unused AS") + f""",
src AS (SELECT page_id, CASE {_SRC} ELSE 'external' END AS source FROM p2),
lc AS (SELECT page_id, count(*) AS n FROM ({LINKS_CTE} SELECT page_id FROM links) GROUP BY page_id)
SELECT source, count(*) AS pages, CAST(coalesce(sum(CASE WHEN source = 'splc' THEN NULL ELSE n END), 0) AS BIGINT) AS links,
       CASE WHEN coalesce(sum(CASE WHEN source = 'splc' THEN NULL ELSE n END), 0) = 0 THEN 'failed: no URLs found' ELSE 'ok' END AS status
FROM src LEFT JOIN lc USING (page_id) GROUP BY source""")
def q_links_of_sources(spark, sf_dir):
    mixed = _mixed_pages(spark, sf_dir)
    return WD.links_of_sources(mixed.select(
        "page_id", WD.page_url_of(mixed).alias("url"),
        F.when(WD.page_url_of(mixed).contains("splcenter.org"), "").otherwise(F.col("html")).alias("html")))


@register("dom9_full_corpus", CHUNKS_CTE + ",\n" + WINDOWS_CTE[len("WITH "):] + f"""
SELECT chunk_id, text, 'training' AS corpus, '' AS source, '' AS url, '' AS symbol_name FROM chunks
UNION ALL
SELECT chunk_id + greatest({OFFSET}, (SELECT coalesce(max(chunk_id) + 1, 0) FROM chunks)), text, 'documents' AS corpus, source, url, name AS symbol_name FROM chunks_g""")
def q_full(spark, sf_dir):
    from tessera.operators.corpus import build_chunks
    from tessera.operators.vectors import id_offset
    from tessera.session import materialize
    train = materialize(build_chunks(_labelled(spark, sf_dir)).select("chunk_id", "text"))
    gl = WD.glossary_chunks(_pages(spark, sf_dir)).select("chunk_id", "text", "source", "url", "symbol_name")
    # the study's offset, or more once the training ids reach it
    gl = id_offset(gl, train, OFFSET)
    full = train.withColumn("corpus", F.lit("training")).unionByName(
        gl.withColumn("corpus", F.lit("documents")), allowMissingColumns=True)
    return full.fillna("", subset=["source", "url", "symbol_name"])
