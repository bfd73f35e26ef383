"""Glossary corpus from web pages (SRC9, SCL6, SCL12, PRJ9-PRJ12, AGG3,
AGG17, DOM1-DOM2, DOM33, DOM35).

All per-page work is column expressions in one projection (regex chains),
so it scales with the number of pages and never leaves the JVM; link
harvest and token windows are ``posexplode`` of arrays built per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions import web as W
from tessera.functions.text import strip, tokens
from tessera.operators import lexicon as LX
from tessera.operators.corpus import keep_first
from tessera.operators.prefix import ids_beside, prefix_sums
from tessera.operators.vectors import id_offset
from tessera.session import materialize, small_side

WINDOW_MAX_TOKENS = 50
WINDOW_STRIDE = 25
WINDOW_MARGIN = 8
DEFAULT_LABEL = "hate"
# Harvest parameters for the driver's pages (the study's were per site).
DETAIL_PATH = "/"
SKIP_PATTERNS = (r"\.(css|js|png|jpg|gif|svg|pdf)$", r"/(tag|category|page)/")


# Where a page's address may stand, in the order of preference,
# and the source whose pages have a parser of their own.
URL_FIELDS = ("sourceURL", "source_url", "url", "requested_url")
PROFILE_SOURCE = "splc"


def page_url_of(pages: DataFrame) -> Column:
    """SCL8: the first non-empty of the address columns that ``pages`` has."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in URL_FIELDS if c in pages.columns])


def page_records(pages: DataFrame, label: str = DEFAULT_LABEL) -> DataFrame:
    """SCL8 + SCL11 + SCL12 + PRJ9-PRJ11: one row per page with name, body,
    provenance, page status and the first failing skip rule.

    Pages of ``PROFILE_SOURCE`` go through the profile parser, all others
    through the generic one, in one pass: each parser sees NULL for the pages of
    the other."""
    md = W.html_to_markdown("html")
    url = W.canonical_url(page_url_of(pages))
    website, slug = W.website_slug(url)
    p = pages.select("page_id", url.alias("url"), md.alias("md"), W.page_title("html").alias("title"),
                     website.alias("website"), slug.alias("slug")).withColumn("source", W.source_of("website"))
    mine = F.col("source") == PROFILE_SOURCE
    p = p.withColumns({"_pmd": F.when(mine, F.col("md")), "_gmd": F.when(~mine, F.col("md"))})
    p = LX.profile_records(p, md="_pmd").withColumnsRenamed({"name": "_pname", "body": "_pbody", "skip_reason": "_preason"})
    p = p.withColumn("_full", F.regexp_extract("_gmd", W.HEADING, 1)).withColumn("_hname", F.regexp_extract("_gmd", W.HEADING, 2))
    m, f = F.col("_gmd"), F.col("_full")
    pos = F.when(m.startswith(f), F.lit(1)).otherwise(F.expr("instr(_gmd, concat(char(10), _full))") + 1)
    body_h = m.substr(pos + F.length(f), F.length(m) + 1)
    has_h = f != ""
    name_raw = (F.when(has_h, strip(F.col("_hname")))
                .when(strip(F.col("title")) != "", strip(F.col("title")))
                .otherwise(strip(F.translate(F.col("slug"), "-", " "))))
    body_raw = F.when(has_h, strip(body_h)).otherwise(strip(m))
    p = p.select("page_id", "url", "website", "slug", "source", "title", "md", "_preason",
                 F.when(mine, F.col("_pname")).otherwise(W.clean_name(name_raw)).alias("name"),
                 F.when(mine, F.col("_pbody")).otherwise(W.clean_body(body_raw)).alias("body"))
    reason = (F.when(F.length(strip(F.col("md"))) < W.MIN_CHARS, F.lit("markdown_too_short"))
              .when(W.not_found_like("md"), F.lit("page_not_found"))
              .when(mine, F.col("_preason"))
              .when(F.col("name") == "", F.lit("missing_name"))
              .when(F.lower(strip(F.col("name"))).isin(W.BAD_TITLES), F.lit("index_or_listing_page"))
              .when(F.length("body") < W.MIN_CHARS, F.lit("body_too_short_after_cleaning"))
              .otherwise(F.lit("parsed_successfully")))
    return p.select("page_id", "url", "website", "slug", "name", "body", "source", F.lit(label).alias("label"),
                    W.page_status("md", "title").alias("status"), reason.alias("skip_reason"),
                    F.length("md").alias("markdown_length"))


def parsed_records(pages: DataFrame, label: str = DEFAULT_LABEL) -> DataFrame:
    """Records of pages with status ok that parsed, checkpointed: name and body feed several
    expressions downstream and must not be re-parsed for each of them."""
    return materialize(page_records(pages, label)).where(
        (F.col("status") == "ok") & (F.col("skip_reason") == "parsed_successfully"))


def skip_counts(records: DataFrame) -> DataFrame:
    """AGG17: pages per skip reason."""
    return records.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


def page_links(pages: DataFrame, detail_path: str = DETAIL_PATH,
               skip_patterns: Sequence[str] = SKIP_PATTERNS, main_only: bool = False) -> DataFrame:
    """SCL6 + SCL5 + PRJ12: every <a href> of a page (or of its main content
    only), resolved against the page's origin, canonicalised, filtered;
    (page_id, pos, link)."""
    hrefs = F.regexp_extract_all(W.main_html("html") if main_only else F.col("html"), F.lit(r'(?is)<a\b[^>]*?href="([^"]*)"'), 1)
    ex = pages.select("page_id", W.canonical_url("url").alias("page_url"),
                      W.origin("url").alias("_o"), F.posexplode(hrefs).alias("pos", "href"))
    ex = ex.where(F.col("href").contains(detail_path))
    link = W.canonical_url(W.resolve_href(W.cut_url("href"), "_o"))
    out = ex.select("page_id", "page_url", "pos", link.alias("link"))
    for pat in skip_patterns:
        out = out.where(~F.col("link").rlike(pat))
    return out


def link_harvest_log(pages: DataFrame) -> DataFrame:
    """DOM35 page log: links found per page; a page that was fetched is ``ok``
    also without links, one without content is ``failed``."""
    links = page_links(pages).groupBy("page_id").agg(F.count(F.lit(1)).alias("links_found"))
    base = pages.select("page_id", W.canonical_url("url").alias("page_url"),
                        F.length(W.html_to_markdown("html")).alias("markdown_length"))
    j = base.join(links, "page_id", "left")
    n = F.coalesce("links_found", F.lit(0))
    return j.select("page_id", "page_url", F.coalesce("markdown_length", F.lit(0)).alias("markdown_length"), n.alias("links_found"),
                    F.when(F.col("markdown_length").isNull(), F.lit("failed: no content"))
                    .otherwise(F.lit("ok")).alias("status"))


def links_of_sources(pages: DataFrame) -> DataFrame:
    """DOM35: pages and links per source, with ``status`` failed for a source
    that yields none."""
    per = pages.select(W.source_of(W.origin("url")).alias("source"), "page_id").join(
        page_links(pages).groupBy("page_id").agg(F.count(F.lit(1)).alias("_n")), "page_id", "left")
    return per.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("_n"), F.lit(0)).alias("links")).withColumn(
        "status", F.when(F.col("links") == 0, F.lit("failed: no URLs found")).otherwise(F.lit("ok")))


def unique_links(pages: DataFrame) -> DataFrame:
    """WIN1 on url + SRT2: distinct harvested URLs, sorted, with the page that
    first linked them (first by page_id, position)."""
    l = page_links(pages)
    first = keep_first(l, ["link"], ["page_id", "pos"])
    return first.select("link", F.col("page_id").alias("first_page_id")).orderBy("link")


def links_per_source(pages: DataFrame) -> DataFrame:
    """AGG3: links summed per source / site of the linking page."""
    l = page_links(pages)
    site = F.regexp_extract("page_url", r"^[^:]+://([^/]+)", 1)
    return l.groupBy(W.source_of(site).alias("source"), site.alias("site")).agg(
        F.count(F.lit(1)).alias("links"), F.count_distinct("link").alias("unique_links"))


def window_count(n, budget, stride: int) -> F.Column:
    """Number of windows the study's loop produces for n body tokens."""
    first_cover = F.greatest(F.ceil((n - budget) / F.lit(float(stride))), F.lit(0))
    last_start = F.ceil(n / F.lit(float(stride))) - 1
    return F.when(n <= 0, F.lit(0)).otherwise(F.least(first_cover, last_start) + 1).cast("int")


def _tokenised(records: DataFrame, max_tok: int, margin: int) -> DataFrame:
    """Token arrays of prefix and body, the length and what is left for a window."""
    prefix = F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col("name"), F.lit(": "))
    r = records.withColumn("_pt", tokens(prefix)).withColumn("_bt", tokens("body"))
    return (r.withColumn("original_token_length", F.size("_pt") + F.size("_bt"))
             .withColumn("_budget", F.lit(max_tok) - F.size("_pt") - F.lit(margin)))


def window_totals(records: DataFrame, max_tok: int = WINDOW_MAX_TOKENS, stride: int = WINDOW_STRIDE,
                  margin: int = WINDOW_MARGIN) -> DataFrame:
    """``records`` with ``n_windows``, the rows that token_windows makes of each."""
    r = _tokenised(records, max_tok, margin)
    n = (F.when((F.col("original_token_length") <= max_tok) | (F.col("_budget") <= 0), F.lit(1))
         .otherwise(window_count(F.size("_bt"), F.col("_budget"), stride)))
    return r.withColumn("n_windows", n.cast("long")).drop("_pt", "_bt", "_budget", "original_token_length")


def token_windows(records: DataFrame, max_tok: int = WINDOW_MAX_TOKENS, stride: int = WINDOW_STRIDE,
                  margin: int = WINDOW_MARGIN) -> DataFrame:
    """DOM1: '[label] name: body' as one chunk when it has <= max_tok tokens,
    else overlapping windows of the body behind the prefix: budget =
    max_tok - |prefix| - margin, starts 0, stride, ... until a window
    reaches the end; budget <= 0 gives one hard cut of prefix + body.

    Whitespace collapsing equals joining the whitespace tokens, so every
    text is built from the prefix and body token arrays (tokenised once)
    with array slices -- no regex runs per window.
    """
    r = _tokenised(records, max_tok, margin)
    k = window_count(F.size("_bt"), F.col("_budget"), stride)
    both = F.concat("_pt", "_bt")
    single = F.array(F.array_join(both, " "))
    hard = F.array(F.array_join(F.slice(both, 1, max_tok), " "))
    wins = F.when(k <= 0, F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda i: F.array_join(F.slice(F.concat(F.col("_pt"), F.slice("_bt", i * stride + 1, F.col("_budget"))),
                                       1, max_tok), " ")))
    texts = (F.when(F.col("original_token_length") <= max_tok, single)
             .when(F.col("_budget") <= 0, hard).otherwise(wins))
    out = r.select("*", F.posexplode(texts).alias("window", "text"))
    return out.drop("_pt", "_bt", "_budget")


def glossary_chunks(pages: DataFrame, label: str = DEFAULT_LABEL) -> DataFrame:
    """DOM33: parsed pages -> token windows -> contiguous chunk ids ->
    token length.  Columns follow the study's full provenance layout.

    Ids are counted over pages, by their numbers of windows: a chunk's id is its
    page's offset plus its window, so no text takes part in the counting."""
    rec = parsed_records(pages, label).withColumn("_row", F.monotonically_increasing_id())
    sizes = window_totals(rec).where("n_windows > 0").select("page_id", "_row", "n_windows").withColumn("_g", F.lit(0))
    ranked = prefix_sums(sizes, ["_g"], ["page_id", "_row"], ["n_windows"])
    offsets = ranked.select("_row", (F.col("cum_n_windows") - F.col("n_windows")).alias("_offset"))
    win = token_windows(rec.join(small_side(offsets), "_row"))
    return win.select((F.col("_offset") + F.col("window")).alias("chunk_id"), "text", "source", "label", "url",
                      F.col("name").alias("symbol_name"), "slug", "website", "original_token_length",
                      F.size(tokens("text")).alias("token_length"), "page_id", "window")


def full_glossary(pages: DataFrame, listings: DataFrame, label: str = DEFAULT_LABEL) -> DataFrame:
    """DOM33 to the end (SET2): chunks of the pages and of the lexicon listings
    under one id space, the lexicon behind the pages.  A column that only one
    side has is empty on the other."""
    chunks = materialize(glossary_chunks(pages, label).drop("page_id", "window"))
    entries = LX.lexicon_entries(listings, label).withColumn("token_length", F.size(tokens("text"))).select(
        "text", "source", "label", F.col("source_url").alias("url"), F.col("term").alias("symbol_name"),
        "language", "offensiveness", "sightings", "filter_group", "filter_name", "target_category", "showing_range",
        "coverage_note", "token_length", F.col("token_length").alias("original_token_length"), "filter_order", "row_pos")
    entries = ids_beside(entries, ["filter_order", "row_pos"], "chunk_id").drop("filter_order", "row_pos")
    both = chunks.unionByName(id_offset(entries, chunks, 0), allowMissingColumns=True)
    strings = [f.name for f in both.schema.fields if f.dataType.simpleString() == "string"]
    return both.fillna("", subset=strings)


def window_cap_check(chunks: DataFrame, max_tok: int = WINDOW_MAX_TOKENS) -> DataFrame:
    """DOM2: max token length and the number of chunks over the cap."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.max("token_length").alias("max_token_length"),
                      F.count_if(F.col("token_length") > max_tok).alias("n_over_cap"))


def window_offenders(chunks: DataFrame, max_tok: int = WINDOW_MAX_TOKENS) -> DataFrame:
    """DOM2: the chunks over the cap, with where they come from."""
    return chunks.where(F.col("token_length") > max_tok).select(
        "chunk_id", "source", "url", "symbol_name", "token_length", (F.col("token_length") - max_tok).alias("over_by"))


def write_checked(chunks: DataFrame, path: str, max_tok: int = WINDOW_MAX_TOKENS, strict: bool = True) -> dict:
    """DOM2 on the writing job itself: chunks are counted as they are written
    (``n_chunks, max_token_length, n_over_cap``), without a second scan; with
    ``strict`` any chunk over the cap is an error once all are written."""
    seen = Observation()
    counted = chunks.observe(seen, F.count(F.lit(1)).alias("n_chunks"),
                             F.max("token_length").alias("max_token_length"),
                             F.count_if(F.col("token_length") > max_tok).alias("n_over_cap"))
    counted.write.mode("overwrite").parquet(path)
    if strict and seen.get["n_over_cap"]:
        raise ValueError(f"{seen.get['n_over_cap']} chunks exceed {max_tok} tokens: {path}")
    return dict(seen.get)


def write_harvest(pages: DataFrame, path: str, sources: Sequence[str]) -> dict:
    """DOM35 on the writing job itself: the links of all pages are written
    (``source, page_id, pos, link``) and counted per expected source on the way;
    a source without any is an error once they are written."""
    links = page_links(pages).withColumn("source", W.source_of(W.origin("page_url")))
    seen = Observation()
    found = links.observe(seen, *[F.count_if(F.col("source") == s).alias(f"n{k}") for k, s in enumerate(sources)],
                          F.count(F.lit(1)).alias("n"))
    found.select("source", "page_id", "pos", "link").write.mode("overwrite").parquet(path)
    counts = {s: seen.get[f"n{k}"] for k, s in enumerate(sources)}
    empty = sorted(s for s, n in counts.items() if not n)
    if empty:
        raise ValueError(f"no URLs found for {', '.join(empty)}")
    return counts


def review_projection(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """SNK3 / PRJ17: the ordered column list, keeping only columns present."""
    return df.select(*[c for c in columns if c in df.columns])
