"""Web-page column functions (SRC10, SCL4-SCL6, SCL8-SCL9, SCL12, PRJ9-PRJ12,
PRJ15).

Regex rules are kept as data -- ``(pattern, replacement)`` pairs with
``{n}`` group references -- and rendered twice: to Spark ``regexp_replace``
(Java syntax, ``$n``) and to DuckDB SQL (RE2, ``\\n``), so the oracle runs
the very same rules.  Patterns stay inside the common subset of both
dialects (no look-around, inline ``(?i)(?s)(?m)`` flags).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import WS, collapse_ws, sql_collapse_ws, sql_strip, strip

# --- HTML to markdown-like text (stands in for the crawler's conversion) ----
# Main content is the <article> element when there is one, else <body>.
HTML_DROP = [
    (r"(?is)<script\b.*?</script>", " "),
    (r"(?is)<style\b.*?</style>", " "),
    (r"(?s)<!--.*?-->", " "),
]
HTML_TO_MD = [
    (r"(?is)<h1\b[^>]*>(.*?)</h1>", "\n# {1}\n"),
    (r"(?is)<h2\b[^>]*>(.*?)</h2>", "\n## {1}\n"),
    (r"(?is)<h3\b[^>]*>(.*?)</h3>", "\n### {1}\n"),
    (r"(?is)<h[4-6]\b[^>]*>(.*?)</h[4-6]>", "\n#### {1}\n"),
    (r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', "[{2}]({1})"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</?(p|div|li|ul|ol|section|tr|table|nav|footer|header|main)\b[^>]*>", "\n"),
    (r"<[^>]+>", ""),
]
# HTML entities decoded (&amp; last, so it is decoded once).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]

# --- markdown body cleaner (SCL9), applied in this order ----------------------
# The UI phrases removed case-insensitively.
UI_PHRASES = [
    "Open Sharing Options", "Close Sharing Options", "Print Content", "Share on Facebook",
    "Share on Twitter", "Share on LinkedIn", "Email this page", "Copy Link", "Copied to clipboard",
]
CLEAN_BODY = (
    [(r"!\[.*?\]\(.*?\)", " "), (r"\[([^\]]+)\]\([^\)]+\)", "{1}")]
    + [(f"(?i){p}", " ") for p in UI_PHRASES]
    + [("(?i)[\"“”]*\\(?opens in a new (?:window|tab)\\)?[\"“”]*", " "),
       (f"#{{1,6}}{WS}+", " "),
       (r"\*{1,2}([^*]+)\*{1,2}", "{1}"),
       (r"`([^`]+)`", "{1}"),
       (f"\\({WS}*\\)", " "),
       (f"\"{WS}*\"", " ")]
)
# Entity-name cleanup (publisher suffixes) and listing titles.
NAME_CLEAN = [
    (f"{WS}*\\|.*$", ""),
    (f"{WS}*- Anti-Defamation League.*$", ""),
    (f"{WS}*Hate Symbols Database{WS}*", ""),
]
BAD_TITLES = ["search", "browse", "all symbols", "hate symbols database", "hate symbols",
              "page not found", "in this article", "notifications"]
# Domain -> source.
SOURCE_DOMAINS = [("adl.org", "adl"), ("splcenter.org", "splc"), ("hatebase.org", "hatebase")]
MIN_CHARS = 50


def _java(rep: str) -> str:
    out = rep.replace("$", "\\$")
    for i in range(1, 10):
        out = out.replace("{%d}" % i, "$%d" % i)
    return out


def _re2(rep: str) -> str:
    out = rep.replace("\\", "\\\\")
    for i in range(1, 10):
        out = out.replace("{%d}" % i, "\\%d" % i)
    return out


def apply_rules(c: Column, rules) -> Column:
    for pat, rep in rules:
        c = F.regexp_replace(c, pat, _java(rep))
    return c


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_apply_rules(x: str, rules) -> str:
    for pat, rep in rules:
        x = f"regexp_replace({x}, {_q(pat)}, {_q(_re2(rep))}, 'g')"
    return x


def decode_entities(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sql_decode_entities(x: str) -> str:
    for a, b in ENTITIES:
        x = f"replace({x}, {_q(a)}, {_q(b)})"
    return x


def main_html(html="html") -> Column:
    h = apply_rules(F.col(html), HTML_DROP)
    art = F.regexp_extract(h, r"(?is)<article\b[^>]*>(.*)</article>", 1)
    body = F.regexp_extract(h, r"(?is)<body\b[^>]*>(.*)</body>", 1)
    return F.when(art != "", art).when(body != "", body).otherwise(h)


def sql_main_html(x: str) -> str:
    h = sql_apply_rules(x, HTML_DROP)
    art = f"regexp_extract({h}, '(?is)<article\\b[^>]*>(.*)</article>', 1)"
    body = f"regexp_extract({h}, '(?is)<body\\b[^>]*>(.*)</body>', 1)"
    return f"(CASE WHEN {art} <> '' THEN {art} WHEN {body} <> '' THEN {body} ELSE {h} END)"


def html_to_markdown(html="html") -> Column:
    """SRC9 re-aim: main content of an HTML page as markdown-like text."""
    return strip(decode_entities(apply_rules(main_html(html), HTML_TO_MD)))


def sql_html_to_markdown(x: str) -> str:
    return sql_strip(sql_decode_entities(sql_apply_rules(sql_main_html(x), HTML_TO_MD)))


def page_title(html="html") -> Column:
    return collapse_ws(decode_entities(F.regexp_extract(F.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def sql_page_title(x: str) -> str:
    return sql_collapse_ws(sql_decode_entities(f"regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title>', 1)"))


# --- URLs (SCL4, SCL5, SCL6, SRC10) -------------------------------------------------

def canonical_url(u) -> Column:
    """SCL5: cut '#...', cut '?...', strip trailing '/'."""
    c = F.col(u) if isinstance(u, str) else u
    c = F.split_part(c, F.lit("#"), F.lit(1))
    c = F.split_part(c, F.lit("?"), F.lit(1))
    return F.regexp_replace(c, "/+$", "")


def cut_url(u) -> Column:
    """An href without its fragment and query."""
    c = F.col(u) if isinstance(u, str) else u
    return F.split_part(F.split_part(c, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))


def sql_canonical_url(x: str) -> str:
    return f"regexp_replace(split_part(split_part({x}, '#', 1), '?', 1), '/+$', '', 'g')"


def origin(u) -> Column:
    return F.regexp_extract(F.col(u) if isinstance(u, str) else u, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)


def website_slug(u) -> tuple[Column, Column]:
    """SCL4: strip trailing '/', split at the last '/'."""
    c = F.regexp_replace(F.col(u) if isinstance(u, str) else u, "/+$", "")
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1), F.regexp_extract(c, r"([^/]*)$", 1)


def source_of(website) -> Column:
    """PRJ15: domain -> source name, else 'external'."""
    w = F.lower(F.col(website) if isinstance(website, str) else website)
    expr = None
    for dom, name in SOURCE_DOMAINS:
        expr = F.when(w.contains(dom), F.lit(name)) if expr is None else expr.when(w.contains(dom), F.lit(name))
    return expr.otherwise(F.lit("external"))


def resolve_href(href, base_origin) -> Column:
    """Absolute form of an href against the site's root: other schemes and
    absolute URLs stay, ``//host`` takes the scheme, and the dot segments of a
    rooted or relative path are resolved (``..`` stops at the root)."""
    h = strip(F.col(href) if isinstance(href, str) else href)
    o = F.col(base_origin) if isinstance(base_origin, str) else base_origin
    path = F.when(h.startswith("/"), h).otherwise(F.concat(F.lit("/"), F.regexp_replace(h, "/+", "/")))
    solved = F.aggregate(F.split(F.substr(path, F.lit(2)), "/", -1), F.lit(""), lambda acc, x: F.when(
        x == "..", F.regexp_replace(acc, "/[^/]*$", "")).when(x == ".", acc).otherwise(F.concat(acc, F.lit("/"), x)))
    return (F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(F.regexp_extract(o, r"^([^:]+:)", 1), h))
            .otherwise(F.concat(o, solved)))


def sql_resolve_href(h: str, o: str) -> str:
    path = f"CASE WHEN starts_with({h}, '/') THEN {h} ELSE '/' || regexp_replace({h}, '/+', '/', 'g') END"
    return (f"CASE WHEN regexp_matches({h}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {h} "
            f"WHEN starts_with({h}, '//') THEN regexp_extract({o}, '^([^:]+:)', 1) || {h} "
            f"ELSE {o} || list_reduce(list_prepend('', string_split(substr({path}, 2), '/')), lambda acc, x: "
            f"CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x = '.' THEN acc ELSE acc || '/' || x END) END")


def page_url(base_url, pagination, n) -> Column:
    """SRC10: listing-page URL for page n; unknown pagination -> NULL."""
    b, p, k = F.col(base_url), F.col(pagination), F.col(n)
    trimmed = F.regexp_replace(b, "/+$", "")
    return (F.when((p == "query_page_zero_based") & (k == 0), b)
            .when(p == "query_page_zero_based", F.concat(b, F.lit("?page="), k.cast("string")))
            .when((p == "path_page_one_based") & (k == 1), F.concat(trimmed, F.lit("/")))
            .when(p == "path_page_one_based", F.concat(trimmed, F.lit("/page/"), k.cast("string"), F.lit("/"))))


# --- page status and record extraction (PRJ9-PRJ11, SCL10, SCL12) ---------------------

def not_found_like(md="md") -> Column:
    m = F.col(md) if isinstance(md, str) else md
    return (F.substring(m, 1, 500).contains("Page Not Found")
            | F.lower(F.substring(m, 1, 1000)).contains("couldn't find the page"))


def page_status(md="md", title="title") -> Column:
    """PRJ9: 404-like page, too short, or ok."""
    t = F.lower(F.col(title))
    return (F.when(not_found_like(md) | t.contains("404") | t.contains("page not found"), F.lit("not_found"))
            .when(F.length(strip(F.col(md))) >= MIN_CHARS, F.lit("ok"))
            .otherwise(F.lit("too_short")))


def clean_name(c: Column) -> Column:
    return collapse_ws(strip(apply_rules(strip(c), NAME_CLEAN)))


def clean_body(c: Column) -> Column:
    """SCL9: markdown body cleaner, rules in order, then whitespace collapse."""
    return collapse_ws(apply_rules(c, CLEAN_BODY))


def sql_clean_body(x: str) -> str:
    return sql_collapse_ws(sql_apply_rules(x, CLEAN_BODY))


def sql_clean_name(x: str) -> str:
    return sql_collapse_ws(sql_strip(sql_apply_rules(sql_strip(x), NAME_CLEAN)))


HEADING = f"(?m)^(#{{1,3}}{WS}+(.+))"
