"""Text column functions (SCL1-SCL3, SCL17-SCL21, SCL29-SCL30).

Python's ``str.split()`` / ``str.strip()`` treat Unicode separators as
whitespace while Java's ``\\s`` (and RE2's) is ASCII-only, so the class is
spelled out once here and used everywhere, in Spark and in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: whitespace as Python's str.isspace() sees it (ASCII controls
# \t \n \v \f \r, the separators \x1c-\x1f, NEL and every Unicode Z* char).
WS = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\p{Z}]"
# Token pattern used for token counts and windows: a run of non-whitespace.
TOKEN = r"[^\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\p{Z}]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace.
    (Spark ``trim`` removes only spaces.)"""
    return F.regexp_replace(_c(c), f"^{WS}+|{WS}+$", "")


def dedup_norm(c) -> Column:
    """SCL1: lower + strip, the de-duplication key."""
    return strip(F.lower(_c(c)))


def collapse_ws(c) -> Column:
    """SCL2: ``re.sub(r'\\s+', ' ', t).strip()``."""
    return strip(F.regexp_replace(_c(c), f"{WS}+", " "))


def preview(c, n: int = 300) -> Column:
    """SCL3: collapse whitespace, first n chars, '...' if longer."""
    t = collapse_ws(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def tokens(c) -> Column:
    """Whitespace tokens of a text (array<string>)."""
    return F.regexp_extract_all(_c(c), F.lit(f"({TOKEN})"), 1)


def word_count(c) -> Column:
    """SCL21 / SCL19: ``len(t.split())``."""
    return F.size(tokens(c))


def hard_token_cap(c, max_tokens: int) -> Column:
    """SCL20: keep the first ``max_tokens`` tokens, joined by single spaces."""
    return F.array_join(F.slice(tokens(c), 1, max_tokens), " ")


def slugify(c) -> Column:
    """SCL17: lower, whitespace runs to '-', drop other non [a-z0-9-], strip '-'."""
    s = F.regexp_replace(F.lower(strip(_c(c))), f"{WS}+", "-")
    s = F.regexp_replace(s, r"[^a-z0-9\-]", "")
    return F.regexp_replace(s, r"^-+|-+$", "")


def lenient_double(c) -> Column:
    """SCL29: numeric cast where a bad value becomes NULL."""
    return F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")


def field(record, name: str, default=None) -> Column:
    """SCL31: a map entry by name, or the default where it is absent or NULL."""
    return F.coalesce(F.try_element_at(_c(record), F.lit(name)), F.lit(default))


def first_chars(c, n: int) -> Column:
    """PRJ16: first n characters, stripped."""
    return strip(F.substring(_c(c), 1, n))


# DuckDB spellings of the same functions, for the oracle SQL.
def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{TOKEN}')"


def sql_word_count(x: str) -> str:
    return f"CAST(len({sql_tokens(x)}) AS INTEGER)"


def sql_collapse_ws(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")
