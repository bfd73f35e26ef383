"""Driver contract: entry() on sf0.001 and oracle agreement for a sample of
queries at sf0.001 (the full sweep at sf0.01 is tools/oracle_check.py)."""

import math

import duckdb
import pytest

import __spark_entry__ as E

from .conftest import SF001

TABLES = ("documents labels pages embeddings benchmark conversations").split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "macro_f1" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["dom22_handoff_rates", "dom17_performance_summary", "dom18_selective_sweep",
                                  "win2_cascade_dedup", "dom32_corpus_build", "dom4_topk_search",
                                  "dom28_error_overlap", "agg7_length_histogram"])
def test_oracle_sf0001(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    sp = E.queries()[name](spark, SF001).toPandas()
    dd = con.execute(E.oracle_sql()[name]).df()
    assert _rows(sp) == _rows(dd)
