"""Helpers to render DuckDB oracle SQL with the exact same constants."""

from __future__ import annotations

from tessera.operators.metrics import BIN_EDGES, HANDOFF_THRESHOLDS, SWEEP_THRESHOLDS
from tessera.plans.fixtures import SCORED_SQL


def dbl(x: float) -> str:
    """A double literal both engines parse to the same bits."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def with_scored(*ctes: str) -> str:
    parts = [SCORED_SQL.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts)


def ece_bin_sql(p: str) -> str:
    e = BIN_EDGES
    arms = " ".join(f"WHEN {p} < {dbl(e[i + 1])} THEN {i}" for i in range(10))
    return f"CASE {arms} END"


def reliability_bin_sql(p: str) -> str:
    e = BIN_EDGES
    arms = " ".join(f"WHEN {p} <= {dbl(e[i + 1])} THEN {i}" for i in range(9))
    return f"CASE {arms} ELSE 9 END"


def sweep_bucket_sql(c: str) -> str:
    t = SWEEP_THRESHOLDS
    arms = [f"WHEN {c} >= {dbl(t[-1])} THEN {len(t)}"]
    arms += [f"WHEN {c} >= {dbl(t[j - 1])} THEN {j}" for j in range(len(t) - 1, 0, -1)]
    return "CASE " + " ".join(arms) + " ELSE 0 END"


def values_list(xs, name="threshold") -> str:
    rows = ", ".join(f"({dbl(x)})" for x in xs)
    return f"(VALUES {rows}) AS t({name})"


def sweep_values() -> str:
    rows = ", ".join(f"({j + 1}, {dbl(x)})" for j, x in enumerate(SWEEP_THRESHOLDS))
    return f"(VALUES {rows}) AS sw(step, threshold)"


def handoff_values() -> str:
    return values_list(HANDOFF_THRESHOLDS)


def macro_sql(tp="tp", fp="fp", tn="tn", fn="fn") -> dict[str, str]:
    """Macro P/R/F1 over present labels, zero_division=0 (see macro_columns)."""
    def div0(n, d):
        return f"(CASE WHEN ({d}) = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END)"
    has1 = f"(({tp} + {fn} + {fp}) > 0)"
    has0 = f"(({tn} + {fp} + {fn}) > 0)"
    nl = f"(CAST({has1} AS INTEGER) + CAST({has0} AS INTEGER))"
    per = {
        "precision": (div0(tn, f"{tn} + {fn}"), div0(tp, f"{tp} + {fp}")),
        "recall": (div0(tn, f"{tn} + {fp}"), div0(tp, f"{tp} + {fn}")),
        "f1": (div0(f"2 * {tn}", f"2 * {tn} + {fn} + {fp}"), div0(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")),
    }
    out = {}
    for k, (c0, c1) in per.items():
        total = (f"(CASE WHEN {has0} THEN {c0} ELSE CAST(0.0 AS DOUBLE) END + "
                 f"CASE WHEN {has1} THEN {c1} ELSE CAST(0.0 AS DOUBLE) END)")
        out[f"macro_{k}"] = f"(CASE WHEN {nl} = 0 THEN NULL ELSE {total} / CAST({nl} AS DOUBLE) END)"
    return out


CONFUSION_SQL = """count(*) FILTER (WHERE label = 1 AND predicted = 1) AS tp,
       count(*) FILTER (WHERE label = 0 AND predicted = 1) AS fp,
       count(*) FILTER (WHERE label = 0 AND predicted = 0) AS tn,
       count(*) FILTER (WHERE label = 1 AND predicted = 0) AS fn"""
