"""Text helpers for the checking SQL."""

from __future__ import annotations

from ordermetrics.catalog.views import VIEW_SQL

_NEEDS = {"v_meta_text": ["v_meta"], "v_linked": ["v_claim"]}


def with_views(*names: str, body: str) -> str:
    """``body`` with the named views (and what they need) as common table expressions."""
    ordered: list[str] = []
    for name in names:
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    ctes = [f"{n} AS ({VIEW_SQL[n]})" for n in ordered]
    text = body.strip()
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + text[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + text


def half_even_quotient(top: str, bottom: str, digits: int = 2) -> str:
    """Exact integer-arithmetic quotient of two integers, rounded half to even."""
    scale = 10**digits
    n, d = f"(abs(CAST({top} AS HUGEINT)) * {scale})", f"CAST({bottom} AS HUGEINT)"
    up = f"CASE WHEN 2 * ({n} % {d}) > {d} OR (2 * ({n} % {d}) = {d} AND ({n} // {d}) % 2 = 1) THEN 1 ELSE 0 END"
    return (
        f"CASE WHEN {d} <> 0 THEN CASE WHEN {top} < 0 THEN -1 ELSE 1 END * CAST({n} // {d} + {up} AS DOUBLE) / {scale} END"
    )


def half_even_money(total: str, count: str) -> str:
    """Mean of scale-2 amounts from their exact sum, rounded half to even at cents."""
    return f"({half_even_quotient(cents(total), count, 0)}) / 100.0"


def cents(expression: str) -> str:
    """A scale-2 decimal as a whole number of cents."""
    return f"CAST(({expression}) * 100 AS HUGEINT)"


def period_columns(ts: str) -> str:
    """Monthly fiscal label and start."""
    return (
        f"CAST(month({ts}) AS VARCHAR) || '/' || CAST(year({ts}) AS VARCHAR) AS period, "
        f"CAST(date_trunc('month', {ts}) AS TIMESTAMP) AS period_start"
    )


def ratio(top: str, bottom: str) -> str:
    return f"CAST({top} AS DOUBLE) / NULLIF(CAST({bottom} AS DOUBLE), 0)"
