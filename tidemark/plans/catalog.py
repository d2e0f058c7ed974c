"""Registry of named queries: a Spark builder plus (when expressible) a
DuckDB oracle over the same driver tables."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from tidemark.sources.fixtures import with_fixtures


@dataclass
class Entry:
    fn: Callable
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def positive_zero_rounds(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``: DuckDB keeps the
    sign of a rounded-away negative (-0.0), Spark's round returns 0.0, and
    -0.0 + 0.0 is +0.0 in IEEE arithmetic.  String literals are skipped."""
    out, i, n = [], 0, len(sql)
    while i < n:
        ch = sql[i]
        if ch == "'":                                   # copy a literal whole
            k = i + 1
            while k < n and sql[k] != "'":
                k += 1
            out.append(sql[i:k + 1])
            i = k + 1
            continue
        if sql.startswith("round(", i) and (i == 0 or not (sql[i - 1].isalnum() or sql[i - 1] in "_\"")):
            depth, k, quote = 0, i + 5, False
            while k < n:
                c = sql[k]
                if c == "'":
                    quote = not quote
                elif not quote and c == "(":
                    depth += 1
                elif not quote and c == ")":
                    depth -= 1
                    if depth == 0:
                        break
                k += 1
            out.append(f"(round({positive_zero_rounds(sql[i + 6:k])}) + 0.0)")
            i = k + 1
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def register(name: str, sql: str | None = None, fixtures: tuple = ()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        full = with_fixtures(sql, *fixtures) if sql and fixtures else sql
        REGISTRY[name] = Entry(fn, positive_zero_rounds(full) if full else None)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # importing the plan modules fills REGISTRY
    from tidemark.plans import (  # noqa: F401
        eda_queries, quality_queries, ingest_queries, prep_queries,
        model_queries, score_queries, ops_queries, feature_queries, stream_queries, io_queries, neighbour_queries, explain_queries, search_queries,
    )
    return REGISTRY
