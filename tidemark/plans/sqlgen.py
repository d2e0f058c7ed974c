"""Small helpers that write the DuckDB side of the oracles."""
from __future__ import annotations


def long_sql(src: str, cols, key: str = "column", value: str = "value",
             cast: str = "DOUBLE", where: str | None = None, ids=()) -> str:
    idl = "".join(f"{i}, " for i in ids)
    parts = [f"SELECT {idl}'{c}' AS {key}, CAST({c} AS {cast}) AS {value} FROM {src}"
             + (f" WHERE {where}" if where else "") for c in cols]
    return "(" + " UNION ALL ".join(parts) + f") WHERE {value} IS NOT NULL"


def not_null(cols) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)
