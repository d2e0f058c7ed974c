"""Every registered query with an oracle must match DuckDB (sf0.001)."""
import pytest

from tidemark.plans.catalog import load_all
from tools.compare import digest, rows_of

from .conftest import SF_SMALL

REG = load_all()


@pytest.mark.parametrize("name", sorted(n for n, e in REG.items() if e.sql))
def test_matches_duckdb(spark, duck, name):
    e = REG[name]
    got = e.fn(spark, SF_SMALL).toArrow()
    want = duck.execute(e.sql).to_arrow_table()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert digest(gr) == digest(wr), [(a, b) for a, b in zip(gr, wr) if a != b][:3]


@pytest.mark.parametrize("name", sorted(n for n, e in REG.items() if not e.sql))
def test_rows_only_queries_run(spark, name):
    df = REG[name].fn(spark, SF_SMALL)
    assert df.count() >= 0
