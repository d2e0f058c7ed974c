"""DuckDB form of the preprocessing chain on the churn fixture, written as
CTEs that the preprocessing, model and scoring oracles share."""
from __future__ import annotations

from tidemark.operators.prep import SEED, TEST_FRACTION
from tidemark.roles import FIXTURE

R = FIXTURE
CATS = {c: sorted(R.domains[c]) for c in R.multi}
FEATURES = (list(R.binary) + list(R.flag) + list(R.numeric)
            + [f"{c}_{v}" for c in R.multi for v in CATS[c]])


def q(name: str) -> str:
    return '"' + name + '"'


def prep_ctes(src: str = "churn_base") -> str:
    """CTEs: _pmed, _pmode, _imp, _bnd, _clip, _enc (features + label +
    is_test), _sc (feature, mean, scale), _z (scaled training frame)."""
    med = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.5) AS median FROM {src}"
                             for c in R.numeric)
    cat_cols = list(R.binary) + list(R.multi) + list(R.flag)
    mode = " UNION ALL ".join(
        f"(SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS mode FROM {src} WHERE {c} IS NOT NULL "
        f"GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)" for c in cat_cols)
    imp_cols = []
    for c in R.numeric:
        imp_cols.append(f"coalesce({c}, (SELECT median FROM _pmed WHERE \"column\" = '{c}')) AS {c}")
    for c in cat_cols:
        cast = "INTEGER" if c in R.flag else "VARCHAR"
        imp_cols.append(f"coalesce({c}, CAST((SELECT mode FROM _pmode WHERE \"column\" = '{c}') AS {cast})) AS {c}")
    bnd = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, "
        f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lower, "
        f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS upper FROM _imp"
        for c in R.numeric)
    clip_cols = [f"least(greatest(CAST({c} AS DOUBLE), (SELECT lower FROM _bnd WHERE \"column\" = '{c}')), "
                 f"(SELECT upper FROM _bnd WHERE \"column\" = '{c}')) AS {c}" for c in R.numeric]
    enc = []
    for c in R.binary:
        enc.append(f"CASE WHEN (SELECT count(DISTINCT {c}) FROM _imp) <= 2 THEN "
                   f"CASE WHEN {c} = (SELECT max({c}) FROM _imp) AND (SELECT count(DISTINCT {c}) FROM _imp) = 2 "
                   f"THEN 1.0 ELSE 0.0 END END AS {c}")
    for c in R.flag:
        enc.append(f"CAST({c} AS DOUBLE) AS {c}")
    for c in R.numeric:
        enc.append(f"CAST({c} AS DOUBLE) AS {c}")
    for c in R.multi:
        for v in CATS[c]:
            enc.append(f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END AS {q(c + '_' + v)}")
    h = (f"CAST('0x' || substr(md5(CAST({R.id} AS VARCHAR) || ':{SEED}'), 1, 15) AS BIGINT)")
    sc = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, avg({q(f)}) AS mean, "
        f"CASE WHEN stddev_pop({q(f)}) = 0 THEN 1.0 ELSE stddev_pop({q(f)}) END AS scale FROM _enc WHERE NOT is_test"
        for f in FEATURES)
    z = ", ".join(f"({q(f)} - (SELECT mean FROM _sc WHERE feature = '{f}')) / "
                  f"(SELECT scale FROM _sc WHERE feature = '{f}') AS {q(f)}" for f in FEATURES)
    return f"""_pmed AS ({med}),
_pmode AS ({mode}),
_imp AS MATERIALIZED (SELECT {R.id}, {R.label}, {', '.join(imp_cols)} FROM {src} WHERE {R.label} IS NOT NULL),
_bnd AS ({bnd}),
_clip AS MATERIALIZED (SELECT * REPLACE ({', '.join(clip_cols)}) FROM _imp),
_enc0 AS (SELECT {R.id}, CASE WHEN {R.label} THEN 1 ELSE 0 END AS label, {h} AS _h, {', '.join(enc)} FROM _clip),
_enc AS MATERIALIZED (SELECT * EXCLUDE (_h, _rn, _n), _rn <= floor(_n * {TEST_FRACTION} + 0.5) AS is_test FROM (
          SELECT *, row_number() OVER (PARTITION BY label ORDER BY _h, {R.id}) AS _rn,
                 count(*) OVER (PARTITION BY label) AS _n FROM _enc0)),
_sc AS ({sc}),
_z AS MATERIALIZED (SELECT {R.id}, label, is_test, {z} FROM _enc)"""


def apply_ctes(src: str = "_typed") -> str:
    """Scoring-side apply (P11, reference mode) on a typed frame ``src``
    with ``row_no``: missing number -> 0, missing category -> zeros."""
    enc = []
    for c in R.binary:
        enc.append(f"coalesce(CASE WHEN (SELECT count(DISTINCT {c}) FROM _imp) <= 2 THEN "
                   f"CASE WHEN {c} = (SELECT max({c}) FROM _imp) AND (SELECT count(DISTINCT {c}) FROM _imp) = 2 THEN 1.0 "
                   f"WHEN {c} = (SELECT min({c}) FROM _imp) THEN 0.0 END END, 0.0) AS {c}")
    for c in list(R.flag) + list(R.numeric):
        enc.append(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}")
    for c in R.multi:
        for v in CATS[c]:
            enc.append(f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END AS {q(c + '_' + v)}")
    z = ", ".join(f"({q(f)} - (SELECT mean FROM _sc WHERE feature = '{f}')) / "
                  f"(SELECT scale FROM _sc WHERE feature = '{f}') AS {q(f)}" for f in FEATURES)
    return f"""_aenc AS MATERIALIZED (SELECT row_no, {', '.join(enc)} FROM {src}),
_az AS MATERIALIZED (SELECT row_no, {z} FROM _aenc)"""


def long_of(src: str, idcol: str) -> str:
    return " UNION ALL ".join(f"SELECT {idcol}, '{f}' AS feature, round({q(f)}, 6) AS value FROM {src}"
                              for f in FEATURES)
