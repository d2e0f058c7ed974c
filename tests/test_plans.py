"""Plan-shape checks: pruning, pushdown and no needless shuffles."""
import contextlib
import io

from tidemark.plans.catalog import load_all

from .conftest import SF_SMALL

REG = load_all()


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_flagship_prunes_lineitem_and_columns(spark):
    p = plan_of(REG["e4_churn_by_contract"].fn(spark, SF_SMALL))
    assert "lineitem.parquet" not in p                       # not needed for E4
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in p


def test_validation_rules_are_one_projection_over_the_fixture(spark):
    """V2..V7 add no shuffle of their own: the exchanges are the fixture's."""
    from tidemark.operators import validate as v
    from tidemark.plans.ingest_queries import _domains
    from tidemark.sources.fixtures import churn_raw
    raw = churn_raw(spark, SF_SMALL)
    base = plan_of(raw).count("Exchange")
    checked = plan_of(v.validation_errors(raw, _domains())).count("Exchange")
    assert checked == base


def test_no_global_windows_anywhere(spark):
    import re
    for name in ["e12_categorical_counts", "m6_stratified_folds", "j4_progress_history", "v12_duplicate_ids",
                 "j2_list_jobs", "x12_batch_page"]:
        p = plan_of(REG[name].fn(spark, SF_SMALL))
        assert not re.search(r"Arguments: \[.*\], \[\], \[", p), name


def test_scoring_is_a_projection_after_fit(spark):
    """Batch scoring adds no exchange beyond reading and typing the input."""
    from tidemark.operators import score as X
    from tidemark.plans.model_queries import naive_bayes
    from tidemark.plans.score_queries import scaled_scoring_rows
    z = scaled_scoring_rows(spark, SF_SMALL)
    nb = naive_bayes(spark, SF_SMALL)
    assert plan_of(X.batch_score(z, nb)).count("Exchange") <= plan_of(z).count("Exchange")
