"""Registered corpus queries: SQL oracles, contracts at sf0.001, the pipeline."""
import pytest

import corpus_pipeline
from tidemark.llm import queries, simhash_vp
from tools.compare import digest, rows_of

from ..conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_duckdb(spark, duck, name):
    got, want = rows_of(queries.QUERIES[name](spark, SF_SMALL).toArrow()), rows_of(duck.sql(queries.ORACLES[name]).to_arrow_table())
    assert got[0] == want[0] and len(got[1]) == len(want[1]) and digest(got[1]) == digest(want[1])


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n.startswith(("op3", "op4", "op5", "op7", "op8", "op9", "op10"))))
def test_one_row_per_document(spark, name):
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    got = queries.QUERIES[name](spark, SF_SMALL)
    assert got.count() == n == got.select("doc_id").distinct().count()


def test_every_text_round_trips(spark):
    assert queries.op3_sentencepiece(spark, SF_SMALL).where("NOT round_trip").isEmpty()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF_SMALL))
        if name != "sentencepiece":
            assert seen[-1].columns == columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    assert ids[0] > ids[1] >= ids[2] == ids[3] == ids[4] == ids[5]
    groups = simhash_vp.near_duplicates(seen[1]).collect()
    assert ids[2] == {r.component_id for r in groups}
    assert seen[3].where("text RLIKE 'AKIA[A-Z0-9]{16}' OR text RLIKE '[0-9a-f]{24}'").isEmpty()
    assert corpus_pipeline.run(spark, SF_SMALL).count() == seen[5].count()
