import glob
import os

import duckdb
import pytest

from grainmill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = c.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    rows = lambda x: sorted(tuple("" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in x)
    assert rows(QUERIES[name](spark, SF).select(*names).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_pipeline_runs(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).count() > 0
