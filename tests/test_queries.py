"""Every query that SQL can express gives the rows of its SQL."""

import glob
import math
import os

import duckdb
import pytest

from grainmill.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = lambda x: sorted(tuple(map(_plain, r)) for r in x)
    assert rows(got.select(*[f"`{n}`" for n in names]).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", ["extract_h1_css", "extract_title", "records_flat", "fill_rates", "extract_regex", "discovered_links"])
def test_references_cut_short_read_as_in_sql(spark, tmp_path, name):
    """Titles are cut after so many characters, sometimes inside a reference."""
    cut = ["Es&amp", "Es&am", "Es&quo", "&ampx &copyx", "Es&amp;amp", "Es&", "Es&#38 x"]
    page = '<html lang="de"><head><title>{0}</title><script>a &amp b</script></head><body><a href="/a&amp">{0}</a><article><h1>{0}</h1></article><footer>© a&amp.example · {0}</footer></body></html>'
    spark.createDataFrame([(i, f"http://example.com/{i}", page.format(t)) for i, t in enumerate(cut)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.connect().execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'").execute(ORACLES[name])
    names = [d[0] for d in want.description]
    rows = lambda x: sorted(tuple(map(_plain, r)) for r in x)
    assert rows(QUERIES[name](spark, str(tmp_path)).select(*[f"`{n}`" for n in names]).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
