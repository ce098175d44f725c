"""Every core query against its SQL, on the smallest tables."""

import os

import pytest

from lectern.plans.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(df):
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck.sql(SQL[name]).df())
    else:
        assert len(got)


@pytest.mark.parametrize("name", ["answers", "aware_search", "compare_searches", "similarity_topk"])
def test_searches_answer_all_requests(spark, duck, name):
    got = {int(q) for q in QUERIES[name](spark, DATA).toPandas()["qid"]}
    assert got == {int(q) for q in duck.sql(SQL[name]).df()["qid"]} and any(q % 50 for q in got)
