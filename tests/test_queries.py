import oracle
import pytest
from quillmark.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def connection():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_equals_sql(spark, connection, name):
    oracle.same(spark, QUERIES[name].run, QUERIES[name].sql, FOLDER, connection)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs(spark, name):
    assert QUERIES[name].run(spark, FOLDER).collect()  # a count would leave columns out
