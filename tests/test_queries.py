import pytest

from quillspark.plans import registry
from tests.against import assert_same, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    if name in registry.oracle_sql():
        assert_same(df, db.sql(registry.oracle_sql()[name]))
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
