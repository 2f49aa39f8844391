import pytest

from tests.helpers import compare
from vacantia.plans.catalogue import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, name, QUERIES, ORACLE)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_runs(spark, sf):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["vacancy_key", "company", "title", "score", "tier", "level", "label", "prior"]
    assert df.count() > 0
