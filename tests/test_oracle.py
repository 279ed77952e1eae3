import pytest

from meridia import workloads
from tests.compare import same

# One of each family of single variables is enough here: the full tables below hold all of them.
SINGLE = {f"bio{b:02d}" for b in range(1, 36)} - {"bio03", "bio11", "bio15", "bio29"}


@pytest.mark.parametrize("name", [n for n in workloads.QUERIES if n not in SINGLE])
def test_query_equals_sql(spark, data, duck, name):
    same(workloads.QUERIES[name](spark, data), duck, workloads.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(workloads.QUERIES) == set(workloads.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
