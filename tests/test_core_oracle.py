import pytest
from oracle import spark_rows, sql_rows

from tagfold.plans import core


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_equals_sql(spark, sf, name):
    assert spark_rows(core.queries()[name](spark, sf)) == sql_rows(core.oracle_sql()[name], sf)
