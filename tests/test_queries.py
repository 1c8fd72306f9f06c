"""Every registered query gives what its SQL gives."""

import __spark_entry__ as entry
import pytest
from compare import differences
from conftest import SF_DIR

SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(set(entry.catalog.QUERIES)))
def test_query(spark, duck, name):
    assert differences(entry.queries()[name](spark, SF_DIR), duck, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["lhs", "rhs"]
