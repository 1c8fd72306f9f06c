"""Registered queries against their SQL, and the shape of those without."""

import __spark_entry__ as entry
import pytest
from compare import differences
from conftest import SF_DIR

from determina.llm import queries

SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    out = entry.queries()[name](spark, SF_DIR)
    if name in SQL:
        assert differences(out, duck, SQL[name]) is None
    else:
        table, key = ("embeddings", "vec_id") if name == "op2_hnsw" else ("documents", "doc_id")
        ids = sorted(r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect())
        assert sorted(r[key] for r in out.select(key).collect()) == ids


def test_all_thirteen_are_there():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
