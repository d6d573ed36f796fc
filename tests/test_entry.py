import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@here
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@here
@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_columns_and_rows_match_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    sql = c.sql(__spark_entry__.oracle_sql()[name])
    df = __spark_entry__.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(sql.columns)
    assert df.count() == len(sql.fetchall())


def test_llm_is_optional(monkeypatch):
    import importlib

    real = importlib.import_module

    def absent(name, *a):
        if name.startswith("paperstream.llm"):
            raise ModuleNotFoundError(name=name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", absent)
    assert not any(n.startswith("p1_") for n in __spark_entry__.queries()) and "order_accuracy" in __spark_entry__.oracle_sql()
