import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def shown(v):
    if isinstance(v, float) and not math.isnan(v):
        return f"{v + 0.0:.5f}".rstrip("0").rstrip(".").replace("-0", "0") if abs(v) < 1e-9 else f"{v:.5f}".rstrip("0").rstrip(".")
    return str(int(v)) if isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith(("op", "pipeline"))))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    at = [want.columns.index(c) for c in columns]
    assert dict(zip(want.columns, map(str, want.types))) == {c: KINDS[t] for c, t in df.dtypes}
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1000 and len(df.columns) == len(set(df.columns))


def test_registry_without_the_training_data_operators(monkeypatch):
    import builtins

    real = builtins.__import__

    def without(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith("fixtura.llm"):
            raise ModuleNotFoundError(f"No module named '{name}'", name="fixtura.llm")
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", without)
    assert "flagship_panel_features" in entry.queries() and not any(k.startswith("op1_") for k in entry.queries())
