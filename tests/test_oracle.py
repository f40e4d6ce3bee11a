"""Every registered query with a SQL twin equals DuckDB on the same tables
(rows, column names, values; order-insensitive), at sf0.001."""

import math

import duckdb
import pytest

from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP"}


def _norm(v):
    if isinstance(v, float):
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return float(f"{v:.12g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, str(x)) for x in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _names():
    from __spark_entry__ import oracle_sql
    return sorted(oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_matches_duckdb(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    df = queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted([tuple(_norm(r[c]) for c in cols) for r in df.collect()], key=_key)
    rel = con.sql(oracle_sql()[name])
    ocols = list(rel.columns)
    assert sorted(ocols) == cols
    spark_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    idx = sorted(range(len(ocols)), key=lambda i: ocols[i])
    exp = sorted([tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()], key=_key)
    assert got == exp


def test_every_query_has_a_callable():
    from __spark_entry__ import oracle_sql, queries
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) >= 90


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    rows = entry(spark).collect()
    assert len(rows) > 0
    assert set(rows[0].asDict()) == {"o_orderpriority", "total", "converted", "rate", "rate_pct"}
