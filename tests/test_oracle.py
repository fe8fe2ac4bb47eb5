"""Every registered query against its DuckDB oracle on sf0.001."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v != 0 else "0"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _names():
    import __spark_entry__ as e
    return sorted(e.oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as e
    df = e.queries()[name](spark, SF)
    cols = df.columns
    got = sorted((tuple(_norm(x) for x in r) for r in df.collect()), key=_key)
    cur = duck.execute(e.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    idx = [dcols.index(c) for c in cols]
    exp = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=_key)
    assert got == exp


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}


def test_result_types_match_the_oracle(spark, duck):
    import __spark_entry__ as e
    diffs = []
    for name, sql in sorted(e.oracle_sql().items()):
        spark_types = {f.name: f.dataType.simpleString() for f in e.queries()[name](spark, SF).schema.fields}
        rel = duck.sql(sql)
        duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
        diffs += [(name, c, t, duck_types.get(c)) for c, t in spark_types.items()
                  if duck_types.get(c) != SPARK_TO_DUCK.get(t, t.upper())]
    assert diffs == []
