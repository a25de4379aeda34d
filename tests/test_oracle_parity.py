"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import datetime as dt
import math
import os

import pytest

import __spark_entry__ as entry
from quarry.cases import load_all
from tests.conftest import SF_SMALL

TYPE_MAP = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
            "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
QUERIES = {n: q for n, q in entry.queries().items() if n in load_all()}
SQL = {n: q for n, q in entry.oracle_sql().items() if n in QUERIES}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables missing")
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    stypes = {f.name: TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    dtypes = {d[0]: str(d[1]).upper() for d in cur.description}
    assert stypes == dtypes
    assert len(srows) == len(drows)
    assert _rows(df.columns, srows) == _rows(dcols, drows)


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables missing")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["state", "mun", "lat", "lon", "date", "price", "litres"]
    assert df.count() > 0
