"""Every registered query against its DuckDB oracle on sf0.001 (the driver's
comparison: row count, column names and type families, order-insensitive
values)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from paraspark.plans import registry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
registry.load_all()  # the queries of this library's own operators
QUERIES = {k: v for k, v in E.queries().items() if v.__module__.startswith("paraspark.plans.")}
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    return v if isinstance(v, (int, str, bool)) else str(v)


def family(type_name):
    """Coarse type family shared by Spark and DuckDB names (BIGINT and
    UBIGINT are one family, INT another, DOUBLE, VARCHAR, BOOLEAN ...)."""
    t = type_name.lower()
    if t in ("bigint", "long", "ubigint", "hugeint"):
        return "int64"
    if t in ("int", "integer", "uinteger"):
        return "int32"
    if "double" in t or t in ("float", "real"):
        return "float"
    if t in ("string", "varchar"):
        return "string"
    if "bool" in t:
        return "bool"
    return t


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def test_every_query_has_oracle_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, sf_small, key):
    sdf = QUERIES[key](spark, sf_small)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(ORACLE[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    rel = con.sql(ORACLE[key])
    assert ({f.name: family(f.dataType.simpleString()) for f in sdf.schema.fields}
            == {c: family(str(t)) for c, t in zip(rel.columns, rel.types)})
    assert len(srows) == len(drows)
    assert canon(sdf.columns, srows) == canon(dcols, drows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["source_lang", "target_lang", "total"]
    assert df.count() >= 0
