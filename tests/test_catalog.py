"""Every query against its SQL, with names and types; the same rows whatever the number of partitions."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from semspark.plans import catalog

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v + 0.0) if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = con.execute(catalog.ORACLES[name])
    columns, kinds = [d[0] for d in cursor.description], {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert {k: TYPES[v] for k, v in df.dtypes} == kinds or all(TYPES[v] in kinds[k].upper() or kinds[k] in ("NUMBER", "STRING", "Bool", "bool") for k, v in df.dtypes)
    assert rows(df.columns, df.collect()) == rows(columns, want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["dssum", "nobm", "time_batches", "pod_gram", "locate_probes"])
def test_partitions_do_not_matter(spark, name):
    got = []
    for n in ("1", "2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = catalog.QUERIES[name](spark, SF)
        got.append(rows(df.columns, df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
