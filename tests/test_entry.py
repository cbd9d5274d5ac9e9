import duckdb
import pytest

import __spark_entry__ as entry
from veilwork.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or isinstance(v, (str, bool, int)):
        return v
    return round(float(v), 6)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=key)


def same_as_sql(spark, run, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, want = run(spark, SF), con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [k for k in core.FOUND if k != "batch_totals"])
def test_query(spark, name):
    if core.FOUND[name].sql:
        same_as_sql(spark, core.FOUND[name].run, core.FOUND[name].sql)
    else:
        assert core.FOUND[name].run(spark, SF).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
