"""Every query with an SQL form gives DuckDB's rows on the smallest tables; the others run."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

from tessera.plans.queries import ORACLE, QUERIES

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        return x.normalize()
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in ORACLE:
        want = duck.execute(ORACLE[name])
        names = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(names)
        got, wanted = bag(rows, df.columns), bag(want.fetchall(), names)
        assert got == wanted, (list((got - wanted).items())[:3], list((wanted - got).items())[:3])
    else:
        assert df.columns


@pytest.mark.parametrize("name", ["q_published", "q_filter_stats", "q_equivalent_pairs"])
def test_equal_formulas(spark, tmp_path, name):
    lines = ["first line of all", "say a=b here", "another line", "say a=b here", "last line of all", "rent is due now", "rent is due now", "rent is due now"]
    spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[::-1]))], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df, want = QUERIES[name](spark, str(tmp_path)), con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert bag(df.collect(), df.columns) == bag(want.fetchall(), names)


@pytest.mark.parametrize("name", ["q_published", "q_filter_stats", "q_equivalent_pairs"])
def test_odd_blanks_and_repeated_ids(spark, tmp_path, name):
    odd = [" rent is due", "rent is due", "a　line here", "12 ", "a line here", "a\x0bline", "say so", "　3", "say so"]
    one, two = ["1、rent is due", "rent is due", "other text", "no more"], ["rent is due", "rent is due", "short", "shorter text"]
    rows = [(1, odd), (2, odd[::-1]), (3, one), (3, two), (4, two), (4, two), (4, one)]
    spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df, want = QUERIES[name](spark, str(tmp_path)), con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert bag(df.collect(), df.columns) == bag(want.fetchall(), names)
