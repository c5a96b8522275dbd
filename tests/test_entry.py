"""The driver's contract, and the SQL of every query on the smallest tables."""

import glob
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import DATA

ORACLES = entry.oracle_sql()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["stream_changes", "stream_history", "stream_sessions"])
def test_streams_of_tables_that_are_folders(spark, tmp_path, name):
    table = {"stream_changes": "documents", "stream_history": "conversations", "stream_sessions": "events"}[name]
    spark.read.parquet(f"{DATA}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, want = entry.queries()[name](spark, str(tmp_path)), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(tuple(cell(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(cell(v) for v in r) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_context_assembly_is_whole(spark, tmp_path):
    for name in ("conversations", "embeddings"):
        os.symlink(f"{DATA}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{DATA}/part.parquet").limit(0).unionByName(spark.range(400_000).selectExpr("id AS p_partkey", "1 AS p_size"), allowMissingColumns=True).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for name, files in (("conversations", ""), ("embeddings", ""), ("part", "/*.parquet")):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet{files}'")
    got, want = entry.queries()["context_assembly"](spark, str(tmp_path)).first()[0], con.sql(ORACLES["context_assembly"]).fetchall()[0][0]
    assert len(got) > 40_000 and got == want


@pytest.mark.parametrize("name", [k for k in sorted(ORACLES) if not re.match(r"op\d|pipeline", k)])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = entry.queries()[name](spark, DATA), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(tuple(cell(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(cell(v) for v in r) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert a == b


def test_high_complexity_returns_all(spark, tmp_path):
    rows = [(k, 30 + k % 20) for k in range(4200)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = [tuple(r) for r in entry.queries()["high_complexity"](spark, str(tmp_path)).collect()]
    name = lambda k: f"svc{k % 3}.Class{k % 50}.element{k % 100}#{k}"
    assert got == sorted((r for r in rows if r[1] >= 40 and r[0] % 3 == 0), key=lambda r: (-r[1], name(r[0]))) and len(got) == 700


def test_def_use_summary_takes_all_users(spark, tmp_path):
    rows = [(k, k * 7 % 50, "ab"[k % 2], 1000 - k, float(k % 20)) for k in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts long, value double").write.parquet(f"{tmp_path}/events.parquet")
    ids = lambda g, low: ",".join(str(r[0]) for r in sorted(rows, key=lambda r: r[3]) if r[1:3] == g and (r[4] < 10) == low) or None
    got = sorted(tuple(r)[:4] for r in entry.queries()["def_use_summary"](spark, str(tmp_path)).collect())
    assert got == sorted((*g, ids(g, True), ids(g, False)) for g in {r[1:3] for r in rows})
