"""Every registered query against its DuckDB SQL at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from stackwise.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    expected = [tuple(map(plain, r)) for r in want.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))
    assert rows or name in ("task_dedupe_exact", "sql_task_dedupe_exact", "sql_task_dedupe_keepers", "copy_round_trip")  # no two records there share a key


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_identifiers_of_seven_digits(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (p_partkey + 999998 AS p_partkey) FROM '{SF}/part.parquet' LIMIT 5) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["identifiers"]).fetchall()
    got = catalogue.QUERIES["identifiers"](spark, str(tmp_path)).select("record_no", "isbn", "oclc", "lccn", "issn").collect()
    assert sorted(map(tuple, got)) == sorted(want)
