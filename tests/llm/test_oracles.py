"""Queries with SQL equal their DuckDB oracle; sharding's SQL too (all but crc32)."""

import os
import zlib

import duckdb
import pytest

from llm_cases import SF

from linewise.llm import queries
from linewise.llm.oracle import sharding_sql


def _sql(sql, cols):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return sorted(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=repr) == _sql(queries.ORACLE[name], cols)


def test_sharding_equals_sql(spark):
    got = queries.QUERIES["op7_sharding"](spark, SF)
    cols = [c for c in sorted(got.columns) if c != "text_crc32"]
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=repr) == _sql(sharding_sql(), cols)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got.collect())
