"""Every registered query against its SQL in DuckDB on the same tables."""

import os

import duckdb
import pytest

from corpusloom import queries as q


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def canonical(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_sql(spark, sf_dir, sql, name):
    frame = q.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    relation = sql.sql(q.ORACLES[name])
    assert columns == sorted(relation.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    assert canonical(frame.select(*columns).collect()) == canonical(sql.sql(f"SELECT {listed} FROM ({q.ORACLES[name]})").fetchall())


def test_queries_without_sql(spark, sf_dir):
    paths, edges = q.lineage_arcs(spark, sf_dir)
    real = {(r.src, r.dst) for r in edges.collect()}
    for walk in q.g.cycles(paths, edges):
        assert walk[0] == walk[-1] == min(walk) and all(p in real for p in zip(walk, walk[1:], strict=False))
