"""Rows of a query and of its SQL in one comparable form."""

from __future__ import annotations

import os


def cell(v) -> str:
    if v is None:
        return "~"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def normal(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


def assert_same(spark, query, sql: str, sf_dir: str) -> None:
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    frame, other = query(spark, sf_dir), con.sql(sql)
    assert sorted(frame.columns) == sorted(other.columns)
    assert normal(frame.collect(), frame.columns) == normal(other.fetchall(), other.columns)
