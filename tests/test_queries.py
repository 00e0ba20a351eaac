"""Every registered query against its DuckDB statement on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from docspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame, columns):
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    found = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(tuple(text(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else text(v) for v in r) for r in found.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_each_query_has_sql_or_is_listed():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"fuzzy_label"}
