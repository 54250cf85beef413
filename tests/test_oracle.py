"""Every query with SQL against DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry_point.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(entry_point.oracle_sql()[name])
    assert sorted(want.columns) == columns
    left = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    picked = ", ".join(f'"{c}"' for c in columns)
    right = sorted((tuple(map(plain, r)) for r in duck.sql(f"SELECT {picked} FROM ({entry_point.oracle_sql()[name]})").fetchall()), key=repr)
    assert left == right


# Queries without SQL answer every row of a table (None: some of its rows); their values are tested elsewhere.
ROWS = {
    "segment_memo": "events", "rate_limit_decisions": "events", "breaker_states": "events", "redact_documents": "documents",
    "redact_body": "pages", "trigram_embeddings": "benchmark", "key_touches": "events", "stream_rate_limit": "events", "stream_breaker": "events", "fuzzy_top1": None, "guard_chain": None,
}
PLAIN = {n for n in set(entry_point.queries()) - set(entry_point.oracle_sql()) if not n.startswith("op") and n != "pipeline"}


def test_every_query_has_a_test():
    assert PLAIN == set(ROWS)


@pytest.mark.parametrize("name", sorted(n for n, t in ROWS.items() if t))
def test_other_queries_answer_every_row(spark, duck, name):
    got = entry_point.queries()[name](spark, SF)
    key = got.columns[0]
    want = sorted(r[0] for r in duck.sql(f"SELECT {key} FROM {ROWS[name]}").fetchall())
    assert sorted(r[0] for r in got.select(key).collect()) == want


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
