"""What goes between tasks in the lexical search, with results as before."""

import pytest
from pyspark.sql import functions as F

from emberlake.operators import lexical
from emberlake.sources import tables, text_index

TEXTS = ["red fox runs", "red fox", "", None, "blue blue fox jumps far", "red red fox naps", "ünï fox red 7 7 7"]
ASKED = ["fox red", "red fox", "blue", "none at all", "red"]


@pytest.fixture
def index(spark, tmp_path):
    rows = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(TEXTS)], "entry_id long, text string, scope string")
    text_index.build(rows, f"{tmp_path}/i", keep=["scope"])
    return text_index.TextIndex(spark, [f"{tmp_path}/i"])


def test_tokens_are_counted_within_rows(index, monkeypatch):
    got = {r["entry_id"]: (r["length"], dict(zip(r["tokens"], r["tfs"]))) for r in index.table("forward").collect()}
    assert got[4] == (5, {"blue": 2, "fox": 1, "jumps": 1, "far": 1}) and got[2] == got[3] == (0, {}) and got[6] == (6, {"ünï": 1, "fox": 1, "red": 1, "7": 3})
    assert len(got) == len(TEXTS)


@pytest.mark.parametrize("small", [True, False])
def test_equal_questions_are_searched_once(spark, index, monkeypatch, small):
    monkeypatch.setattr(lexical, "fits_broadcast", lambda df: small)
    asked = lexical.query_words(spark.createDataFrame(list(enumerate(ASKED * 3)), "query_id long, text string"), "query_id", "text")
    ones, members = lexical._once(asked, ())
    assert ones.count() == 4 and members.count() == 15
    plain = lexical.lexical_index(spark.createDataFrame(list(enumerate(TEXTS)), "entry_id long, text string").where("text is not null"), "entry_id", "text")
    for scorer in ("DISMAX", "DOCSCORE"):  # sums of counts alone: of no statistics of null texts
        want = {tuple(r) for r in lexical.best_match(lexical.lexical_matches(plain, asked, scorer)).select("query_id", "entry_id", "score").collect()}
        got = [tuple(r) for r in lexical.indexed_best(index, asked, scorer).select("query_id", "entry_id", "score").collect()]
        assert set(got) == want and len(got) == len(want) == 12
    fuzzy = lexical.indexed_fuzzy(index, asked, 1)
    assert {r[0]: r[1] for r in fuzzy.groupBy("query_id").agg(F.count("*")).collect()}[0] == fuzzy.where("query_id = 11").count()


def test_measure_of_broadcasts(spark, tmp_path):
    rows = tables.staged(spark.range(1_000))
    assert tables.fits_broadcast(rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        assert not tables.fits_broadcast(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
