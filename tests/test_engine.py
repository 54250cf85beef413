"""The engine over a folder, model seams, and access rules."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.engine import RecallEngine
from emberlake.functions import access
from emberlake.operators import seams

ENTRY = "text string, response string, scope string, embedding array<double>"
QUERY = "query_id long, text string, scope string, embedding array<double>"


def test_set_search_purge(spark, tmp_path):
    engine = RecallEngine(spark, f"{tmp_path}/cache", ["exact", "bm25", "semantic"], floor=0.9)
    assert engine.search(spark.createDataFrame([(1, "x", None, [1.0, 0.0])], QUERY), 0).first()["hit"] is False
    engine.set(spark.createDataFrame([("red  apple pie", "A", None, [1.0, 0.0]), ("green pear", "B", "s", [0.0, 1.0])], ENTRY), 100)
    engine.set(spark.createDataFrame([("red apple pie", "A2", None, [2.0, 0.0])], ENTRY), 200)
    asked = [(1, "red apple pie", None, None), (2, "pie red", None, None), (3, "other", "s", [0.1, 3.0]), (4, "other", None, [0.1, 3.0]), (5, "green pear", None, None)]
    got = {r["query_id"]: (r["method"], r["response"]) for r in engine.search(spark.createDataFrame(asked, QUERY), 300).collect()}
    assert got == {1: ("exact", "A2"), 2: ("bm25", "A2"), 3: ("semantic", "B"), 4: (None, None), 5: (None, None)}
    assert not engine.search(spark.createDataFrame(asked, QUERY), 10**9).where("hit").count()
    assert engine.migrate() == 0
    assert engine.purge("S") == 1 and engine.purge() == 1 and engine.entries().count() == 0


def test_entity_aware_tier(spark, tmp_path):
    engine = RecallEngine(spark, f"{tmp_path}/aware", "entity-aware", exact_tier=False, floor=0.9)
    more = ", entities array<string>, domain string"
    rows = [("a", "A", None, [1.0, 0.0], ["Paris"], None), ("b", "B", None, [1.0, 0.1], ["Rome"], ""), ("c", "C", None, [0.0, 1.0], None, None), ("d", "D", None, [1.0, 0.0], ["Paris"], "law")]
    engine.set(spark.createDataFrame(rows, ENTRY + more), 100)
    assert {(r["domain"], r["entity_sig"] == "none", r["entities"]) for r in engine.entries().collect()} == {("general", False, '["paris"]'), ("general", False, '["rome"]'), ("general", True, "[]"), ("law", False, '["paris"]')}
    asked = [(1, "x", None, [1.0, 0.0], [" rome"], None), (2, "x", None, [0.0, 1.0], ["rome"], None), (3, "x", None, [0.0, 1.0], [], None), (4, "x", None, [1.0, 0.0], ["PARIS"], "law"), (5, "x", "s", [1.0, 0.0], ["paris"], None), (6, "x", None, [1.0, 1.0], ["paris"], None)]
    got = {r["query_id"]: (r["method"], r["response"]) for r in engine.search(spark.createDataFrame(asked, QUERY + more), 200).collect()}
    none = (None, None)
    assert got == {1: ("entity-aware", "B"), 2: none, 3: ("entity-aware", "C"), 4: ("entity-aware", "D"), 5: none, 6: none}
    plain = engine.search(spark.createDataFrame([(1, "x", None, [0.0, 1.0])], QUERY), 200).first()
    assert plain["response"] == "C"


def test_failed_extraction_is_not_stored_and_misses(spark, tmp_path):
    def extractor(texts):
        if any("broken" in t for t in texts):
            raise ValueError("no answer")
        return [["paris"] for _ in texts]

    engine = RecallEngine(spark, f"{tmp_path}/extracted", ["entity-aware", "bm25"], exact_tier=False, floor=0.9, extractor=extractor)
    engine.set(spark.createDataFrame([("red apple", "A", None, [1.0, 0.0]), ("broken pear", "B", None, [0.0, 1.0])], ENTRY), 100)
    assert [(r["response"], r["entities"]) for r in engine.entries().collect()] == [("A", '["paris"]')]
    asked = [(1, "fine", None, [1.0, 0.0]), (2, "broken", None, [1.0, 0.0]), (3, "apple red", None, [0.0, 1.0])]
    got = {r["query_id"]: r["method"] for r in engine.search(spark.createDataFrame(asked, QUERY), 200).collect()}
    assert got == {1: "entity-aware", 2: None, 3: "bm25"}


def test_models_see_each_text_once(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", None, "bad"])], "id int, t string")

    def model(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        assert len(set(texts)) == len(texts)
        return [[float(len(t)), 1.0] for t in texts]

    out = seams.checked_vectors(seams.apply_model(rows, "t", "v", T.ArrayType(T.DoubleType()), model), "v", 2)
    got = {r["id"]: (r["v"], r["problem"]) for r in out.collect()}
    assert got[0] == got[2] == ([1.0, 1.0], None) and got[3] == got[4] == (None, "missing")


def test_claims(spark):
    def ok(claims, **rules):
        frame = spark.createDataFrame([(json.dumps(claims),)], "c string")
        return frame.select(access.claims_valid(F.col("c"), F.lit(100.0), **rules)).first()[0]

    assert ok({"exp": 100}) and not ok({"exp": 99}) and ok({"exp": 99}, leeway=1.0)
    assert not ok({}) and not ok({"exp": True}) and not ok({"exp": 200, "nbf": 150})
    assert ok({"exp": 200, "iss": "i", "aud": ["x", "y"]}, issuer="i", audience="y")
    assert not ok({"exp": 200, "iss": "j"}, issuer="i") and not ok({"exp": 200, "aud": "x"}, audience="y")
    frame = spark.createDataFrame([('{"org": " ", "tenant": "t", "sub": 7}',)], "c string")
    assert frame.select(access.external_identity(F.col("c"), ["org", "tenant"], ["sub"])).first()[0] == "t|7"


def test_retry_and_budgets(spark):
    one = spark.range(1)
    assert one.select(access.backoff_schedule(F.lit(3), F.lit(0.5))).first()[0] == [0.5, 1.0, 2.0]
    assert one.select(access.backoff_schedule(F.lit(0), F.lit(0.5))).first()[0] == []
    cases = [("ReadTimeout", None, True), ("HTTPError", 429, True), ("HTTPError", 503, True), ("HTTPError", 404, False), (None, None, False)]
    rows = spark.createDataFrame([c[:2] for c in cases], "e string, s int").select(access.retryable(F.col("e"), F.col("s"))).collect()
    assert [r[0] for r in rows] == [c[2] for c in cases]
    assert one.select(access.embed_timeout(F.lit(10.0), F.lit("cascade"))).first()[0] == 3.0
    assert one.select(access.judge_timeout(F.lit(3.0))).first()[0] == 3.0
