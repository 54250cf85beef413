"""Texts meet their kept answers by hash: what is stored and shuffled for it holds no text."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.operators import seams


def test_memo_stores_and_joins_keys(spark, tmp_path):
    long = "".join(chr(97 + i * i % 26) for i in range(5_000))
    rows = spark.createDataFrame([(1, f"A {long}"), (2, f"B {long}"), (3, f"A {long}"), (4, None), (5, "")], "id long, t string")
    memo, sent = seams.Memo(spark, f"{tmp_path}/memo", T.StringType(), 100), spark.sparkContext.accumulator(0)

    def model(texts):
        sent.add(len(texts))
        return [t[:1] for t in texts]

    memo.apply(rows.where("id <> 2"), "t", "found", model, 0)
    out, counts = memo.apply(rows, "t", "found", model, 10)
    assert counts == {"memo_hits": 2, "extracted": 1, "extractor_errors": 0} and sent.value == 3
    assert out.columns == ["id", "t", "found"]
    assert {r["id"]: r["found"] for r in out.select("id", "found").collect()} == {1: "A", 2: "B", 3: "A", 4: None, 5: ""}
    kept = spark.read.parquet(f"{tmp_path}/memo/m1", f"{tmp_path}/memo/m2")
    assert kept.select(F.length(F.to_json(F.struct("*"))).alias("n")).agg(F.max("n")).first()[0] < 200  # no text of 5,000 characters
    plan = out.select("id", "found")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_model_results_are_joined_by_key(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, t string")
    out = seams.apply_model(rows, "t", "n", T.LongType(), lambda texts: [len(t) for t in texts])
    assert "unhex" in out._jdf.queryExecution().optimizedPlan().toString() and out.columns == ["id", "t", "n"]
    assert {r["id"]: r["n"] for r in out.collect()} == {1: 1, 2: 1, 3: None}
