"""Votes of the guard's queries are taken over every other vector, the other queries' too."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point

EXPECTED = {
    "guard_vote": {"qid": 5, "score": 1.0, "best_category": "c0", "n_scored": 1},
    "guard_decide_embedding": {"qid": 5, "final_score": 1.0, "category": "c0", "judge_invoked": False, "action": "block"},
    "guard_decide_cascade": {"qid": 5, "final_score": 1.0, "category": "c0", "judge_invoked": False, "action": "block"},
    "guard_decide_judge": {"qid": 5, "final_score": 0.84, "category": "c0", "judge_invoked": True, "action": "block"},
    "guard_decide_max": {"qid": 5, "final_score": 1.0, "category": "c0", "judge_invoked": True, "action": "block"},
    "guard_worst_window": {"request_id": 5, "position": 5, "score": 1.0},
    "guard_responses": {"qid": 5, "status": 200, "guardrail": "content_filter"},
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_queries_vote_for_each_other(spark, tmp_path, name):
    vectors = [[1.0 if j == (0 if i == 5 else i) else 0.0 for j in range(10)] for i in range(10)]  # 0 and 5 are equal, all others apart
    rows = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry_point.queries()[name](spark, str(tmp_path))
    want = EXPECTED[name]
    key = next(iter(want))
    assert [r.asDict() for r in got.where(F.col(key) == 5).collect()] == [want]
