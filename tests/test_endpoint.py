"""Replies of embedding endpoints and streamed replies, case by case."""

import json
import math

import pytest
from pyspark.sql import functions as F

from emberlake.operators import chat, embeddings, guard


def items(*vectors, order=None):
    order = order or range(len(vectors))
    return json.dumps({"data": [{"index": i, "embedding": vectors[i]} for i in order]})


A, B = [3.0, 4.0], [0.0, 2.0]
CASES = [
    (2, items(A, B), None), (2, items(A, B, order=[1, 0]), None), (2, json.dumps({"data": [{"embedding": A}, {"embedding": B}]}), None),
    (2, json.dumps({"data": [{"index": None, "embedding": A}, {"embedding": B}]}), None),
    (2, None, "no_reply"), (2, "", "not_json"), (2, "busy", "not_json"), (2, "[]", "not_json"), (2, "{}", "not_json"),
    (2, '{"error":{"message":"no"}}', "endpoint_error"), (2, items(A), "wrong_count"), (2, items(A, B, A), "wrong_count"), (2, '{"data":[]}', "wrong_count"),
    (2, json.dumps({"data": [{"index": 1, "embedding": A}, {"index": 2, "embedding": B}]}), "bad_index"),
    (2, json.dumps({"data": [{"index": -1, "embedding": A}, {"index": 0, "embedding": B}]}), "bad_index"),
    (2, json.dumps({"data": [{"index": 0.5, "embedding": A}, {"index": 1, "embedding": B}]}), "bad_index"),
    (2, json.dumps({"data": [{"index": 99999999999, "embedding": A}, {"index": 1, "embedding": B}]}), "bad_index"),
    (2, json.dumps({"data": [{"index": 0}, {"index": 1, "embedding": B}]}), "no_vector"), (2, items(A, []), "no_vector"),
    (2, json.dumps({"data": [{"index": 1, "embedding": A}, {"index": 1, "embedding": B}]}), "repeated_index"),
    (2, items(A, [1.0]), "mixed_dimensions"), (2, items(A, [1.0, None]), "not_finite"), (2, items(A, [0.0, 0.0]), "zero_vector"), (1, items(B), None),
]


def test_replies_are_read_in_order_or_refused_whole(spark):
    rows = spark.createDataFrame([(i, [f"t{k}" for k in range(n)], r, "kept", "x") for i, (n, r, _) in enumerate(CASES)], "i int, texts array<string>, reply string, `a.b` string, slot string")
    out = embeddings.read_replies(rows, "texts", "reply").collect()
    assert len(out) == sum(n for n, _, _ in CASES) and all(r["a.b"] == "kept" for r in out)
    assert {r["i"]: r["problem"] for r in out} == {i: p for i, (_, _, p) in enumerate(CASES)}
    vectors = {(r["i"], r["text"]): r["vector"] for r in out}
    assert vectors[0, "t0"] == vectors[1, "t0"] == vectors[2, "t0"] == vectors[3, "t0"] == [0.6, 0.8]
    assert vectors[0, "t1"] == vectors[1, "t1"] == vectors[len(CASES) - 1, "t0"] == [0.0, 1.0]
    assert all(r["vector"] is None for r in out if r["problem"])
    assert embeddings.read_replies(rows.where("false"), "texts", "reply").count() == 0
    assert embeddings.read_replies(spark.createDataFrame([([], "{}")], "texts array<string>, reply string"), "texts", "reply").count() == 0


def test_embed_sends_each_text_once_with_its_prefix(spark, tmp_path):
    log = str(tmp_path / "log")

    def post(texts):
        with open(log, "a") as f:
            f.write(json.dumps(texts) + "\n")
        return json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(texts)))]})

    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, "")], "id int, `a.text` string")
    out = {r["id"]: r for r in embeddings.embed(rows, "a.text", post, "query", "e5").collect()}
    sent = [t for line in open(log) for t in json.loads(line)]
    assert sorted(sent) == ["query: ", "query: a", "query: bb"]
    assert out[4]["vector"] is None and out[4]["problem"] == "no_text"
    assert out[1]["vector"] == out[3]["vector"] == pytest.approx([8 / math.sqrt(65), 1 / math.sqrt(65)]) and out[5]["problem"] is None
    assert embeddings.embed(rows.where("false"), "a.text", post).count() == 0
    with pytest.raises(ValueError):
        embeddings.embed(rows, "a.text", post, style="unknown")


def test_an_endpoint_that_takes_no_lists_is_asked_text_by_text(spark, tmp_path):
    log = str(tmp_path / "log")

    def post(texts):
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        if len(texts) > 1:
            raise embeddings.ListRefused
        if texts[0] == "t3":
            raise RuntimeError("down")
        return json.dumps({"data": [{"embedding": [1.0, 0.0]}]})

    rows = spark.createDataFrame([(f"t{i}",) for i in range(10)], "t string").coalesce(1)
    got = {r["t"]: r["problem"] for r in embeddings.embed(rows, "t", post, batch=4).collect()}
    assert got == {f"t{i}": "no_reply" if i == 3 else None for i in range(10)}
    sizes = [int(n) for n in open(log)]
    assert sizes.count(1) == 10 and sum(n > 1 for n in sizes) <= 8  # refused once a task at most


def test_guard_takes_the_endpoints_problems(spark):
    messages = spark.createDataFrame([(1, 0, "user", "fine"), (2, 0, "user", "short"), (3, 0, "user", "gone")], "request_id long, turn int, role string, content string")
    exemplars = spark.createDataFrame([(1, [1.0, 0.0], "disallowed", "c", "x", "block", "about c"), (2, [0.0, 1.0], "allowed", "d", "y", "block", None)], "rid long, v array<double>, label string, category string, text string, action string, description string")

    def post(texts):
        if "gone" in texts:
            raise RuntimeError("down")
        return json.dumps({"data": [] if "short" in texts else [{"embedding": [0.0, 1.0]}]})

    def embedded(rows):
        return embeddings.embed(rows, "piece", post, "query", batch=1)

    out = guard.check_requests(messages, exemplars, embedded)
    assert {r["request_id"]: (r["action"], r["reason"]) for r in out.collect()} == {1: ("allow", None), 2: ("error", "embed_malformed"), 3: ("error", "embed_unreachable")}


def test_reply_streams_and_bodies(spark):
    rows = spark.createDataFrame([(1, 'say "hi"\n\\ é\u2028', True), (2, None, None), (3, "", False)], "id long, text string, usage boolean")
    note = chat.guardrail_note(F.lit("block"), F.lit("c"), F.lit(0.98765), F.lit(True), F.lit("p" * 20), F.lit(""), F.lit("r1"))
    given = (F.col("id").cast("string"), F.col("id"), F.lit("m"), F.col("text"), "content_filter")
    out = {r["id"]: r for r in rows.select("id", chat.reply_stream(*given, usage=F.col("usage"), note=note).alias("s"), chat.reply_body(*given, note=note, name="guardrail").alias("b")).collect()}
    shown = {"action": "block", "category": "c", "score": 0.9877, "judge_invoked": True, "policy": "p" * 12, "request_id": "r1"}
    zero = {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0}
    assert [len(out[i]["s"]) for i in (1, 2, 3)] == [5, 4, 4]
    for i, text in ((1, 'say "hi"\n\\ é\u2028'), (2, ""), (3, "")):
        lines = out[i]["s"]
        assert all(s.startswith("data: ") and s.endswith("\n\n") for s in lines) and lines[-1] == "data: [DONE]\n\n"
        chunks = [json.loads(s[6:]) for s in lines[:-1]]
        assert all((c["id"], c["object"], c["created"], c["model"]) == (str(i), "chat.completion.chunk", i, "m") for c in chunks)
        assert [c["choices"] for c in chunks[:3]] == [
            [{"index": 0, "delta": {"role": "assistant"}, "finish_reason": None}], [{"index": 0, "delta": {"content": text}, "finish_reason": None}],
            [{"index": 0, "delta": {}, "finish_reason": "content_filter"}],
        ]
        assert [c.get("guardrail") for c in chunks[:3]] == [shown, None, None]
        assert i != 1 or (chunks[3]["choices"], chunks[3]["usage"]) == ([], zero)
        body = json.loads(out[i]["b"])
        assert body["choices"] == [{"index": 0, "message": {"role": "assistant", "content": text}, "finish_reason": "content_filter"}]
        assert (body["object"], body["usage"], body["guardrail"]) == ("chat.completion", zero, shown)
    hit = spark.range(1).select(chat.hit_note(F.lit(None).cast("double")).alias("n")).first()["n"]
    assert json.loads(hit) == {"hit": True, "similarity": None}
    lines = rows.select("id", F.posexplode(chat.reply_stream(*given, usage=F.col("usage"))).alias("seq", "line"))
    read = {r["id"]: r for r in chat.accumulate_stream(lines, "id").collect()}
    assert (read[1]["content"], read[1]["finish_reason"], read[1]["total_tokens"], read[1]["done"]) == ('say "hi"\n\\ é\u2028', "content_filter", 0, True)
    assert (read[2]["content"], read[2]["total_tokens"]) == ("", None)


def test_cache_text_reads_the_parts_of_the_last_user_message(spark):
    rows = [(1, 0, "user", "first"), (1, 1, "user", '[{"type":"text","text":" a"},{"type":"image_url"},{"type":"text","text":"b "}]'), (2, 0, "user", "kept"), (2, 1, "user", '[{"type":"image_url"}]'), (2, 2, "assistant", "x")]
    m = spark.createDataFrame(rows, "c long, turn int, role string, text string")
    assert {r["c"]: r["cache_text"] for r in chat.last_user_text(m, "c", "turn", "role", "text").collect()} == {1: "a b", 2: None}


@pytest.mark.parametrize(
    ("scores", "n", "part"),
    [
        ([("disallowed", 0.9, "p"), ("allowed", 0.1, "q")], 0, None),
        ([("disallowed", 0.0, "p"), ("allowed", 0.1, "q")], 1, "Lower min_similarity first"),
        ([("disallowed", 0.9, "p"), ("allowed", 1.0, "q")], 1, "No block_threshold passes"),
        ([("disallowed", 0.3, "p"), ("allowed", 0.2, "q")], 1, "allow_threshold below 0.30, block_threshold above 0.20."),
        ([("disallowed", 0.5, "p"), ("allowed", 0.8, "z" * 90)], 1, "z" * 77 + "...': allowed_at_block; block_threshold above 0.80"),
        ([("disallowed", 0.5, "p"), ("allowed", 0.8, "q")], 1, "overlap"),
        ([("disallowed", 0.1, str(i)) for i in range(8)], 8, "and 3 more"),
        ([], 0, None),
    ],
)
def test_explanation(spark, scores, n, part):
    loo = spark.createDataFrame([(i, *s) for i, s in enumerate(scores)], "qid long, label string, score double, text string")
    got = guard.explanation(loo, 0.35, 0.75, 0.25, text_col="text").collect()
    assert len(got) == 1 and got[0]["n_problems"] == n
    assert got[0]["message"] is None if part is None else part in got[0]["message"]
    assert part is None or len(got[0]["message"].split("\n")) >= 3
