"""Text, key, vector, masking and reply functions at their edges."""

import hashlib
import hmac

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.functions import masking, replies, text, vectors
from emberlake.sources.tables import pack_vector, unpack_vector


def one(spark, column, **values):
    row = spark.range(1)
    for name, value in values.items():
        row = row.withColumn(name, F.lit(value))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("What is the CAPITAL of France?", "capital france"),
        ("what is it", "what is it"),
        ("can't stop", "cant stop"),
        ("Covid-19 type ۲", "covid 19 type 2"),
        ("ﬁne　print", "fine print"),
        ("do not take it", "not take"),
        ("", ""),
        (None, ""),
        ("snake_case", "snake_case"),
    ],
)
def test_canonical(spark, raw, want):
    assert one(spark, text.canonical(F.col("t")), t=raw) == want


def test_clean_and_tokens(spark):
    assert one(spark, text.clean(F.col("t")), t="\xa0 a b\n\tc\x85") == "a b c"
    assert one(spark, text.tokens(F.col("t")), t="سلام‌دنیا a_b, c1") == ["سلام", "دنیا", "a_b", "c1"]
    assert one(spark, text.fulltext_value(F.col("t")), t="!?") == "!?"


@pytest.mark.parametrize("raw, want", [(None, "_default"), ("", "_default"), ("  ", "_default"), ("A b-C", "a_b_c"), ("p#g1", "p_g1"), ("é", "_")])
def test_scope_tag(spark, raw, want):
    assert one(spark, text.scope_tag(F.col("t")), t=raw) == want


def test_keys(spark):
    want = "cache:" + hashlib.sha256(b"s1\x00hello").hexdigest()
    assert one(spark, text.entry_key(F.lit("S1"), F.lit("hello"))) == want
    assert one(spark, text.entity_signature(F.array(F.lit(" B "), F.lit("a"), F.lit("b")))) == hashlib.sha256(b"a|b").hexdigest()
    assert one(spark, text.entity_signature(F.array().cast("array<string>"))) == "none"
    assert one(spark, text.hmac_sha256(b"pepper", F.lit("key"))) == hmac.new(b"pepper", b"key", hashlib.sha256).hexdigest()
    assert one(spark, text.guarded_scope(F.lit("s"), F.lit("0123456789abcdef"))) == "s#g0123456789ab"
    assert one(spark, text.model_slug(F.lit("a/b:c"))) == "a_b_c"


def test_entities_overlap(spark):
    none, a, b = F.array().cast("array<string>"), F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a"))
    got = [one(spark, text.entities_overlap(x, y)) for x, y in ((none, none), (a, b), (a, none), (F.lit(None).cast("array<string>"), none))]
    assert got == [True, True, False, True]


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, vectors.cosine(v(1.0, 0.0), v(0.0, 0.0))) == 0.0
    assert one(spark, vectors.cosine(v(3.0, 4.0), v(3.0, 4.0))) == pytest.approx(1)
    assert not one(spark, vectors.valid(v(float("nan"), 1.0)))
    assert not one(spark, vectors.valid(v(1e-4, 0.0)))
    assert one(spark, vectors.normalised(v(3.0, 4.0))) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.matches_sentinel(v(1.0, 0.0), v(1.0, 0.0)))
    assert not one(spark, vectors.matches_sentinel(v(1.0, 0.0), v(1.0, 0.0, 0.0)))
    e = one(spark, vectors.trigram_embedding(F.lit("Hello hello world")))
    assert len(e) == 64 and np.linalg.norm(e) == pytest.approx(1)
    assert one(spark, vectors.trigram_embedding(F.lit("?!")))[0] == 1.0
    packed = pack_vector(F.array(F.lit(1.5), F.lit(-2.0)))
    assert one(spark, unpack_vector(packed, 2)) == [1.5, -2.0]
    assert one(spark, unpack_vector(packed, 3)) is None


@pytest.mark.parametrize(
    "raw, gone, stays",
    [
        ("Authorization: Bearer abcdefgh12345", "abcdefgh12345", "Authorization"),
        ('{"api_key": "s3cret"}', "s3cret", "api_key"),
        ("GET /?token=abc123&x=1", "abc123", "x=1"),
        ("postgresql://user:pw@host/db", "user:pw", "host/db"),
        ("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOjF9.sig", "eyJhbGci", ""),
        ("use sk-proj_3f8a1c9d now", "3f8a1c9d", "now"),
        ("SC_APP_SERVICE_KEY=topvalue", "topvalue", "SC_APP_SERVICE_KEY"),
        ("nothing to hide", "~", "nothing to hide"),
    ],
)
def test_redact(spark, raw, gone, stays):
    out = one(spark, masking.redact(F.col("t")), t=raw)
    assert gone not in out and stays in out


def test_redact_body(spark):
    out = one(spark, masking.redact_body(F.col("t"), 10), t="x" * 30)
    assert out == "x" * 10 + "... [truncated, 30 chars]"


@pytest.mark.parametrize(
    "reply, confidence, error",
    [
        ('{"confidence": 0.5}', 0.5, None),
        ('```json\n{"score": "0.25", "reason": " r "}\n```', 0.25, None),
        ('Sure: {"probability": 1} and {more}', 1.0, None),
        ('{"confidence": 1.0005}', 1.0, None),
        ('{"confidence": -0.0005}', 0.0, None),
        ('{"confidence": 1.5}', None, "out_of_range"),
        ('{"confidence": true}', None, "no_confidence"),
        ('{"confidence": "high"}', None, "no_confidence"),
        ('{"confidence": NaN}', None, "no_confidence"),
        ('{"verdict": 1}', None, "no_confidence"),
        ("[1]", None, "not_an_object"),
        ("no json", None, "no_object"),
        ("{broken", None, "invalid_json"),
        ("  ", None, "empty"),
        (None, None, "empty"),
    ],
)
def test_judge_verdict(spark, reply, confidence, error):
    got = one(spark, replies.judge_verdict(F.col("t")), t=reply)
    assert (got["confidence"], got["error"]) == (confidence, error)


def test_entities(spark):
    get = lambda t: one(spark, replies.extracted_entities(F.col("t")), t=t)
    assert [e["identifier"] for e in get('x {"entities": [{"type": "P", "text": "Ann"}, {"type": "P"}, 3, {"type": "Q", "identifier": "q1"}]} y')] == ["Ann", "q1"]
    assert get('{"entities": []}') == [] and get("nope") is None and get('{"entities": 3}') is None


def test_reply_fields(spark):
    got = one(spark, replies.judge_verdict(F.col("t")), t='{"confidence": 0.7, "reason": null, "matched_category": " c "} {"confidence": 0}')
    assert tuple(got) == (0.7, "", "c", None)
    assert one(spark, replies.judge_verdict(F.col("t")), t='{"confidence": 1e999}')["error"] == "out_of_range"
    assert one(spark, replies.extracted_entities(F.col("t")), t='{"entities": []} and {more}') is None  # to the last brace
