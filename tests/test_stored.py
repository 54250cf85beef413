"""What the engine stores: the change log, its mirror, the text index, kept answers, the decision log."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.engine import RecallEngine
from emberlake.functions import text, vectors
from emberlake.operators import lexical, nearest, seams
from emberlake.operators.clusters import Clusters
from emberlake.sources import text_index
from emberlake.sources.entry_table import EntryTable, mirror
from emberlake.sources.sinks import DecisionLog

ENTRY = "text string, response string, scope string, embedding array<double>"
QUERY = "query_id long, text string, scope string, embedding array<double>"


def write(engine, spark, texts, now, scope=None):
    engine.set(spark.createDataFrame([(t, f"to {t}", scope, None) for t in texts], ENTRY), now)


def ask(engine, spark, texts, now, scope=None):
    out = engine.search(spark.createDataFrame([(i, t, scope, None) for i, t in enumerate(texts)], QUERY), now)
    return {r["query_id"]: r["hit"] for r in out.collect()}


def state(engine):
    return {(r["scope"], r["text"]): (r["hits"], r["expires_at"]) for r in engine.entries().collect()}


def test_hits_count_renew_and_promote(spark, tmp_path):
    engine = RecallEngine(spark, f"{tmp_path}/cache", "exact", ttl=100, permanent_hits=4, compact_after=99)
    write(engine, spark, ["a", "b"], 0)
    assert ask(engine, spark, ["a", "a", "c"], 50) == {0: True, 1: True, 2: False}
    assert state(engine) == {("_default", "a"): (3, 150), ("_default", "b"): (1, 100)}
    assert engine.last == {"lookups": 3, "hits": 2, "hits_exact": 2}
    assert ask(engine, spark, ["a", "b"], 120) == {0: True, 1: False}  # a was renewed, b has gone
    assert state(engine)["_default", "a"] == (4, None)
    write(engine, spark, ["b"], 130)
    assert state(engine)["_default", "b"] == (1, 230)
    engine.compact()
    before = state(engine)
    assert engine.table.changes(engine.table._base()).count() == 0 and before == {("_default", "a"): (4, None), ("_default", "b"): (1, 230)}
    ask(engine, spark, ["a", "b"], 200)
    assert state(engine) == {("_default", "a"): (5, None), ("_default", "b"): (2, 300)}
    write(engine, spark, ["a"], 210)  # a new write starts anew: earlier touches are not its own
    assert state(engine)["_default", "a"] == (1, 310)
    write(engine, spark, ["x"], 220, "Team One")
    assert engine.purge("team one") == 1 and engine.purge("team one") == 0
    write(engine, spark, ["x"], 230, "Team One")
    assert state(engine)["team_one", "x"] == (1, 330)


def test_mirror_follows_the_feed(spark, tmp_path):
    engine = RecallEngine(spark, f"{tmp_path}/cache", "exact", ttl=100, permanent_hits=3, compact_after=3)
    copy = EntryTable(spark, f"{tmp_path}/mirror", 100, 3)
    write(engine, spark, ["a", "b"], 0)
    mirror(engine.table, copy, f"{tmp_path}/state")
    ask(engine, spark, ["a", "b", "a"], 10)
    write(engine, spark, ["b", "c"], 20)
    engine.purge("nobody")
    ask(engine, spark, ["c"], 30)
    mirror(engine.table, copy, f"{tmp_path}/state")
    rows = lambda t: sorted(map(repr, t.entries().select("entry_key", "text", "hits", "expires_at", "entry_id").collect()))
    assert rows(copy) == rows(engine.table) and copy.batches() == engine.table.batches()
    mirror(engine.table, copy, f"{tmp_path}/another state")  # all of it once more
    assert rows(copy) == rows(engine.table)


def test_reads_are_pruned(spark, tmp_path):
    engine = RecallEngine(spark, f"{tmp_path}/cache", "exact")
    for scope in ("one", "two"):
        write(engine, spark, [f"{scope} {i}" for i in range(20)], 0, scope)
    engine.compact()
    plan = engine.table.of_scope("one")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(scope" in plan and engine.table.of_scope("one").count() == 20
    keys = [r[0] for r in engine.entries().select("entry_key").limit(2).collect()]
    found = engine.table.lookup(keys)
    assert found.count() == 2 and "PushedFilters: [In(entry_key" in found._jdf.queryExecution().toString()


def test_lookup_counters_equal_the_outcomes(spark, tmp_path):
    def extractor(texts):
        if any("broken" in t for t in texts):
            raise ValueError("no answer")
        return [["paris"] for _ in texts]

    engine = RecallEngine(spark, f"{tmp_path}/cache", ["entity-aware", "bm25"], exact_tier=False, floor=0.9, extractor=extractor)
    engine.set(spark.createDataFrame([("red apple", "A", None, [1.0, 0.0]), ("broken pear", "B", None, [0.0, 1.0])], ENTRY), 100)
    assert engine.last == {"memo_hits": 0, "extracted": 1, "extractor_errors": 1, "writes": 1}
    asked = spark.createDataFrame([(1, "fine", None, [1.0, 0.0]), (2, "broken", None, [1.0, 0.0]), (3, "apple red", None, [0.0, 1.0]), (4, "red apple", None, [1.0, 0.0])], QUERY)
    out = engine.search(asked, 200)
    by = {r["method"]: r["n"] for r in out.groupBy("method").agg(F.count("*").alias("n")).collect()}
    assert engine.last == {"lookups": 4, "hits": 3, "hits_entity-aware": by["entity-aware"], "hits_bm25": by["bm25"], "memo_hits": 1, "extracted": 2, "extractor_errors": 1}


def test_kept_answers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "bad")], "id int, t string")
    memo = seams.Memo(spark, f"{tmp_path}/memo", T.ArrayType(T.StringType()), 100)

    def model(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[] if t == "b" else [t] for t in texts]

    def never(texts):
        raise AssertionError("called")

    first, counts = memo.apply(rows, "t", "found", model, 0)
    assert {r["id"]: r["found"] for r in first.collect()} == {1: ["a"], 2: [], 3: ["a"], 4: None, 5: None}
    assert counts == {"memo_hits": 0, "extracted": 2, "extractor_errors": 1}
    again, counts = memo.apply(rows.where("t <> 'bad'"), "t", "found", never, 99)  # no call: even the empty list is kept
    assert {r["id"]: r["found"] for r in again.collect()} == {1: ["a"], 2: [], 3: ["a"]} and counts["extracted"] == 0 and counts["memo_hits"] == 2
    assert memo.apply(rows, "t", "found", model, 100)[1] == {"memo_hits": 0, "extracted": 2, "extractor_errors": 1}  # stale from the hundredth second on


WORDS = [a + b + c for a in ("kar", "lo", "m") for b in ("a", "enti", "u") for c in ("x", "ver", "tz", "")]


@pytest.fixture(scope="module")
def entries():
    draw = random.Random(11)
    return [(i, " ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 30))), draw.choice(["s", "t"])) for i in range(300)]


def test_stored_index_equals_plain_search(spark, tmp_path, entries, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 4)  # many blocks: most are ruled out by their bounds
    rows = spark.createDataFrame(entries, "entry_id long, text string, scope string")
    draw = random.Random(12)
    asked = spark.createDataFrame([(i, " ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 4)))) for i in range(40)] + [(99, ""), (98, "unknown word")], "query_id long, text string")
    words = lexical.query_words(asked, "query_id", "text")
    text_index.build(rows, f"{tmp_path}/whole", keep=["scope"])
    for part in (0, 1):
        text_index.build(rows.where(F.col("entry_id") % 2 == part), f"{tmp_path}/p{part}", keep=["scope"])
    plain = lexical.lexical_index(rows, "entry_id", "text", "scope")
    for folders in (["whole"], ["p0", "p1"]):
        index = text_index.TextIndex(spark, [f"{tmp_path}/{f}" for f in folders])
        for scorer in lexical.SCORERS:
            want = {tuple(r) for r in lexical.best_match(lexical.lexical_matches(plain, words, scorer)).collect()}
            assert {tuple(r) for r in lexical.indexed_best(index, words, scorer).select("query_id", "entry_id", "score").collect()} == want
        by = lexical.indexed_best(index, words, by=("scope",)).count()
        assert by == lexical.lexical_matches(plain, words).join(rows.select("entry_id", "scope"), "entry_id").select("query_id", "scope").distinct().count()
        live = rows.where("entry_id % 3 <> 0")
        some = lexical.lexical_index(live, "entry_id", "text")
        want = {tuple(r) for r in lexical.best_match(lexical.lexical_matches(some, words)).collect()}
        assert {tuple(r) for r in lexical.indexed_best(index, words, live=live).select("query_id", "entry_id", "score").collect()} == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_stored_spelling_equals_brute_force(spark, tmp_path, entries, distance):
    rows = spark.createDataFrame(entries[:120], "entry_id long, text string, scope string")
    text_index.build(rows, f"{tmp_path}/whole", keep=["scope"])
    asked = [(0, "karentx lver"), (1, "kara"), (2, "mu loverx"), (3, "karentivr"), (4, "zzzzzz"), (5, "")]
    words = lexical.query_words(spark.createDataFrame(asked, "query_id long, text string"), "query_id", "text")
    index = text_index.TextIndex(spark, [f"{tmp_path}/whole"])
    got = {tuple(r) for r in lexical.indexed_fuzzy(index, words, distance).collect()}
    want = set()
    for q, text in asked:
        for e, own, _ in entries[:120]:
            least = [min((edits(t, w) for w in own.split()), default=9) for t in dict.fromkeys(text.split())]
            if least and max(least) <= distance:
                want.add((q, e, round(sum(1 / (1 + x) for x in least), 6)))
    assert got == want


def test_words_within_a_distance_share_a_prefix_form():
    def forms(word, distance):
        out = {word[: text_index.PREFIX]}
        for _ in range(distance):
            out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
        return out

    draw = random.Random(13)
    for _ in range(3_000):
        a = "".join(draw.choice("ab") for _ in range(draw.randint(1, 14)))
        b = list(a)
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.choice([0, 1])] = draw.choice([[], ["a"], ["b"]])
        d = edits(a, "".join(b))
        if 0 < d <= 3:
            assert forms(a, d) & forms("".join(b), d)


def test_decision_log_counts_and_replays(spark, tmp_path):
    rows = [(i, f"r{i % 90}", "hot" if i % 3 else "cold", i % 7) for i in range(120)]
    batch = spark.createDataFrame(rows, "id long, request_id string, scope string, created_at int")
    log = DecisionLog(spark, f"{tmp_path}/log", capacity=25)
    log.write(batch, 0)
    once = sorted(map(repr, log.rows().collect())), sorted(map(repr, log.counts().collect()))
    log.write(batch, 0)  # replayed
    assert (sorted(map(repr, log.rows().collect())), sorted(map(repr, log.counts().collect()))) == once
    log.write(batch.where("id < 10"), 1)
    counts = {r["scope"]: (r["received"], r["written"], r["dropped"]) for r in log.counts().collect()}
    assert counts == {"hot": (60 + 6, 25 + 6, 35), "cold": (30 + 4, 25 + 4, 5)}
    assert log.rows().count() == 60


def test_unit_vectors_of_any_length(spark):
    draw = np.random.default_rng(1)
    made = draw.normal(size=(50, 1_500))
    rows = spark.createDataFrame([(v.tolist(),) for v in made] + [([0.0, 0.0],), ([float("nan")],), (None,), ([1.0, None],), ([],)], "v array<double>")
    got = [r[0] for r in rows.select(vectors.normalised(F.col("v"))).collect()]
    assert got[50:] == [None] * 5
    assert np.allclose(np.array(got[:50]), made / np.linalg.norm(made, axis=1, keepdims=True))


@pytest.mark.parametrize("spread, most", [(0.05, 0.25), (5.0, 1.0)])
def test_pruned_scan_equals_a_full_one(spark, spread, most):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(20, 16))
    made = centres[draw.integers(0, 20, 1_200)] + spread * draw.normal(size=(1_200, 16)) / 4
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    made[7] = made[3]  # a tie
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "rid long, v array<double>")
    queries = rows.where("rid % 10 = 3").withColumnRenamed("rid", "qid")
    held = Clusters(rows)
    got = {(r["qid"], r["rank"]): (r["rid"], r["similarity"]) for r in held.nearest(queries, 5, skip_self=True).collect()}
    want = {(r["qid"], r["rank"]): (r["rid"], r["similarity"]) for r in nearest.nearest(queries, rows, 5, skip_self=True).where("rank <= 5").collect()}
    assert got == want and len(got) == 600
    assert held.compared <= most
    held.close()
    few = Clusters(rows.limit(3))
    assert few.nearest(queries, 5).count() == 3 * 120 and Clusters(rows.limit(0)).nearest(queries, 5).count() == 0
    few.close()


def test_reasons_of_misses_and_metadata(spark, tmp_path):
    def lines(engine):
        return {r["line"] for r in engine.exposition("c").collect() if not r["line"].endswith(" 0")}

    def reasons(engine, rows):
        return {r["query_id"]: r["reason"] for r in engine.search(spark.createDataFrame(rows, QUERY), 200).collect()}

    entry = spark.createDataFrame([("red apple", "A", None, [1.0, 0.0], {"user": "u1"}), ("green pear", "B", "s", [0.0, 1.0], None)], ENTRY + ", metadata map<string,string>")
    semantic = RecallEngine(spark, f"{tmp_path}/semantic", ["exact", "semantic"], floor=0.9)
    assert lines(semantic) == set()
    semantic.set(entry, 100)
    asked = [(1, "red apple", None, None), (2, "x", None, [1.0, 0.1]), (3, "x", None, [1.0, 2.0]), (4, "x", "nobody", [1.0, 0.0]), (5, "x", None, None)]
    assert reasons(semantic, asked) == {1: None, 2: None, 3: "below_threshold", 4: "no_candidate", 5: "no_candidate"}
    assert lines(semantic) == {'c_lookups_total{result="hit",reason="hit"} 2', 'c_lookups_total{result="miss",reason="no_candidate"} 2', 'c_lookups_total{result="miss",reason="below_threshold"} 1', 'c_writes_total{outcome="ok"} 2'}
    got = {r["query_id"]: r["metadata"] for r in semantic.search(spark.createDataFrame(asked[:1] + [(9, "green pear", "s", None)], QUERY), 300).collect()}
    assert got == {1: '{"user":"u1"}', 9: "{}"}

    lexical = RecallEngine(spark, f"{tmp_path}/lexical", "bm25", exact_tier=False, min_score=1e6)
    lexical.set(entry.drop("metadata"), 100)
    assert reasons(lexical, [(1, "apple", None, None), (2, "plum", None, None)]) == {1: "below_threshold", 2: "no_candidate"}

    def extractor(texts):
        if any("broken" in t for t in texts):
            raise ValueError("no answer")
        return [["paris" if "apple" in t else "rome"] for t in texts]

    aware = RecallEngine(spark, f"{tmp_path}/aware", "entity-aware", exact_tier=False, floor=0.9, extractor=extractor)
    aware.set(spark.createDataFrame([("red apple", "A", None, [1.0, 0.0]), ("broken", "B", None, [0.0, 1.0])], ENTRY), 100)
    assert reasons(aware, [(1, "apple", None, [1.0, 0.0]), (2, "pear", None, [1.0, 0.0]), (3, "broken", None, [1.0, 0.0]), (4, "apple", "s", [1.0, 0.0])]) == {1: None, 2: "below_threshold", 3: "extractor_error", 4: "no_candidate"}
    assert {'c_writes_total{outcome="ok"} 1', 'c_writes_total{outcome="skipped_extractor_error"} 1', 'c_extractor_calls_total{outcome="error"} 2', 'c_lookups_total{result="miss",reason="extractor_error"} 1'} <= lines(aware)
    off = RecallEngine(spark, f"{tmp_path}/off", "off")
    assert [(r["hit"], r["reason"]) for r in off.search(spark.createDataFrame(asked[:1], QUERY), 0).collect()] == [(False, None)]


def test_query_records(spark):
    out = spark.createDataFrame([(" a  B ", 1), (None, None)], "t string, u int").select(text.query_record(F.col("t"), user=F.col("u")).alias("q"), text.query_record(F.col("t")).alias("p")).collect()
    assert [(r["q"]["text"], r["q"]["metadata"]["user"], r["p"]["metadata"]) for r in out] == [("a B", 1, None), ("", None, None)]
