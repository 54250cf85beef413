"""Retrieval, guard, lifecycle, chat, log, registry and policy operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from emberlake.operators import cascade, chat, guard, lexical, lifecycle, logs, nearest, registry
from emberlake.sources import sinks
from emberlake.sources.policy import GuardParams, PolicyError, guard_params, index_key, params_hash, parse_policy, policy_tables
from emberlake.sources.tables import migrate
from emberlake.streaming import lifecycle as streams

# retrieval


def index_of(spark, *texts):
    return lexical.lexical_index(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")


def words_of(spark, *texts):
    return lexical.query_words(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")


def test_lexical_needs_all_tokens(spark):
    index = index_of(spark, "red apple pie", "red apple", "green pear", "")
    asked = words_of(spark, "Red apple", "red pear", "unknown", "?", "pear")
    got = {(r["query_id"], r["entry_id"]) for r in lexical.lexical_matches(index, asked).collect()}
    assert got == {(0, 0), (0, 1), (4, 2)}
    best = lexical.best_match(lexical.lexical_matches(index, asked)).orderBy("query_id").collect()
    assert [(r["query_id"], r["entry_id"]) for r in best] == [(0, 1), (4, 2)]
    assert lexical.best_match(lexical.lexical_matches(index, asked), 100.0).count() == 0


def test_scorers(spark):
    index, asked = index_of(spark, "a b a", "a c"), words_of(spark, "a")
    scores = {s: [r["score"] for r in lexical.lexical_matches(index, asked, s).orderBy("entry_id").collect()] for s in lexical.SCORERS}
    assert scores["DISMAX"] == [2.0, 1.0] and scores["DOCSCORE"] == [1.0, 1.0]
    assert scores["BM25"] == scores["BM25STD"]
    with pytest.raises(ValueError):
        lexical.lexical_matches(index, asked, "BM26")


@pytest.mark.parametrize("distance, want", [(1, {(0, 0)}), (2, {(0, 0), (1, 0)})])
def test_fuzzy(spark, distance, want):
    index = index_of(spark, "kitten sat", "dog")
    got = lexical.fuzzy_matches(index, words_of(spark, "kiten sat", "kitn sat", "horse"), distance)
    assert {(r["query_id"], r["entry_id"]) for r in got.collect()} == want
    with pytest.raises(ValueError):
        lexical.fuzzy_matches(index, words_of(spark, "a"), 4)


def test_fuzzy_equals_brute_force(spark):
    """Whole words of any script: edit distance in characters, rarest token first."""
    draw = random.Random(12)
    known = ["größe", "grösse", "café", "cafe", "naïve", "niño", "nino", "日本", "日本語", "tree", "trees", "free", "x"]
    texts = [" ".join(draw.choice(known) for _ in range(draw.randrange(0, 7))) for _ in range(40)]
    asked = [" ".join(draw.choice([*known, "cafés", "trée", "groesse"]) for _ in range(draw.randrange(1, 4))) for _ in range(30)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = set()
    for q, question in enumerate(asked):
        for e, text in enumerate(texts):
            least = [min((edits(t, w) for w in text.split()), default=9) for t in set(question.split())]
            if max(least) <= 1:
                want.add((q, e, round(sum(1 / (1 + n) for n in least), 6)))
    got = lexical.fuzzy_matches(index_of(spark, *texts), words_of(spark, *asked))
    assert {(r["query_id"], r["entry_id"], r["score"]) for r in got.collect()} == want


def test_nearest_blocks_agree(spark, monkeypatch):
    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)], i % 2) for i in range(60)] + [(100, [1.0] + [0.0] * 5, 0), (101, [1.0] + [0.0] * 5, 0)]
    frame = spark.createDataFrame(rows, "id long, v array<double>, s int")
    run = lambda **k: sorted(map(tuple, nearest.nearest(frame.withColumnRenamed("id", "qid"), frame.withColumnRenamed("id", "rid"), 3, **k).select("qid", "rid", "similarity", "rank").collect()))
    whole = run(skip_self=True, on=["s"])
    held = run(skip_self=True)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 7)
    monkeypatch.setattr(nearest, "BROADCAST_BYTES", 0)
    assert run(skip_self=True) == held
    assert run(skip_self=True, on=["s"]) == whole
    brute = []
    for q, a, s in rows:
        sims = sorted(((-round(sum(x * y for x, y in zip(a, b)), 9), r) for r, b, t in rows if r != q and t == s))[:3]
        brute += [(q, r, -d, k + 1) for k, (d, r) in enumerate(sims)]
    assert [(q, r, k) for q, r, _, k in whole] == [(q, r, k) for q, r, _, k in sorted(brute)]
    assert all(s >= 1.0 for _, _, s, _ in run(floor=1.0))


def test_modes():
    assert cascade.resolve_modes("off") == [] and cascade.resolve_modes("semantic", True) == ["exact", "semantic"]
    assert cascade.resolve_modes(["bm25", "exact"], True) == ["bm25", "exact"]
    for bad in ([], ["off"], "nope", ["exact", "nope"]):
        with pytest.raises(ValueError):
            cascade.resolve_modes(bad)


def test_cascade_plan_grows_by_a_scan_a_tier(spark):
    queries = spark.range(4).withColumnRenamed("id", "query_id")
    tier = lambda left: left.where("query_id = 1").select("query_id", F.lit(7).alias("entry_id"), F.lit(0.5).alias("similarity"))
    scans = []
    for n in (1, 3, 5):
        plan = cascade.cascade(queries, [(f"t{i}", tier) for i in range(n)])._jdf.queryExecution().optimizedPlan().collectLeaves().size()
        scans.append(plan)
    assert scans == [2, 4, 6]


def test_cascade_first_hit_wins(spark):
    queries = spark.range(4).withColumnRenamed("id", "query_id")
    seen = []

    def tier(*ids):
        def run(left):
            seen.append({r["query_id"] for r in left.collect()})
            return left.where(F.col("query_id").isin(*ids)).select("query_id", F.lit(7).alias("entry_id"), F.lit(None).cast("double").alias("similarity"))

        return run

    out = {r["query_id"]: r["method"] for r in cascade.cascade(queries, [("a", tier(0, 1)), ("b", tier(1, 2))]).collect()}
    assert out == {0: "a", 1: "a", 2: "b", 3: None} and seen == [{0, 1, 2, 3}, {2, 3}]


# guard


def test_vote(spark):
    rows = [(1, 1, 0.9, "allowed", "x"), (1, 2, 0.6, "disallowed", "y"), (1, 3, 0.59, "disallowed", "z"), (2, 1, 0.1, "disallowed", "y"), (3, 1, -0.5, "disallowed", "y")]
    near = spark.createDataFrame(rows, "qid long, rank int, similarity double, label string, category string")
    got = {r["qid"]: r for r in guard.vote(near, 0.6).collect()}
    assert got[1]["score"] == pytest.approx(0.4) and got[1]["best_category"] == "y" and got[1]["n_scored"] == 2 and got[1]["top"] == [1, 2]
    assert got[2]["score"] == 0.0 and got[2]["best_category"] is None and got[2]["top"] == [1]
    assert {r["qid"]: r for r in guard.vote(near, -1.0).collect()}[3]["score"] == 0.0


@pytest.mark.parametrize(
    "mode, score, judge, soft, want",
    [
        ("embedding-only", 0.85, None, None, "block"),
        ("embedding-only", 0.4, None, None, "allow"),
        ("embedding-only", 0.5, 0.9, None, "flag"),
        ("embedding-only", 0.9, None, "flag", "flag"),
        ("cascade", 0.9, None, None, "block"),
        ("cascade", 0.5, None, None, "error"),
        ("cascade", 0.5, 0.6, None, "block"),
        ("cascade", 0.5, 0.4, "flag", "allow"),
        ("judge-only", 0.99, 0.5, None, "flag"),
        ("judge-only", 0.99, None, None, "error"),
        ("max", 0.9, 0.1, None, "block"),
        ("max", 0.1, 0.2, None, "allow"),
    ],
)
def test_decide(spark, mode, score, judge, soft, want):
    row = spark.createDataFrame([(score, judge, "c", soft)], "score double, judge_score double, best_category string, category_action string")
    got = guard.decide(row, mode, 0.4, 0.85).first()
    assert got["action"] == want
    assert (got["category"] is None) == (want == "allow")


def test_windows(spark):
    rows = [(1, 0, "a" * 10), (2, 0, "b" * 11), (3, 0, "c" * 31), (4, 0, "d"), (4, 1, "d"), (4, 2, "d"), (5, 0, "e" * 25), (5, 1, "e" * 25)]
    out = guard.windows(spark.createDataFrame(rows, "request_id long, position int, text string"), 10, 2)
    pieces = {}
    for r in out.orderBy("request_id", "position", "window").collect():
        pieces.setdefault(r["request_id"], []).append(None if r["refused"] else len(r["piece"]))
    assert pieces == {1: [10], 2: [10, 4], 3: [None], 4: [None], 5: [None]}


def test_worst_window_takes_the_first_of_ties(spark):
    rows = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.5), (1, 2, 0.5)], "request_id long, position int, score double")
    assert guard.worst_window(rows).first()["position"] == 1


def test_guard_chain(spark):
    vectors = {"bad": [1.0, 0.0], "good": [0.0, 1.0], "between": [0.6, 0.8]}
    kinds = [(0, [1.0, 0.0], "disallowed", "insult", "you fool", "block", "rude words"), (1, [0.0, 1.0], "allowed", "insult", "hello", "block", None)]
    exemplars = spark.createDataFrame(kinds, "rid long, v array<double>, label string, category string, text string, action string, description string")
    rows = [
        (1, 0, "user", "bad"), (1, 1, "user", "good"), (2, 0, "user", "good"), (3, 0, "user", "between"), (3, 1, "assistant", "bad"),
        (4, 0, "user", '[{"type": "image", "text": ""}]'), (4, 1, "user", "bad"), (5, 0, "assistant", "bad"), (6, 0, "user", "x" * 200),
        (7, 0, "user", "unknown"), (7, 1, "user", "bad"), (8, 0, "user", None), (9, 0, "user", "between"), (9, 1, "user", "between"),
    ]
    messages = spark.createDataFrame(rows, "request_id long, turn int, role string, content string")

    def embed(pieces):
        known = F.create_map(*[x for k, v in vectors.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        return pieces.withColumn("vector", known[F.col("piece")])

    def outcomes(mode, judge=None):
        got = guard.check_requests(messages, exemplars, embed, mode, floor=0.1, allow=0.4, block=0.85, top_k=2, max_chars=10, max_segments=3, judge=judge)
        return {r["request_id"]: (r["action"], r["reason"], r["judge_invoked"]) for r in got.collect()}

    broken = {4: ("error", "unguardable_content", False), 6: ("error", "input_too_large", False), 7: ("error", "embed_unreachable", False)}
    calm = {2: ("allow", None, False), 5: ("allow", None, False), 8: ("allow", None, False)}
    plain = outcomes("embedding-only")
    assert plain == broken | calm | {1: ("block", None, False), 3: ("flag", None, False), 9: ("flag", None, False)}

    def judge(prompts):  # runs on the workers
        assert all("rude words" in p and "between" in p for p in prompts)
        return ['{"confidence": 0.9}'] * len(prompts)

    assert outcomes("cascade", judge) == plain | {3: ("block", None, True), 9: ("block", None, True)}
    unread = ("error", "judge_unparseable", False)
    assert outcomes("cascade", lambda prompts: ["no idea"] * len(prompts)) == plain | {3: unread, 9: unread}
    silent = ("error", "judge_unreachable", False)
    assert outcomes("cascade") == plain | {3: silent, 9: silent}


def test_kept_votes_and_every_reason(spark, tmp_path):
    kinds = [(0, [1.0, 0.0], "disallowed", "insult", "you fool", "block", None), (1, [0.0, 1.0], "allowed", "insult", "hello", "block", None)]
    exemplars = spark.createDataFrame(kinds, "rid long, v array<double>, label string, category string, text string, action string, description string")
    rows = [(1, 0, "user", "bad"), (2, 0, "user", "good"), (3, 0, "user", "short"), (4, 0, "user", "nan"), (5, 0, "user", "none"), (5, 1, "user", "nan"), (6, 0, "user", "x" * 200), (7, 0, "user", '[{"type": "image", "text": ""}]')]
    messages = spark.createDataFrame(rows, "request_id long, turn int, role string, content string")
    known = {"bad": [1.0, 0.0], "good": [0.0, 1.0], "short": [1.0], "nan": [float("nan"), 0.0]}
    seen = spark.sparkContext.accumulator(0)

    def embed(pieces):
        return pieces.mapInPandas(lambda frames: (f.assign(vector=[(seen.add(1), known.get(t))[1] for t in f["piece"]]) for f in frames), "piece string, qid long, vector array<double>")

    def outcomes(kept=None, some=exemplars):
        got = guard.check_requests(messages, some, embed, floor=0.1, max_chars=10, max_segments=3, kept=kept)
        return {r["request_id"]: (r["action"], r["reason"]) for r in got.collect()}

    plain = outcomes()
    assert plain == {1: ("block", None), 2: ("allow", None), **{i: ("error", r) for i, r in ((3, "dim_mismatch"), (4, "embed_malformed"), (5, "embed_unreachable"), (6, "input_too_large"), (7, "unguardable_content"))}}
    assert {r for _, r in plain.values() if r} <= set(guard.REASONS)
    built = {i: ("error", "index_build_failed") for i in (1, 2, 3, 4, 5)}
    assert outcomes(some=exemplars.where("false")) == plain | built
    kept = guard.KeptVotes(spark, f"{tmp_path}/votes", "index", "params")
    assert outcomes(kept) == plain and kept.votes().count() == 2
    before = seen.value
    assert outcomes(kept) == plain
    assert seen.value - before == 3  # what was broken is tried again, what was voted on is not
    assert guard.KeptVotes(spark, f"{tmp_path}/votes", "index", "others").votes().count() == 0


GOOD = {"categories": [{"category_id": "a", "disallowed_exemplars": ["x"], "allowed_exemplars": ["y"]}]}


def test_policy(spark):
    import json

    policy = parse_policy(json.dumps(GOOD))
    assert policy.frame(spark).count() == 2
    for change in (
        {"extra": 1}, {"categories": []}, {"categories": [{"category_id": ""}]},
        {"categories": [{**GOOD["categories"][0], "severity": 1}]}, {"categories": GOOD["categories"] * 2},
        {"categories": [{**GOOD["categories"][0], "action": "flag"}]}, {"categories": [{**GOOD["categories"][0], "allowed_exemplars": []}]},
        {"categories": [{**GOOD["categories"][0], "disallowed_exemplars": [" "]}]},
    ):
        with pytest.raises(PolicyError):
            parse_policy(json.dumps({**GOOD, **change}))
    assert parse_policy(json.dumps({**GOOD, "tenant_id": "t"})).exemplars == policy.exemplars
    with pytest.raises(PolicyError):
        parse_policy("x" * 300_000)
    with pytest.raises(PolicyError):
        parse_policy("categories: &a [*a]")


def test_guard_params():
    assert guard_params({"x_note": 1}).mode == "embedding-only"
    assert guard_params({"judge_model": "m", "judge_api_key": "k"}).mode == "cascade"
    for bad in ({"fail_open": True}, {"nope": 1}, {"mode": "cascade"}, {"allow_threshold": 0.9}, {"check_roles": ("x",)}, {"policy": "p"}, {"enabled": True}, {"top_k": 0}):
        with pytest.raises(PolicyError):
            guard_params(bad)
    p = GuardParams()
    assert params_hash(p) == params_hash(GuardParams(unavailable_refusal="x")) != params_hash(GuardParams(top_k=3))
    assert index_key("p", "m", "u", "k") != index_key("p", "m", "u", "k2")


# lifecycle


def trace(seed, n=400, keys=3, step=50.0):
    draw, at, out = random.Random(seed), 0.0, []
    for i in range(n):
        at += draw.choice([0.0, draw.random() * step, draw.random() * step * 6])
        out.append((f"k{draw.randrange(keys)}", at, i, draw.random() < 0.4))
    return out


def simulate_hits(rows, ttl, threshold):
    state, out = {}, {}
    for key, at, i, _ in rows:
        deadline, hits = state.get(key, (None, 0))
        hit = key in state and (deadline is None or at < deadline)
        hits = hits + 1 if hit else 1
        forever = hit and (deadline is None or threshold > 0 and hits >= threshold)
        state[key] = (None if forever else at + ttl, hits)
        out[i] = hit
    return out


def simulate_limit(rows, limit, window):
    logs_, out = {}, {}
    for key, at, i, _ in rows:
        log = [t for t in logs_.get(key, []) if t >= at - window]
        out[i] = len(log) < limit
        logs_[key] = log + [at] * out[i]
    return out


def simulate_breaker(rows, window, threshold, cooldown):
    held, out = {}, {}
    for key, at, i, bad in rows:
        b = held.get(key)
        if b and b["until"] > at:
            out[i] = True
            continue
        out[i] = False
        if b and b["until"]:
            b["until"], b["n"] = 0.0, 0
        if not bad:
            held.pop(key, None)
            continue
        b = held.setdefault(key, {"start": 0.0, "n": 0, "until": 0.0})
        if at - b["start"] > window:
            b["start"], b["n"] = at, 0
        b["n"] += 1
        if b["n"] >= threshold and not b["until"]:
            b["until"] = at + cooldown
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, ts double, id long, failed boolean")


@pytest.mark.parametrize("seed, threshold", [(1, 5), (2, 0), (3, 1), (4, 3)])
def test_replay_equals_simulation(spark, seed, threshold):
    rows = trace(seed)
    got = lifecycle.replay_hits(frame(spark, rows), ["key"], F.col("ts"), "id", 60.0, threshold)
    assert {r["id"]: r["hit"] for r in got.collect()} == simulate_hits(rows, 60.0, threshold)


def test_rate_limit_and_breaker_equal_simulation(spark):
    rows = trace(7, 600, 4, 8.0)
    events = frame(spark, rows)
    got = lifecycle.rate_limit(events, ["key"], F.col("ts"), "id", 5, 60.0).collect()
    assert {r["id"]: r["allowed"] for r in got} == simulate_limit(rows, 5, 60.0)
    got = lifecycle.breaker(events, ["key"], F.col("ts"), "id", F.col("failed"), 60.0, 3, 30.0).collect()
    assert {r["id"]: r["refused"] for r in got} == simulate_breaker(rows, 60.0, 3, 30.0)


def test_memo_and_touch_do_not_slide(spark):
    rows = [("a", float(t), t, False) for t in (0, 30, 59, 60, 100, 119, 125)]
    got = lifecycle.fixed_memo(frame(spark, rows), ["key"], F.col("ts"), "id", 60.0).orderBy("id").collect()
    assert [r["hit"] for r in got] == [False, True, True, False, True, True, False]
    got = registry.touch_once(frame(spark, rows), ["key"], F.col("ts"), "id").orderBy("id").collect()
    assert [r["touched"] for r in got] == [True, False, False, True, False, False, True]


def test_streams_equal_batch(spark, tmp_path):
    rows = trace(11, 300, 4, 20.0)
    for part, some in enumerate((rows[:100], rows[100:220], rows[220:])):
        frame(spark, some).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p={part}")
    for name, machine, want in (
        ("hits", streams.Hits(60.0, 3), simulate_hits(rows, 60.0, 3)),
        ("limit", streams.Limit(4, 60.0), simulate_limit(rows, 4, 60.0)),
        ("breaker", streams.Breaker(60.0, 3, 30.0), simulate_breaker(rows, 60.0, 3, 30.0)),
    ):
        source = spark.readStream.schema("key string, ts double, id long, failed boolean, p int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("p")
        held = streams.KeyedStream(spark, f"{tmp_path}/{name}", machine)
        out = held.run(source, f"{tmp_path}/{name}-state")
        assert {r["id"]: r["result"] for r in out.collect()} == want
        again = spark.read.parquet(f"{tmp_path}/in/p=2")
        held.write(again, 2)  # the last batch once more
        assert {r["id"]: r["result"] for r in held.results().collect()} == want


def test_a_hot_key_is_streamed(spark, tmp_path):
    rows = spark.range(60_000).select(F.lit("hot").alias("key"), (F.col("id") * 0.5).alias("ts"), "id", F.lit(False).alias("failed"))
    held = streams.KeyedStream(spark, f"{tmp_path}/hot", streams.Limit(10, 60.0))
    held.write(rows, 0)
    assert held.results().where("result").count() == simulate_count(60_000, 0.5, 10, 60.0)
    assert held.states().select(F.size("saved")).first()[0] <= 10


def simulate_count(n, gap, limit, window):
    log, allowed = [], 0
    for i in range(n):
        log = [t for t in log if t >= i * gap - window]
        if len(log) < limit:
            log.append(i * gap)
            allowed += 1
    return allowed


def test_upsert_rebuild_purge(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k long, v string, t int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"], [F.desc("t")]).collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    mirror = spark.createDataFrame([(1, 5.0), (2, 10.9), (3, None), (4, 12.5), (5, 10.0)], "k long, e double")
    got = lifecycle.rebuild(mirror, spark.createDataFrame([(4,)], "k long"), "k", F.lit(9.0), "e").collect()
    assert sorted((r["k"], r["remaining"]) for r in got) == [(2, 1), (3, None), (5, 1)]
    kept, counts = lifecycle.purge(old.withColumnRenamed("v", "scope"), spark.createDataFrame([("a",)], "scope string"))
    assert kept.count() == 1 and counts.first()["purged"] == 1


def test_eviction_keeps_one(spark):
    rows = spark.createDataFrame([("p", i, 100) for i in range(5)], "pool string, used int, bytes int")
    kept = lambda **k: sorted(r["used"] for r in lifecycle.keep_recent(rows, ["pool"], [F.desc("used")], **k).where("kept").collect())
    assert kept(entries=2) == [3, 4] and kept(entries=9, bytes_col="bytes", max_bytes=250) == [3, 4]
    assert kept(entries=9, bytes_col="bytes", max_bytes=50) == [4]


def test_migrate(spark):
    got = migrate(spark.createDataFrame([(1, None), (2, "s")], "id long, scope string")).orderBy("id").collect()
    assert [(r["scope"], r["entity_sig"], r["domain"], r["entities"]) for r in got] == [("_default", "none", "general", "[]"), ("s", "none", "general", "[]")]


# chat, logs, registry


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "  "), (2, 0, "system", "s"), (3, 0, "user", '[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]')]
    m = spark.createDataFrame(rows, "c long, turn int, role string, text string")
    got = {r["c"]: r["cache_text"] for r in chat.last_user_text(m, "c", "turn", "role", "text").collect()}
    assert got[1] is None and got[2] is None
    texts = m.select("c", "turn", chat.content_text(F.col("text")).alias("t"), chat.unreadable(F.col("text")).alias("u")).collect()
    assert [r["t"] for r in texts if r["c"] == 3] == ["a b"] and not any(r["u"] for r in texts)
    image = spark.createDataFrame([('[{"type":"image"}]',)], "text string")
    assert image.select(chat.unreadable(F.col("text"))).first()[0]
    assert chat.segments(m, "c", "turn", "role", "text", ("user",)).count() == 2


def test_sse(spark):
    lines = [
        (1, 0, 'data: {"choices":[{"index":0,"delta":{"content":"He"}}]}'), (1, 1, 'data: {"choices":[{"index":1,"delta":{"content":"x"}}]}'),
        (1, 2, "data: broken"), (1, 3, 'data: {"choices":[{"delta":{"content":"y"},"finish_reason":"stop"}],"usage":{"total_tokens":7}}'), (1, 4, "data: [DONE]"),
        (2, 0, "event: ping"),
    ]
    got = {r["stream_id"]: r for r in chat.accumulate_stream(spark.createDataFrame(lines, "stream_id long, seq int, line string")).collect()}
    assert (got[1]["content"], got[1]["finish_reason"], got[1]["total_tokens"], got[1]["done"]) == ("Hey", "stop", 7, True)
    assert (got[2]["content"], got[2]["done"]) == ("", False)
    note = spark.range(1).select(chat.guardrail_note(F.lit("flag"), F.lit(""), F.lit(0.123456), F.lit(False), F.lit("0123456789abcdef"), F.lit(None).cast("string")).alias("n")).first()["n"]
    assert note == '{"action":"flag","score":0.1235,"judge_invoked":false,"policy":"0123456789ab"}'


def test_logs(spark):
    rows = spark.createDataFrame([("a", 0.5), ("a", 2.0), ("b", 9.0)], "k string, v double")
    got = {(r["k"], r["le"]): r["count"] for r in logs.histogram(rows, "v", [1.0, 5.0], ["k"]).collect()}
    assert got == {("a", "1"): 1, ("a", "5"): 2, ("a", "+Inf"): 2, ("b", "1"): 0, ("b", "5"): 0, ("b", "+Inf"): 1}
    assert [r["line"] for r in logs.exposition(logs.counters(rows, ["k"]), "n_total", ["k"]).orderBy("line").collect()] == ['n_total{k="a"} 2', 'n_total{k="b"} 1']
    with pytest.raises(ValueError):
        logs.newest(rows, "k", "v", 501)


def test_policies_as_rows(spark):
    rows = [(1, json.dumps(GOOD)), (2, json.dumps({**GOOD, "extra": 1})), (3, None), (4, "categories: [")]
    out = policy_tables(spark.createDataFrame(rows, "tenant int, document string"), "tenant", "document").collect()
    assert [(r["ord"], r["label"], r["problem"]) for r in out if r["id"] == 1] == [(0, "disallowed", None), (1, "allowed", None)]
    assert {r["id"]: r["problem"] is not None and r["text"] is None for r in out if r["id"] > 1} == {2: True, 3: True, 4: True}


def test_parameter_problems_are_listed_together():
    with pytest.raises(PolicyError, match="guard.top_k.*guard.mode|guard.mode.*guard.top_k"):
        guard_params({"top_k": True, "mode": "none"})
