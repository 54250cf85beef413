"""What a replay of lookups sends through the driver: no table of the cache's or the queries' size."""

from emberlake.engine import RecallEngine
from emberlake.operators import cascade
from emberlake.plans.stored import cache_counters
from emberlake.sources.entry_table import EntryTable, mirror

QUERY = "query_id long, text string, scope string, embedding array<double>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executions(spark):
    """The plans that have run so far, by number; of adaptive ones the last."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}


def filled(spark, folder):
    engine = RecallEngine(spark, folder, "exact", ttl=100, permanent_hits=3)
    engine.set(spark.createDataFrame([(t, f"to {t}", None, None) for t in "abc"], "text string, response string, scope string, embedding array<double>"), 0)
    engine.search(spark.createDataFrame([(i, t, None, None) for i, t in enumerate("aad")], QUERY), 10)
    return engine


def test_entries_are_merged_without_broadcasts(spark, tmp_path):
    engine = filled(spark, f"{tmp_path}/cache")
    assert "Broadcast" not in plan(engine.entries())
    engine.compact()
    engine.search(spark.createDataFrame([(0, "b", None, None)], QUERY), 20)
    assert "Broadcast" not in plan(engine.entries())
    assert {(r["text"], r["hits"], r["expires_at"]) for r in engine.entries().collect()} == {("a", 3, None), ("b", 2, 120), ("c", 1, 100)}


def test_answers_are_joined_to_hits_without_broadcasts(spark, tmp_path):
    held = filled(spark, f"{tmp_path}/cache").table.entries()
    asked = held.select(held["ts"].alias("query_id"), "entry_key").where("text = 'a'").unionByName(spark.createDataFrame([(7, "none")], "query_id long, entry_key string"))
    out = cascade.cascade(asked, [("exact", lambda left: cascade.exact_hits(left.hint("merge"), held))], held.select("entry_id", "response"))
    assert "Broadcast" not in plan(out)
    assert {(r["query_id"], r["hit"], r["response"]) for r in out.collect()} == {(0, True, "to a"), (7, False, None)}


def test_mirror_reads_each_batch_by_itself(spark, tmp_path, monkeypatch):
    table = filled(spark, f"{tmp_path}/cache").table
    copy = EntryTable(spark, f"{tmp_path}/mirror", 100, 3)
    with monkeypatch.context() as patched:
        patched.setattr(EntryTable, "changes", lambda *_: 1 / 0)  # all batches from a number on
        mirror(table, copy, f"{tmp_path}/state")
    rows = lambda t: sorted(map(repr, t.entries().select("entry_key", "hits", "expires_at", "entry_id").collect()))
    assert copy.batches() == table.batches() and rows(copy) == rows(table)


def test_counters_of_a_replay(spark, tmp_path):
    lines = {r["line"] for r in filled(spark, f"{tmp_path}/cache").exposition().collect()}
    assert 'cache_lookups_total{result="hit",reason="hit"} 2' in lines and 'cache_lookups_total{result="miss",reason="no_candidate"} 1' in lines


def test_no_step_of_the_counters_query_broadcasts(spark, tmp_path):
    days = [(0, 0, 1), (1, 1, 1), (2, 0, 2), (3, 6, 1), (4, 16, 2)]  # event, day and user: user 2 is back when the entry is gone
    rows = spark.createDataFrame([(i, 86_400 * day, user, "click") for i, day, user in days], "event_id long, s long, user_id long, event_type string")
    rows.selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    before = executions(spark)
    lines = {r["line"] for r in cache_counters(spark, str(tmp_path)).collect()}
    ran = [p for k, p in executions(spark).items() if k not in before]
    assert len(ran) > 10 and not [p for p in ran if "BroadcastExchange" in p]
    assert {
        'cache_lookups_total{result="hit",reason="hit"} 1', 'cache_lookups_total{result="miss",reason="no_candidate"} 4', 'cache_writes_total{outcome="ok"} 3',
    } <= lines
