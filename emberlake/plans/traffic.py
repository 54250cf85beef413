"""Queries over traffic: chat requests, logs, metrics, registry, and streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.operators import chat, logs, registry
from emberlake.plans.guarding import body_sql, sse_sql
from emberlake.plans.recall import PROMOTE, REPLAY, TTL, seconds
from emberlake.sources import sinks
from emberlake.sources.tables import read_table, shared_dir
from emberlake.streaming import lifecycle as streams

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT conv_id, nullif(trim(arg_max(text, turn) FILTER (WHERE role = 'user')), '') AS cache_text FROM conversations GROUP BY conv_id")
def cache_text(spark: SparkSession, d: str) -> DataFrame:
    return chat.last_user_text(read_table(spark, d, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "cache_text")


def _stream_lines(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as server-sent event lines of their words."""
    rows = read_table(spark, d, "conversations").where("role = 'assistant'")
    replies = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), F.col("text").alias("reply"), F.lit("m").alias("model"))
    return chat.completion_chunks(replies, "stream_id", "reply", "model", 40)


@query("SELECT conv_id * 1000 + turn AS stream_id, sha256(text) AS content_sha, 'stop' AS finish_reason, true AS done FROM conversations WHERE role = 'assistant'")
def sse_accumulate(spark: SparkSession, d: str) -> DataFrame:
    out = chat.accumulate_stream(_stream_lines(spark, d))
    return out.select("stream_id", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha"), "finish_reason", "done")


@query("SELECT conv_id * 1000 + turn AS stream_id, greatest(ceil(length(text) / 40.0), 1)::BIGINT + 2 AS n_lines FROM conversations WHERE role = 'assistant'")
def sse_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _stream_lines(spark, d).groupBy("stream_id").agg(F.count("*").alias("n_lines"))


def _cached(spark: SparkSession, d: str) -> tuple[DataFrame, tuple]:
    """Assistant turns as replies that a cache answers, and the arguments of their body or stream."""
    rows = read_table(spark, d, "conversations").where("role = 'assistant'").withColumn("stream_id", F.col("conv_id") * 1000 + F.col("turn"))
    return rows, (F.concat(F.lit("chatcmpl-cache-"), F.col("stream_id").cast("string")), F.col("stream_id"), F.lit("m"), F.col("text"), "stop")


_REPLIES = "WITH r AS (SELECT conv_id * 1000 + turn AS stream_id, conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant')"
_ID = "'chatcmpl-cache-' || stream_id"
_HIT = "CAST(json_object('hit', true, 'similarity', CASE WHEN turn % 2 = 0 THEN (conv_id % 100) / 100.0::DOUBLE END) AS VARCHAR)"


@query(f"""{_REPLIES} SELECT stream_id, {sse_sql(_ID, "stream_id", "text", "'stop'", "conv_id % 2 = 0")} AS stream FROM r""")
def cached_streams(spark: SparkSession, d: str) -> DataFrame:
    rows, given = _cached(spark, d)
    return rows.select("stream_id", F.array_join(chat.reply_stream(*given, usage=F.col("conv_id") % 2 == 0), "").alias("stream"))


@query(f"""{_REPLIES} SELECT stream_id, {body_sql(_ID, "stream_id", "text", "stop", "semantic_cache", _HIT)} AS body FROM r""")
def cached_bodies(spark: SparkSession, d: str) -> DataFrame:
    rows, given = _cached(spark, d)
    similarity = F.when(F.col("turn") % 2 == 0, (F.col("conv_id") % 100) / F.lit(100.0))
    return rows.select("stream_id", chat.reply_body(*given, note=chat.hit_note(similarity)).alias("body"))


@query(f"{_REPLIES} SELECT stream_id, sha256(text) AS content_sha, 'stop' AS finish_reason, CASE WHEN conv_id % 2 = 0 THEN 0 END::BIGINT AS total_tokens, true AS done, trim(text) <> '' AS storable FROM r")
def cached_stream_accounts(spark: SparkSession, d: str) -> DataFrame:
    """The streams of ``cached_streams`` read back as a proxy reads them, and whether each may be stored."""
    rows, given = _cached(spark, d)
    lines = rows.select("stream_id", F.posexplode(chat.reply_stream(*given, usage=F.col("conv_id") % 2 == 0)).alias("seq", "line"))
    out = chat.accumulate_stream(lines)
    return out.select("stream_id", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha"), "finish_reason", "total_tokens", "done", chat.may_store(F.col("finish_reason"), F.col("content"), F.lit(False)).alias("storable"))


@query("""WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, turn % 4 AS kind FROM conversations),
x AS (SELECT conv_id, turn, kind, t, CASE kind WHEN 0 THEN t WHEN 1 THEN CASE WHEN t = '' THEN role ELSE t || ' ' || role END ELSE '' END AS cached, CASE kind WHEN 0 THEN t WHEN 1 THEN CASE WHEN t = '' THEN role ELSE t || ' ' || role END WHEN 2 THEN t ELSE '' END AS guarded FROM m)
SELECT conv_id, turn, sha256(cached) AS cache_sha, sha256(guarded) AS guard_sha, kind = 3 OR (kind = 2 AND trim(t) = '') AS unreadable FROM x""")
def message_parts(spark: SparkSession, d: str) -> DataFrame:
    """Messages as plain text, typed parts, parts of an unknown type, and an image alone: what a cache and a guard read of each."""
    text, kind = F.coalesce("text", F.lit("")), F.col("turn") % 4
    part = lambda type_, t: F.struct(F.lit(type_).alias("type"), t.alias("text"))
    none = F.lit(None).cast("string")
    parts = F.when(kind == 1, F.array(part("text", text), part("image_url", none), part("text", F.col("role")))).when(kind == 2, F.array(part("input_text", text))).otherwise(F.array(part("image_url", none)))
    rows = read_table(spark, d, "conversations").withColumn("content", F.when(kind == 0, text).otherwise(F.to_json(parts)))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    content = F.col("content")
    return rows.select("conv_id", "turn", sha(chat.content_text(content)).alias("cache_sha"), sha(chat.guard_text(content)).alias("guard_sha"), chat.unreadable(content).alias("unreadable"))


@query("SELECT event_id, value >= 2 AND event_type <> 'error' AND event_id % 5 <> 0 AS cacheable, event_type = 'click' AND event_id % 7 <> 0 AS storable FROM events")
def cache_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events")
    bypass = F.when(F.col("event_type") == "error", F.array(F.lit("tools"))).otherwise(F.array(F.lit("user")))
    finish = F.when(F.col("event_type") == "click", "stop").otherwise("length")
    return rows.select(
        "event_id",
        chat.cacheable(F.col("value") >= 2, F.when(F.col("event_id") % 5 == 0, 2), bypass).alias("cacheable"),
        chat.may_store(finish, F.lit("text"), F.col("event_id") % 7 == 0).alias("storable"),
    )


@query("SELECT conv_id, turn, turn_no FROM (SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn DESC) AS turn_no FROM conversations) WHERE turn_no <= 50")
def message_log_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    ranked = logs.newest(rows.withColumnRenamed("turn", "message_turn"), "role", "id", 50)
    return ranked.select("conv_id", F.col("message_turn").alias("turn"), F.col("turn").cast("long").alias("turn_no"))


@query("SELECT o_orderkey, count(*) AS decisions, round(max(l_discount), 6) AS worst FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def decision_message_join(spark: SparkSession, d: str) -> DataFrame:
    messages, decisions = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    per_message = decisions.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("decisions"), F.round(F.max("l_discount"), 6).alias("worst"))
    return messages.join(per_message, "o_orderkey").select("o_orderkey", "decisions", "worst")


@query("SELECT user_id, event_type, count(*) AS n, round(avg((event_type <> 'error')::INT), 6) AS hit_rate FROM events GROUP BY ROLLUP (user_id, event_type)")
def hit_rate_by_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").withColumn("ok", (F.col("event_type") != "error").cast("int"))
    return rows.rollup("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("hit_rate"))


BOUNDS = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0]


@query(
    "WITH b AS (SELECT unnest([1.0, 2.5, 5.0, 10.0, 25.0, 50.0])::DOUBLE AS le, unnest(['1', '2.5', '5', '10', '25', '50']) AS name) "
    "SELECT event_type, name AS le, count(*) FILTER (WHERE value <= b.le) AS count FROM events, b GROUP BY event_type, name "
    "UNION ALL SELECT event_type, '+Inf', count(value) FROM events GROUP BY event_type"
)
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return logs.histogram(read_table(spark, d, "events"), "value", BOUNDS, ["event_type"])


@query("""SELECT 'lookups_total{event_type="' || event_type || '",user_id="' || user_id || '"} ' || count(*) AS line FROM events GROUP BY event_type, user_id""")
def metric_exposition(spark: SparkSession, d: str) -> DataFrame:
    labels = ["event_type", "user_id"]
    return logs.exposition(logs.counters(read_table(spark, d, "events"), labels), "lookups_total", labels)


@query("SELECT window_start, n, bad, round(bad / n, 6) AS rate, bad / n > 0.05 AS alert FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1)")
def alert_rates(spark: SparkSession, d: str) -> DataFrame:
    return logs.alert_rates(read_table(spark, d, "events"), "ts", F.col("event_type") == "error", "10 minutes", 0.05).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1) SELECT hour, bad, round(avg(bad) OVER (PARTITION BY hour::DATE), 6) AS daily_mean, bad > 2 * avg(bad) OVER (PARTITION BY hour::DATE) AS alert FROM h")
def alert_above_mean(spark: SparkSession, d: str) -> DataFrame:
    return logs.above_daily_mean(read_table(spark, d, "events"), "ts", F.col("event_type") == "error").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS last_status, count(*) AS n FROM orders GROUP BY o_custkey")
def key_set_members(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders")
    last = sinks.latest(rows, ["o_custkey"], [F.desc("o_orderkey")]).select("o_custkey", F.col("o_orderstatus").alias("last_status"))
    return last.join(rows.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey")


KEY_ACTION = "CASE WHEN o_orderkey % 7 = 0 THEN 'revoke' WHEN o_orderkey % 3 = 0 THEN 'rotate' ELSE 'issue' END"


@query(f"""WITH k AS (SELECT o_custkey, arg_max({KEY_ACTION}, (o_orderdate, o_orderkey)) AS last_action, max(o_orderdate) AS moment, count(*) AS n_events FROM orders GROUP BY o_custkey)
SELECT o_custkey, last_action, n_events, CASE last_action WHEN 'revoke' THEN moment WHEN 'rotate' THEN moment + INTERVAL 1 HOUR END AS expires_at FROM k""")
def key_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders").withColumn("action", F.expr(KEY_ACTION))
    out = registry.key_states(rows, "o_custkey", "o_orderdate", "o_orderkey", "action", 3600)
    return out.withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


@query(f"""WITH k AS (SELECT o_custkey, arg_max({KEY_ACTION}, (o_orderdate, o_orderkey)) AS last_action, max(o_orderdate) AS moment FROM orders GROUP BY o_custkey)
SELECT o_custkey, last_action FROM k WHERE last_action = 'issue' OR (CASE last_action WHEN 'revoke' THEN moment ELSE moment + INTERVAL 1 HOUR END) > TIMESTAMP '1998-01-01'""")
def live_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that still resolve at a stated time."""
    rows = read_table(spark, d, "orders").withColumn("action", F.expr(KEY_ACTION))
    states = registry.key_states(rows, "o_custkey", "o_orderdate", "o_orderkey", "action", 3600)
    return registry.resolvable(states, F.expr("TIMESTAMP '1998-01-01'")).select("o_custkey", "last_action")


@query("SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER w AS replaced_by, lead(o_orderdate) OVER w + INTERVAL 1 HOUR AS expires_at FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def key_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a customer's new key: the one before resolves for one more hour."""
    out = registry.rotations(read_table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderdate", 3600)
    return out.withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING max(o_orderdate) < TIMESTAMP '1998-01-01' - INTERVAL 90 DAY")
def idle_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order in the 90 days before a stated time."""
    used = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_used"), F.count("*").alias("n"))
    return registry.idle(used, "last_used", F.expr("TIMESTAMP '1998-01-01'"), 90).select("o_custkey", "n")


@query("SELECT owner, key, row_number() OVER (PARTITION BY owner ORDER BY o_orderdate, key) AS place FROM (SELECT DISTINCT l_suppkey AS owner, l_orderkey AS key FROM lineitem) JOIN orders ON key = o_orderkey")
def key_set_places(spark: SparkSession, d: str) -> DataFrame:
    """The orders of each supplier's key set, once each, with their place."""
    sets = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_orderkey").alias("key"))
    rows = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderdate")
    return registry.members(sets, rows, "key", ["o_orderdate", "key"]).select("owner", "key", F.col("place").cast("long").alias("place"))


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), n_name) AS model FROM customer JOIN nation ON c_nationkey = n_nationkey")
def config_resolution(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("own"))
    defaults = read_table(spark, d, "nation").select("n_nationkey", "n_name")
    return registry.resolve_config(rows, defaults, ["n_nationkey"], {"model": ["own", "n_name"]}).select("c_custkey", "model")


@query("SELECT event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) <= 5 AS accepted FROM events")
def decision_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return sinks.bounded_queue(rows, ["hour"], [F.col("ts"), F.col("event_id")], 5).select("event_id", "accepted")


@query()
def key_touches(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").select("event_id", "user_id", "ts")
    return registry.touch_once(rows, ["user_id"], seconds(), "event_id", 3600.0).select("event_id", "touched")


# Streaming twins: the same rows through state, equal to the batch result


def _shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    path = f"{d}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path) if _is_folder(spark, path) else _single(spark, path)
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return rows.select(key.alias("key"), seconds().alias("ts"), F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("failed"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    files = spark.read.parquet(path).inputFiles()
    return not (len(files) == 1 and files[0].rstrip("/").endswith(path.rsplit("/", 1)[-1]))


def _single(spark: SparkSession, path: str) -> DataFrame:
    """A stream over one Parquet file: its folder, restricted to its name."""
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder)


def _ran(spark: SparkSession, stream: DataFrame, machine) -> DataFrame:
    at = _shared(spark)
    return streams.KeyedStream(spark, f"{at}/out", machine).run(stream, f"{at}/state")


@query(REPLAY + " SELECT event_id, turn > 1 OR coalesce(n > promo, false) AS hit FROM p")
def stream_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return _ran(spark, _events(spark, d, "user_id", "event_type"), streams.Hits(TTL, PROMOTE)).select(F.col("id").alias("event_id"), F.col("result").alias("hit"))


@query()
def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return _ran(spark, _events(spark, d, "event_type"), streams.Limit(10, 3600.0)).select(F.col("id").alias("event_id"), F.col("result").alias("allowed"))


@query()
def stream_breaker(spark: SparkSession, d: str) -> DataFrame:
    return _ran(spark, _events(spark, d, "user_id"), streams.Breaker(86_400.0, 2, 7_200.0)).select(F.col("id").alias("event_id"), F.col("result").alias("refused"))
