"""Queries over what the engine stores: hit accounting, the change feed, kept model answers, decision logs, sliding alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.engine import RecallEngine
from emberlake.functions import text
from emberlake.operators import logs, seams
from emberlake.plans.recall import seconds
from emberlake.plans.traffic import _is_folder, _single
from emberlake.sources import entry_table
from emberlake.sources.sinks import DecisionLog
from emberlake.sources.tables import delete, read_table, shared_dir, staged
from emberlake.streaming import lifecycle as streams

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stored/{uuid.uuid4().hex}"


# Lookups of a slot of five days are one batch; an entry outlives one slot without a hit, not two.
SLOT, KEPT, PERMANENT = 432_000, 691_200, 12
LOOKUPS = f"""d AS (SELECT user_id, event_type, CAST(floor(epoch(ts) / {SLOT}) AS BIGINT) AS slot, count(*) AS k FROM events GROUP BY ALL),
o AS (SELECT *, coalesce(slot - lag(slot) OVER w > 1, true) AS fresh FROM d WINDOW w AS (PARTITION BY user_id, event_type ORDER BY slot)),
i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id, event_type ORDER BY slot) AS island FROM o),
c AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE k END) OVER (PARTITION BY user_id, event_type, island ORDER BY slot) AS cum FROM i),
p AS (SELECT *, min(CASE WHEN NOT fresh AND cum >= {PERMANENT} THEN slot END) OVER (PARTITION BY user_id, event_type) AS promo FROM c)"""


def _replayed(spark: SparkSession, d: str, folder: str) -> RecallEngine:
    """Events as lookups of an engine, slot by slot: what misses is written. The number of slots is that of the days covered."""
    engine = RecallEngine(spark, folder, "exact", ttl=KEPT, permanent_hits=PERMANENT, compact_after=4)
    rows = read_table(spark, d, "events").select(
        F.col("event_id").alias("query_id"), F.concat_ws(" ", F.col("user_id").cast("string"), "event_type").alias("text"), F.lit(None).cast("string").alias("scope"),
        F.lit(None).cast("array<double>").alias("embedding"), F.floor(seconds() / SLOT).cast("long").alias("slot"),
    )
    rows = staged(rows)
    for slot in sorted(r[0] for r in rows.select("slot").distinct().collect()):
        mine = rows.where(F.col("slot") == slot)
        found = engine.search(mine, slot * SLOT)
        missed = mine.join(found.where("not hit").select("query_id").hint("merge"), "query_id", "left_semi")
        engine.set(missed.select("text", F.lit("an answer").alias("response"), "scope", "embedding").distinct(), slot * SLOT)
    delete(spark, rows._staged)
    return engine


@query(f"""WITH {LOOKUPS}, e AS (SELECT user_id, event_type, max(promo) AS promo, max(slot) AS last_slot, arg_max(cum, slot) AS cum,
  max(CASE WHEN slot = promo THEN cum END) + coalesce(sum(k) FILTER (WHERE slot > promo), 0) AS held FROM p GROUP BY ALL)
SELECT user_id || ' ' || event_type AS text, coalesce(held, cum)::INT AS hits, CASE WHEN promo IS NULL THEN last_slot * {SLOT} + {KEPT} END AS expires_at FROM e""")
def cache_replay(spark: SparkSession, d: str) -> DataFrame:
    """Hits and expiry of every stored entry after all lookups, as the engine's change log has them."""
    folder = _folder(spark)
    engine = _replayed(spark, d, folder)
    out = staged(engine.entries().select("text", "hits", "expires_at"))
    delete(spark, folder)
    return out


@query(f"""WITH {LOOKUPS} SELECT CASE WHEN fresh AND (promo IS NULL OR slot <= promo) THEN 'put' ELSE 'touch' END AS kind, slot * {SLOT} AS "at", count(*) AS n, sum(k)::BIGINT AS lookups FROM p GROUP BY ALL""")
def cache_feed(spark: SparkSession, d: str) -> DataFrame:
    """What a mirror that follows the change feed as a stream has taken over, by kind and time of the change."""
    folder = _folder(spark)
    engine = _replayed(spark, d, f"{folder}/cache")
    mirrored = entry_table.EntryTable(spark, f"{folder}/mirror", KEPT, PERMANENT)
    entry_table.mirror(engine.table, mirrored, f"{folder}/state")
    changes = mirrored.changes().select("kind", "at", "count", "entry_key")
    asked = read_table(spark, d, "events").select(
        text.entry_key(F.lit(None).cast("string"), F.concat_ws(" ", F.col("user_id").cast("string"), "event_type")).alias("entry_key"), (F.floor(seconds() / SLOT) * SLOT).cast("long").alias("at")
    )
    k = asked.groupBy("entry_key", "at").agg(F.count("*").alias("k"))
    rows = changes.join(k.hint("merge"), ["entry_key", "at"]).where((F.col("kind") == "put") | (F.col("count") == F.col("k")))
    out = staged(rows.groupBy("kind", "at").agg(F.count("*").alias("n"), F.sum("k").alias("lookups")))
    delete(spark, folder)
    return out


@query(f"""WITH {LOOKUPS}, k AS (SELECT *, fresh AND (promo IS NULL OR slot <= promo) AS put FROM p),
t AS (SELECT coalesce(sum(k) FILTER (WHERE NOT put), 0)::BIGINT AS hits, coalesce(sum(k) FILTER (WHERE put), 0)::BIGINT AS misses, count(*) FILTER (WHERE put) AS writes FROM k)
SELECT unnest(['cache_lookups_total{{result="hit",reason="hit"}} ' || hits, 'cache_lookups_total{{result="miss",reason="no_candidate"}} ' || misses, 'cache_lookups_total{{result="miss",reason="below_threshold"}} 0',
'cache_lookups_total{{result="miss",reason="extractor_error"}} 0', 'cache_writes_total{{outcome="ok"}} ' || writes]) AS line FROM t""")
def cache_counters(spark: SparkSession, d: str) -> DataFrame:
    """What the engine has counted after all lookups, as exposition lines."""
    folder = _folder(spark)
    engine = _replayed(spark, d, folder)
    delete(spark, folder)
    return engine.exposition()


@query("SELECT event_id, lower(trim(event_type)) AS text, user_id, event_type FROM events")
def query_records(spark: SparkSession, d: str) -> DataFrame:
    """Events as queries that carry their user and type along."""
    record = text.query_record(F.col("event_type"), lambda c: F.lower(text.clean(c)), user_id=F.col("user_id"), event_type=F.col("event_type"))
    return read_table(spark, d, "events").select("event_id", record.alias("q")).select("event_id", "q.text", "q.metadata.user_id", "q.metadata.event_type")


# Model answers


def capitals(texts) -> list:
    """A stand-in for an extraction model: the distinct capitalised words; fails on texts of over 20,000 characters."""
    import re

    if any(len(t) > 20_000 for t in texts):
        raise ValueError("too long")
    return [sorted(set(re.findall("[A-Z][a-z]+", t))) for t in texts]


@query("""WITH t AS (SELECT text, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS n_entities, length(text) <= 20000 AS fits, min(doc_id % 2) AS part FROM documents WHERE text IS NOT NULL GROUP BY text),
c AS (SELECT count(*) FILTER (WHERE fits AND part = 0) AS known, count(*) FILTER (WHERE fits AND part = 1) AS fresh, count(*) FILTER (WHERE NOT fits) AS failed FROM t)
SELECT d.doc_id, CASE WHEN t.fits THEN t.n_entities::INT ELSE -1 END AS n_entities, known AS memo_hits, fresh AS extracted, failed AS extractor_errors, 0 AS extracted_again FROM documents d LEFT JOIN t ON d.text = t.text, c""")
def kept_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Documents of even ids are extracted, then all (what is known is not sent again), then all once more; with the counts of the second and third run."""
    folder = _folder(spark)
    rows = read_table(spark, d, "documents").select("doc_id", "text")
    memo = seams.Memo(spark, folder, T.ArrayType(T.StringType()), 3_600)
    memo.apply(rows.where("doc_id % 2 = 0"), "text", "entities", capitals, 0)
    out, second = memo.apply(rows, "text", "entities", capitals, 10)
    out = staged(out.select("doc_id", F.coalesce(F.size("entities"), F.lit(-1)).alias("n_entities")))
    third = memo.apply(rows, "text", "entities", capitals, 20)[1]
    delete(spark, folder)
    counts = [F.lit(n).cast("long").alias(name) for name, n in second.items()]
    return out.select("doc_id", "n_entities", *counts, F.lit(third["extracted"]).cast("int").alias("extracted_again"))


# Logs and alerts

CAPACITY = 40


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path) if _is_folder(spark, path) else _single(spark, path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"SELECT event_type || (user_id % 4) AS scope, count(*) AS received, least(count(*), {CAPACITY}) AS written, greatest(count(*) - {CAPACITY}, 0) AS dropped, count(*) FILTER (WHERE r <= {CAPACITY}) AS logged, min(event_id) AS first_id, max(event_id) FILTER (WHERE r <= {CAPACITY}) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) AS r FROM events) GROUP BY 1")
def decision_log(spark: SparkSession, d: str) -> DataFrame:
    """A stream of decisions through bounded queues into the log: what each scope's log and counters hold."""
    folder = _folder(spark)
    stream = _event_stream(spark, d).select(
        F.col("event_id").alias("id"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        F.concat("event_type", (F.col("user_id") % 4).cast("string")).alias("scope"), F.col("ts").alias("created_at"),
    )
    log = DecisionLog(spark, f"{folder}/log", capacity=CAPACITY)
    log.run(stream, f"{folder}/state")
    held = log.rows().groupBy("scope").agg(F.count("*").alias("logged"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    out = staged(log.counts().join(held, "scope", "left"))
    delete(spark, folder)
    return out


HOPS = "h AS (SELECT ts, event_type, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS window_start FROM events)"
HOPPED = "SELECT window_start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS rate, count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.05 AS alert FROM h GROUP BY 1"


@query(f"WITH {HOPS} {HOPPED}")
def sliding_alerts(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = logs.sliding_rates(rows, "ts", F.col("event_type") == "error", "10 minutes", "5 minutes", 0.05)
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"WITH {HOPS}, w AS ({HOPPED}) SELECT * FROM w WHERE window_start + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE")
def stream_sliding_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The same windows of a stream, as far as the watermark has passed them."""
    folder = _folder(spark)
    stream = streams.sliding_rates(_event_stream(spark, d), "ts", F.col("event_type") == "error", "10 minutes", "5 minutes", 0.05, "30 minutes")
    streams.run_to_end(stream, f"{folder}/out", f"{folder}/state")
    out = staged(spark.read.schema(stream.schema).parquet(f"{folder}/out"))
    delete(spark, folder)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH w AS (SELECT event_type, CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS start_s, count(*) AS n, count(*) FILTER (WHERE value < 10) AS bad FROM events GROUP BY ALL),
m AS (SELECT *, avg(bad) OVER (PARTITION BY event_type ORDER BY start_s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS mean FROM w)
SELECT event_type, start_s, n, bad, round(mean, 6) AS moving_mean, bad > 2 * mean AS alert FROM m""")
def moving_mean_alerts(spark: SparkSession, d: str) -> DataFrame:
    return logs.above_moving_mean(read_table(spark, d, "events"), "ts", F.col("value") < 10, 600, 86_400, 2.0, ["event_type"])
