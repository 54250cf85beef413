"""Queries over entries: normalisation, keys, retrieval tiers, cascade, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.functions import masking, text, vectors
from emberlake.operators import cascade as tiers
from emberlake.operators import clusters, lexical, lifecycle, nearest
from emberlake.sources import sinks
from emberlake.sources.tables import migrate, read_table, spread
from emberlake.sources.text_index import TextIndex, stored

SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
CLEAN = f"trim(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g'))"
STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_P = text.PUNCTUATION
LOWERED = "lower(translate(" + CLEAN + f", '{text.FOREIGN_DIGITS}', '{text.ASCII_DIGITS}'))"
SPACED = f"translate(translate({LOWERED}, '''`’‘', ''), '{_P}', '{' ' * len(_P)}')"
WORDS = f"list_filter(regexp_split_to_array({SPACED}, '{SPACE}'), lambda w: w <> '')"
CANONICAL = f"array_to_string(CASE WHEN len(list_filter({WORDS}, lambda w: w NOT IN ({STOPS}))) > 0 THEN list_filter({WORDS}, lambda w: w NOT IN ({STOPS})) ELSE {WORDS} END, ' ')"
TAG = r"CASE WHEN coalesce(source, '') = '' THEN '_default' ELSE coalesce(nullif(regexp_replace(lower(trim(source)), '[^0-9a-z_]+', '_', 'g'), ''), '_default') END"
KEY = f"'cache:' || sha256({TAG} || chr(0) || {CLEAN})"
TOKENS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda w: lower(w))"
FLOOR = 0.25

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, sha256({CLEAN}) AS clean_sha, length({CLEAN}) AS clean_chars FROM documents")
def normalize_basic(spark: SparkSession, d: str) -> DataFrame:
    clean = text.clean(F.col("text"))
    return read_table(spark, d, "documents").select("doc_id", F.sha2(clean.cast("binary"), 256).alias("clean_sha"), F.length(clean).cast("long").alias("clean_chars"))


@query(f"SELECT conv_id, turn, sha256({CANONICAL}) AS canonical_sha FROM conversations")
def normalize_aggressive(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "conversations").select("conv_id", "turn", F.sha2(text.canonical(F.col("text")).cast("binary"), 256).alias("canonical_sha"))


@query(r"SELECT doc_id, sha256(CASE WHEN len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) > 0 THEN array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+'), ' ') ELSE text END) AS value_sha, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n_tokens FROM documents")
def fulltext_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read_table(spark, d, "documents").select("doc_id", F.sha2(text.fulltext_value(t).cast("binary"), 256).alias("value_sha"), F.size(text.tokens(t)).cast("long").alias("n_tokens"))


@query(f"SELECT doc_id, {KEY} AS entry_key FROM documents")
def entry_keys(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", text.entry_key(F.col("source"), text.clean(F.col("text"))).alias("entry_key"))


@query(f"SELECT tag AS scope_tag, count(*) AS n FROM (SELECT {TAG} AS tag FROM documents) GROUP BY tag")
def scope_tags(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").groupBy(text.scope_tag(F.col("source")).alias("scope_tag")).agg(F.count("*").alias("n"))


CAPITALS = r"regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+')"


@query(f"SELECT doc_id, CASE WHEN len({CAPITALS}) = 0 THEN 'none' ELSE sha256(array_to_string(list_sort(list_distinct(list_transform({CAPITALS}, lambda w: lower(w)))), '|')) END AS entity_sig FROM documents")
def entity_signature(spark: SparkSession, d: str) -> DataFrame:
    names = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Z][a-z]+"), F.lit(0))
    return read_table(spark, d, "documents").select("doc_id", text.entity_signature(names).alias("entity_sig"))


@query("SELECT DISTINCT 'k_' || substr(sha256(c_name), 1, 32) AS gateway_scope, 't' || c_nationkey || '__c' || c_mktsegment AS tenant_scope, substr(c_name, 1, 11) AS shown, c_custkey FROM customer")
def gateway_scopes(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "customer")
    return rows.select(
        text.gateway_scope(F.lit(""), F.col("c_name")).alias("gateway_scope"),
        text.tenant_scope(F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("tenant_scope"),
        text.key_prefix(F.col("c_name")).alias("shown"), "c_custkey",
    ).distinct()


# Tiers


def entries(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(read_table(spark, d, "documents"))
    return rows.select(F.col("doc_id").alias("entry_id"), "text", "source", "lang", text.entry_key(F.lit(None).cast("string"), text.clean(F.col("text"))).alias("entry_key"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "benchmark")
    return rows.select(F.col("item_id").alias("query_id"), "text", text.entry_key(F.lit(None).cast("string"), text.clean(F.col("text"))).alias("entry_key"))


@query(f"""
WITH e AS (SELECT conv_id * 1000 + turn AS id, {CLEAN} AS k, role FROM conversations),
f AS (SELECT k, min(id) AS entry_id FROM e WHERE role = 'user' GROUP BY k)
SELECT e.id AS query_id, f.entry_id, 1.0::DOUBLE AS similarity FROM e JOIN f USING (k)""")
def exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", text.entry_key(F.lit(None).cast("string"), text.clean(F.col("text"))).alias("entry_key")
    )
    held = rows.where("role = 'user'").withColumnRenamed("id", "entry_id")
    return tiers.exact_hits(rows.withColumnRenamed("id", "query_id"), held)


def _lexical_sql(score: str, scoped: bool = False, best: bool = True, least: float = 0.0) -> str:
    by = "AND c.source = q.source" if scoped else ""
    items = "SELECT item_id AS query_id, text, s.source FROM benchmark, (SELECT DISTINCT source FROM documents) s" if scoped else "SELECT item_id AS query_id, text FROM benchmark"
    key = "query_id, source" if scoped else "query_id"
    name = "query_id * 1000 + CAST(substr(source, 4) AS BIGINT)" if scoped else "query_id"
    return f"""
WITH d AS (SELECT doc_id AS entry_id, source, {TOKENS} AS words FROM documents),
q0 AS ({items}), q AS (SELECT {name} AS query_id{', source' if scoped else ''}, list_distinct({TOKENS}) AS asked FROM q0),
vocab AS (SELECT DISTINCT unnest(asked) AS token FROM q),
post AS (SELECT entry_id, token, count(*) AS tf FROM (SELECT entry_id, unnest(words) AS token FROM d) WHERE token IN (SELECT token FROM vocab) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(words)) AS mean FROM d),
qt AS (SELECT query_id, len(asked) AS want, unnest(asked) AS token{', source' if scoped else ''} FROM q),
m AS (
  SELECT q.query_id, c.entry_id, round(sum({score}), 6) AS score
  FROM qt q JOIN post p USING (token) JOIN df USING (token) JOIN d c ON c.entry_id = p.entry_id {by} CROSS JOIN st
  GROUP BY q.query_id, c.entry_id, q.want HAVING count(*) = q.want
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rn FROM m)
SELECT query_id, entry_id, score FROM r WHERE rn = 1 AND score >= {least}"""


IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
BM25 = f"{IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(c.words) / mean))"


def text_index(spark: SparkSession, d: str) -> TextIndex:
    """The stored index of the documents, shared by all lexical queries over the same files."""
    return stored(entries(spark, d), read_table(spark, d, "documents"), "entry_id", "text", ["source"])


def _lexical(spark: SparkSession, d: str, scorer: str, least: float = 0.0) -> DataFrame:
    return lexical.indexed_best(text_index(spark, d), lexical.query_words(asked(spark, d), "query_id", "text"), scorer, least)


@query(_lexical_sql(BM25))
def bm25_top1(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, "BM25")


@query(_lexical_sql(f"tf * {IDF}"))
def tfidf_top1(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, "TFIDF")


@query(_lexical_sql(f"tf * {IDF} / len(c.words)"))
def tfidf_docnorm_top1(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, "TFIDF.DOCNORM")


@query(_lexical_sql("tf::DOUBLE"))
def dismax_top1(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, "DISMAX")


@query(_lexical_sql(BM25, least=150.0))
def lexical_min_score(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, "BM25", 150.0)


@query(_lexical_sql(BM25, scoped=True))
def bm25_scoped(spark: SparkSession, d: str) -> DataFrame:
    """The best entry of every source for each question: one search, the best of each scope taken after it."""
    words = lexical.query_words(asked(spark, d), "query_id", "text")
    found = lexical.indexed_best(text_index(spark, d), words, "BM25", by=("source",))
    return found.select((F.col("query_id") * 1000 + F.substring("source", 4, 9).cast("long")).alias("query_id"), "entry_id", "score")


MISSPELT = "(?s)^(.*?)([a-z]{3})([a-z])([a-z]{2})"


@query()
def fuzzy_top1(spark: SparkSession, d: str) -> DataFrame:
    """Questions with a letter wrong against all words of all documents (DuckDB's edit distance counts bytes, so there is no SQL)."""
    bent = asked(spark, d).withColumn("text", F.regexp_replace("text", MISSPELT, "$1$2x$4"))
    return lexical.best_match(lexical.indexed_fuzzy(text_index(spark, d), lexical.query_words(bent, "query_id", "text"), 1))


# Vectors


def unit_vectors(spark: SparkSession, d: str, name: str, *keep: str, every: bool = False) -> DataFrame:
    """Unit vectors; as queries (``qid``) the stated set of every fifth, unless ``every`` is asked for."""
    rows = read_table(spark, d, "embeddings")
    if name == "qid" and not every:
        rows = rows.where("vec_id % 5 = 0")
    return rows.select(F.col("vec_id").alias(name), vectors.normalised(F.col("embedding")).alias("v"), *keep).where(F.col("v").isNotNull())


UNIT = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings"
PAIRS = f"u AS ({UNIT}), pairs AS (SELECT a.vec_id AS qid, b.vec_id AS rid, round(list_dot_product(a.v, b.v), 9) AS similarity, a.label AS qlabel, b.label AS rlabel FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 5 = 0), near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, rid) AS rank FROM pairs)"


@query(f"WITH {PAIRS} SELECT qid, rid, rank, round(similarity, 6) AS similarity FROM near WHERE rank <= 8")
def knn_top_k(spark: SparkSession, d: str) -> DataFrame:
    found = nearest.nearest(unit_vectors(spark, d, "qid"), unit_vectors(spark, d, "rid"), 8, skip_self=True)
    return found.select("qid", "rid", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {PAIRS} SELECT qid, rid, rank, round(similarity, 6) AS similarity FROM near WHERE rank <= 8")
def knn_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The same by clusters and their bounds. These vectors have no clusters, so nearly all pairs are compared; clustered ones are pruned."""
    held = clusters.Clusters(unit_vectors(spark, d, "rid"))
    found = held.nearest(unit_vectors(spark, d, "qid"), 8, skip_self=True)
    held.close()
    return found.select("qid", "rid", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {PAIRS}, own AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, rid) AS place FROM pairs WHERE qlabel = rlabel) SELECT qid, rid, place AS rank, round(similarity, 6) AS similarity FROM own WHERE place <= 3")
def semantic_in_domain(spark: SparkSession, d: str) -> DataFrame:
    """The nearest three of the query's own domain; the label stands for the domain."""
    found = nearest.nearest(unit_vectors(spark, d, "qid", "label"), unit_vectors(spark, d, "rid", "label"), 3, skip_self=True, on=["label"])
    return found.select("qid", "rid", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {PAIRS} SELECT qid, rid, round(similarity, 6) AS similarity FROM near WHERE rank = 1 AND similarity >= 0.4")
def semantic_threshold(spark: SparkSession, d: str) -> DataFrame:
    found = nearest.nearest(unit_vectors(spark, d, "qid"), unit_vectors(spark, d, "rid"), 1, floor=0.4, skip_self=True)
    return found.select("qid", "rid", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {PAIRS}, s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, rid) AS r FROM pairs WHERE qlabel = rlabel) SELECT qid, rid, round(similarity, 6) AS similarity FROM s WHERE r = 1")
def semantic_scoped(spark: SparkSession, d: str) -> DataFrame:
    found = nearest.nearest(unit_vectors(spark, d, "qid", "label"), unit_vectors(spark, d, "rid", "label"), 1, skip_self=True, on=["label"])
    return found.select("qid", "rid", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {PAIRS}, k AS (SELECT * FROM near WHERE rank <= 10),
g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM k WHERE similarity >= {FLOOR} AND qid % 7 = rid % 7)
SELECT qid AS query_id, rid AS entry_id, round(similarity, 6) AS similarity FROM g WHERE r = 1""")
def entity_aware_semantic(spark: SparkSession, d: str) -> DataFrame:
    found = nearest.nearest(unit_vectors(spark, d, "qid"), unit_vectors(spark, d, "rid"), 10, skip_self=True)
    entity = lambda c: F.array(F.concat(F.lit("e"), (F.col(c) % 7).cast("string")))
    ranked = found.select(F.col("qid").alias("query_id"), F.col("rid").alias("entry_id"), "similarity", "rank", text.entities_overlap(entity("qid"), entity("rid")).alias("shared"))
    return tiers.entity_aware_hits(ranked, F.col("shared"), FLOOR).select("query_id", "entry_id", F.round("similarity", 6).alias("similarity"))


CASCADE = f"""
WITH {PAIRS}, q AS (SELECT item_id AS query_id, {CLEAN} AS k FROM benchmark),
e AS (SELECT k, min(entry_id) AS entry_id FROM (SELECT doc_id AS entry_id, {CLEAN} AS k FROM documents) GROUP BY k),
lex AS ({_lexical_sql(BM25)}),
t1 AS (SELECT query_id, entry_id FROM q JOIN e USING (k)),
t2 AS (SELECT query_id, entry_id FROM lex WHERE query_id NOT IN (SELECT query_id FROM t1)),
t3 AS (SELECT qid AS query_id, rid AS entry_id, similarity FROM near WHERE rank = 1 AND similarity >= 0.4 AND qid IN (SELECT query_id FROM q) AND qid NOT IN (SELECT query_id FROM t1 UNION ALL SELECT query_id FROM t2)),
h AS (SELECT query_id, entry_id, 1.0::DOUBLE AS similarity, 'exact' AS method FROM t1 UNION ALL SELECT query_id, entry_id, NULL, 'bm25' FROM t2 UNION ALL SELECT query_id, entry_id, similarity, 'semantic' FROM t3)"""


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    """Questions against the documents: by key, then by words, then by the vector of the question's number."""
    held, rows = entries(spark, d), unit_vectors(spark, d, "rid")

    def words(left: DataFrame) -> DataFrame:
        found = lexical.indexed_best(text_index(spark, d), lexical.query_words(left, "query_id", "text"), "BM25")
        return found.select("query_id", "entry_id", F.lit(None).alias("similarity"))

    def semantic(left: DataFrame) -> DataFrame:
        mine = unit_vectors(spark, d, "qid").join(left.select(F.col("query_id").alias("qid")), "qid", "left_semi")
        return nearest.nearest(mine, rows, 1, floor=0.4, skip_self=True).select(F.col("qid").alias("query_id"), F.col("rid").alias("entry_id"), "similarity")

    return tiers.cascade(asked(spark, d), [("exact", lambda left: tiers.exact_hits(left, held)), ("bm25", words), ("semantic", semantic)])


@query(CASCADE + " SELECT q.query_id, h.query_id IS NOT NULL AS hit, method, entry_id, round(similarity, 6) AS similarity FROM q LEFT JOIN h USING (query_id)")
def cascade_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _cascade(spark, d).withColumn("similarity", F.round("similarity", 6))


@query(CASCADE + """, b AS (SELECT qid AS query_id, similarity AS best FROM near WHERE rank = 1)
SELECT coalesce(method, 'miss') AS outcome, CASE WHEN h.query_id IS NOT NULL THEN NULL WHEN best IS NULL THEN 'no_candidate' WHEN best < 0.4 THEN 'below_threshold' ELSE 'no_candidate' END AS reason, count(*) AS n
FROM q LEFT JOIN h USING (query_id) LEFT JOIN b USING (query_id) GROUP BY ALL""")
def miss_reasons(spark: SparkSession, d: str) -> DataFrame:
    best = nearest.nearest(unit_vectors(spark, d, "qid"), unit_vectors(spark, d, "rid"), 1, skip_self=True).select(F.col("qid").alias("query_id"), F.col("similarity").alias("best"))
    rows = _cascade(spark, d).join(best, "query_id", "left")
    return rows.groupBy(F.coalesce("method", F.lit("miss")).alias("outcome"), tiers.miss_reason(F.col("hit"), F.col("best"), 0.4).alias("reason")).agg(F.count("*").alias("n"))


# Lifecycle

EPOCH = "epoch(ts)"


def seconds(c: str = "ts"):
    """Epoch seconds of a timestamp with or without a zone (UTC)."""
    return F.col(c).cast("timestamp").cast("double")


@query("SELECT source, lang, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source, lang")
def entry_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars")
    firsts = rows.groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"), F.min_by("n_chars", "doc_id").alias("n_chars"))
    return sinks.upsert(firsts, rows, ["source", "lang"], [F.desc("doc_id")])


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, 'general') AS domain, 'none' AS entity_sig, '[]' AS entities, source AS scope, true AS migrated, 3 AS schema_version FROM documents")
def migrate_defaults(spark: SparkSession, d: str) -> DataFrame:
    old = read_table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("domain"), F.col("source").alias("scope"))
    return migrate(old).select("doc_id", "domain", "entity_sig", "entities", "scope", "migrated", "schema_version")


TTL, PROMOTE = 172_800.0, 5
REPLAY = f"""
WITH o AS (SELECT *, {EPOCH} AS t, row_number() OVER w AS n, coalesce({EPOCH} - lag({EPOCH}) OVER w >= {TTL}, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id, event_type ORDER BY n) AS island FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, island ORDER BY n) AS turn FROM i),
p AS (SELECT *, min(CASE WHEN turn = {PROMOTE} THEN n END) OVER (PARTITION BY user_id, event_type) AS promo FROM r)"""


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.replay_hits(read_table(spark, d, "events"), ["user_id", "event_type"], seconds(), "event_id", TTL, PROMOTE)


@query(REPLAY + " SELECT event_id, turn > 1 OR coalesce(n > promo, false) AS hit FROM p")
def lifecycle_hits(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d).select("event_id", "hit")


@query(REPLAY + " SELECT user_id, event_type, event_id AS promoted_by FROM p WHERE n = promo")
def lifecycle_promotions(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d).where("promotes").select("user_id", "event_type", F.col("event_id").alias("promoted_by"))


NOW = "TIMESTAMP '2024-01-05 00:00:00'"
EXPIRY = "CASE WHEN event_id % 10 <> 0 THEN ts + INTERVAL 2 DAY END"


def _mirror(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").withColumn("expires_at", F.expr(EXPIRY))


@query(f"SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN floor(epoch({EXPIRY}) - epoch({NOW}))::BIGINT END AS remaining FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view') AND (event_id % 10 = 0 OR floor(epoch({EXPIRY}) - epoch({NOW})) > 0)")
def mirror_rebuild(spark: SparkSession, d: str) -> DataFrame:
    rows = _mirror(spark, d).withColumn("left_at", seconds("expires_at"))
    present = rows.where("event_type = 'view'")
    return lifecycle.rebuild(rows, present, "event_id", F.expr(NOW).cast("double"), "left_at").select("event_id", "remaining")


@query(f"SELECT event_type, count(*) AS n, count(*) FILTER (WHERE {EXPIRY} IS NULL) AS permanent FROM events WHERE event_id % 10 = 0 OR {EXPIRY} > {NOW} GROUP BY event_type")
def expired_prune(spark: SparkSession, d: str) -> DataFrame:
    kept = lifecycle.live(_mirror(spark, d), F.expr(NOW))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("expires_at").isNull(), 1)).alias("permanent"))


@query("SELECT source AS scope, count(*) AS purged FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'es') GROUP BY source")
def purge_scope_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").withColumnRenamed("source", "scope")
    return lifecycle.purge(rows, rows.where("lang = 'es'"))[1]


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) <= 20 AS kept FROM documents")
def lru_evict_count(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents")
    return lifecycle.keep_recent(rows, ["source"], [F.desc("n_chars"), F.desc("doc_id")], 20).select("doc_id", "kept")


@query("""SELECT doc_id, rn = 1 OR (rn <= 40 AND held <= 30000) AS kept FROM (SELECT doc_id,
row_number() OVER w AS rn, sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) AS held FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC))""")
def lru_evict_bytes(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents")
    return lifecycle.keep_recent(rows, ["source"], [F.desc("doc_id")], 40, "n_chars", 30_000).select("doc_id", "kept")


@query()
def segment_memo(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return lifecycle.fixed_memo(rows, ["user_id", "event_type"], seconds(), "event_id", 600.0).select("event_id", "hit")


@query()
def rate_limit_decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").select("event_id", "event_type", "ts")
    return lifecycle.rate_limit(rows, ["event_type"], seconds(), "event_id", 10, 3600.0).select("event_id", "allowed")


@query()
def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return lifecycle.breaker(rows, ["user_id"], seconds(), "event_id", F.col("event_type") == "error", 86_400.0, 2, 7_200.0).select("event_id", "refused", "failures")


# Masking


@query()
def redact_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(read_table(spark, d, "documents"))
    masked = masking.redact(F.col("text"))
    return rows.select("doc_id", F.sha2(masked.cast("binary"), 256).alias("masked_sha"), (masked != F.col("text")).alias("changed"))


@query()
def redact_body(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages").select("page_id", masking.redact_body(F.col("html")).alias("body"))


@query("""WITH z AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: x::DOUBLE * 0) ELSE embedding::DOUBLE[] END AS v FROM embeddings)
SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE round(list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) END AS cosine, vec_id % 7 <> 0 AS valid FROM z""")
def vector_checks(spark: SparkSession, d: str) -> DataFrame:
    """Norm, similarity to the first vector and validity, with every seventh vector made zero."""
    rows = read_table(spark, d, "embeddings")
    first = rows.where("vec_id = 0").select(F.col("embedding").alias("sentinel"))  # one row
    v, s = F.col("v"), F.col("sentinel")
    rows = rows.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.col("vec_id") % 7 == 0, x * 0).otherwise(x)).alias("v"))
    return rows.crossJoin(F.broadcast(first)).select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), F.round(vectors.cosine(v, s), 6).alias("cosine"), vectors.valid(v).alias("valid"))


@query()
def trigram_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select("item_id", vectors.trigram_embedding(F.col("text")).alias("embedding"))
