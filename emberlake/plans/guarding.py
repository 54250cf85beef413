"""Queries over the guard: segments, windows, votes, decisions and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.functions import replies, text, vectors
from emberlake.operators import chat, embeddings, guard, nearest
from emberlake.plans.recall import PAIRS, unit_vectors
from emberlake.sources.policy import parse_policy, policy_tables
from emberlake.sources.tables import read_table, staged

FLOOR, ALLOW, BLOCK, TOP_K = 0.25, 0.35, 0.75, 8
MAX_CHARS, MAX_SEGMENTS = 600, 4

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def label_of(c: str):
    return F.when(F.col(c) < 3, "disallowed").otherwise("allowed")


def neighbours(spark: SparkSession, d: str, k: int = TOP_K, every: bool = False, apart: bool = False) -> DataFrame:
    """Each query's nearest exemplars, with the label and category of both.

    Every fifth vector (with ``every`` each one) is a query, held against all
    others; with ``apart`` only against those that are no queries.
    """
    exemplars = unit_vectors(spark, d, "rid")
    if apart:
        exemplars = exemplars.where("rid % 5 <> 0")
    found = nearest.nearest(unit_vectors(spark, d, "qid", every=every), exemplars, k, skip_self=True)
    labels = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("rid"), label_of("label").alias("label"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"))
    own = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), label_of("label").alias("own_label"))
    return found.join(labels, "rid").join(own, "qid")


VOTES = f"""nb AS (SELECT qid, rid, rank, similarity, CASE WHEN rlabel < 3 THEN 'disallowed' ELSE 'allowed' END AS label, 'c' || rlabel AS category, CASE WHEN qlabel < 3 THEN 'disallowed' ELSE 'allowed' END AS own_label FROM near WHERE rank <= {TOP_K}),
voted AS (SELECT qid, own_label,
  CASE WHEN coalesce(sum(greatest(similarity, 0)) FILTER (WHERE similarity >= {FLOOR}), 0) > 0 THEN coalesce(sum(greatest(similarity, 0)) FILTER (WHERE similarity >= {FLOOR} AND label = 'disallowed'), 0) / sum(greatest(similarity, 0)) FILTER (WHERE similarity >= {FLOOR}) ELSE 0.0 END AS score,
  arg_min(category, rank) FILTER (WHERE similarity >= {FLOOR} AND label = 'disallowed') AS best_category,
  count(*) FILTER (WHERE similarity >= {FLOOR}) AS n_scored,
  CASE WHEN count(*) FILTER (WHERE similarity >= {FLOOR}) > 0 THEN list_slice(list(rank ORDER BY rank) FILTER (WHERE similarity >= {FLOOR}), 1, 3) ELSE list_slice(list(rank ORDER BY rank), 1, 3) END AS top
  FROM nb GROUP BY qid, own_label)"""
VOTED = PAIRS + ", " + VOTES
VOTED_APART = PAIRS.replace("a.vec_id % 5 = 0", "a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0") + ", " + VOTES
VOTED_EVERY = PAIRS.replace(" WHERE a.vec_id % 5 = 0", "") + ", " + VOTES


def voted(spark: SparkSession, d: str, floor: float = FLOOR, every: bool = False, apart: bool = False) -> DataFrame:
    return guard.vote(neighbours(spark, d, every=every, apart=apart), floor, ("qid", "own_label"))


@query(f"WITH {VOTED} SELECT qid, round(score, 6) AS score, best_category, n_scored FROM voted")
def guard_vote(spark: SparkSession, d: str) -> DataFrame:
    return voted(spark, d).select("qid", F.round("score", 6).alias("score"), "best_category", "n_scored")


@query(f"WITH {VOTED_APART} SELECT qid, CAST(unnest(top) AS BIGINT) AS rank FROM voted")
def guard_top_matches(spark: SparkSession, d: str) -> DataFrame:
    return voted(spark, d, apart=True).select("qid", F.explode(F.col("top").cast("array<bigint>")).alias("rank"))


JUDGE = "(qid * 37 % 101) / 100.0"
SOFT = "CASE WHEN best_category = 'c1' THEN 'flag' ELSE 'block' END"


def _decided(spark: SparkSession, d: str, mode: str, apart: bool = False) -> DataFrame:
    rows = voted(spark, d, apart=apart).withColumn("judge_score", F.expr("CAST(qid * 37 % 101 AS DOUBLE) / 100D"))
    rows = rows.withColumn("category_action", F.when(F.col("best_category") == "c1", "flag").otherwise("block"))
    return guard.decide(rows, mode, ALLOW, BLOCK)


def _decided_sql(mode: str, votes: str = VOTED) -> str:
    judged = {"embedding-only": "false", "cascade": f"score > {ALLOW} AND score < {BLOCK}", "max": "true", "judge-only": "true"}[mode]
    final = "greatest(score, j)" if mode == "max" else "j"
    return f"""WITH {votes}, s AS (SELECT *, {JUDGE}::DOUBLE AS j, {SOFT} AS soft, {judged} AS judged FROM voted),
z AS (SELECT *, CASE WHEN judged THEN {final} ELSE score END AS fs, CASE WHEN judged THEN 0.6 ELSE {BLOCK} END AS hi, CASE WHEN judged THEN 0.4 ELSE {ALLOW} END AS lo FROM s),
a AS (SELECT *, CASE WHEN fs >= hi THEN 'block' WHEN fs <= lo THEN 'allow' ELSE 'flag' END AS raw FROM z)
SELECT qid, round(fs, 6) AS final_score, CASE WHEN raw <> 'allow' THEN best_category END AS category, judged AS judge_invoked, CASE WHEN raw = 'block' AND soft = 'flag' AND best_category IS NOT NULL THEN 'flag' ELSE raw END AS action FROM a"""


def _decision_columns(rows: DataFrame) -> DataFrame:
    return rows.select("qid", F.round("final_score", 6).alias("final_score"), "category", "judge_invoked", "action")


@query(_decided_sql("embedding-only"))
def guard_decide_embedding(spark: SparkSession, d: str) -> DataFrame:
    return _decision_columns(_decided(spark, d, "embedding-only"))


@query(_decided_sql("cascade"))
def guard_decide_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _decision_columns(_decided(spark, d, "cascade"))


@query(_decided_sql("judge-only"))
def guard_decide_judge(spark: SparkSession, d: str) -> DataFrame:
    return _decision_columns(_decided(spark, d, "judge-only"))


@query(_decided_sql("max"))
def guard_decide_max(spark: SparkSession, d: str) -> DataFrame:
    return _decision_columns(_decided(spark, d, "max"))


@query(f"WITH {VOTED}, w AS (SELECT qid % 50 AS request_id, qid AS position, round(score, 6) AS score FROM voted) SELECT request_id, position, score FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, position) AS r FROM w) WHERE r = 1")
def guard_worst_window(spark: SparkSession, d: str) -> DataFrame:
    rows = voted(spark, d).select((F.col("qid") % 50).alias("request_id"), F.col("qid").alias("position"), F.round("score", 6).alias("score"))
    return guard.worst_window(rows)


def _loo(spark: SparkSession, d: str) -> DataFrame:
    """Every exemplar against all others: its vote and its nearest similarity, a short row each.

    Staged, as reports read it several times: all pairs are compared once.
    """
    near = neighbours(spark, d, every=True)
    votes = guard.vote(near, FLOOR, ("qid", "own_label"), F.max("similarity").alias("nearest"))
    return staged(votes.withColumnRenamed("own_label", "label"))


@query(f"WITH {VOTED_EVERY}, b AS (SELECT qid, max(similarity) AS nearest FROM nb GROUP BY qid) SELECT qid, own_label AS label, round(score, 6) AS score, round(nearest, 6) AS nearest FROM voted JOIN b USING (qid)")
def guard_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return _loo(spark, d).select("qid", "label", F.round("score", 6).alias("score"), F.round("nearest", 6).alias("nearest"))


@query(f"WITH {VOTED_EVERY} SELECT coalesce(round(avg((score > {ALLOW} AND score < {BLOCK})::INT), 6), 0) AS judge_rate, count(*) AS n FROM voted")
def guard_judge_rate(spark: SparkSession, d: str) -> DataFrame:
    return guard.judge_rate(voted(spark, d, every=True), ALLOW, BLOCK).withColumn("judge_rate", F.round("judge_rate", 6))


PROBLEM = f"CASE WHEN own_label = 'disallowed' AND score = 0 THEN 'floor_too_high' WHEN own_label = 'allowed' AND score >= {BLOCK} THEN 'allowed_at_block' WHEN own_label = 'disallowed' AND score <= {ALLOW} THEN 'disallowed_at_allow' END"


@query(f"WITH {VOTED_EVERY} SELECT {PROBLEM} AS problem, count(*) AS n, count(*) FILTER (WHERE score > {ALLOW} AND score < {BLOCK}) AS in_band FROM voted GROUP BY 1")
def guard_separability(spark: SparkSession, d: str) -> DataFrame:
    rows = guard.separability(_loo(spark, d), ALLOW, BLOCK)
    return rows.groupBy("problem").agg(F.count("*").alias("n"), F.count(F.when(F.col("in_band"), 1)).alias("in_band"))


ADVICE = "CASE problem WHEN 'floor_too_high' THEN 'lower min_similarity' WHEN 'allowed_at_block' THEN 'block_threshold above ' || printf('%.2f', score) ELSE 'allow_threshold below ' || printf('%.2f', score) END"
REPORT = f"w AS (SELECT qid, own_label, score, {PROBLEM} AS problem FROM voted), report AS (SELECT row_number() OVER (ORDER BY qid) AS place, qid, own_label, problem, count(*) OVER () AS n_problems, {ADVICE} AS advice FROM w WHERE problem IS NOT NULL ORDER BY qid LIMIT 5)"


@query(f"WITH {VOTED_EVERY}, {REPORT} SELECT place, qid, problem, n_problems, advice FROM report")
def guard_separability_report(spark: SparkSession, d: str) -> DataFrame:
    report = guard.separability_report(_loo(spark, d), ALLOW, BLOCK)
    return report.select(F.col("place").cast("long").alias("place"), "qid", "problem", "n_problems", "advice")


@query(f"""WITH {VOTED_EVERY}, {REPORT},
l AS (SELECT string_agg(place || '. ' || own_label || ' example ' || chr(39) || qid || chr(39) || ': ' || problem || '; ' || advice, chr(10) ORDER BY place) AS lines, coalesce(max(n_problems), 0) AS n_problems FROM report),
t AS (SELECT count(*) AS n, coalesce(bool_or(own_label = 'disallowed' AND score = 0), false) AS unvoted, min(score) FILTER (WHERE own_label = 'disallowed' AND score > 0) AS least, max(score) FILTER (WHERE own_label = 'allowed') AS most FROM voted)
SELECT n_problems, CASE WHEN n_problems > 0 THEN concat_ws(chr(10), 'The policy' || chr(39) || 's examples are not apart with allow_threshold={ALLOW}, block_threshold={BLOCK}, min_similarity={FLOOR}: ' || n_problems || ' of ' || n || ' affected.', lines,
CASE WHEN n_problems > 5 THEN 'and ' || (n_problems - 5) || ' more' END,
CASE WHEN unvoted THEN 'Lower min_similarity first: no threshold helps an example without neighbours.' WHEN most >= 1 THEN 'No block_threshold passes while an allowed example scores 1.00: reword or remove it.'
ELSE 'These thresholds would pass: allow_threshold below ' || printf('%.2f', least) || ', block_threshold above ' || printf('%.2f', most) || '.' || CASE WHEN least <= most THEN ' The examples overlap, so many inputs would lie between: better change the examples.' ELSE '' END END) END AS message FROM l, t""")
def guard_explanation(spark: SparkSession, d: str) -> DataFrame:
    """What an app is told about examples that are not apart, over every exemplar."""
    return guard.explanation(_loo(spark, d), ALLOW, BLOCK, FLOOR)


@query(f"WITH {VOTED_EVERY} SELECT round(min(score) FILTER (WHERE own_label = 'disallowed' AND score > 0), 6) AS min_disallowed, round(max(score) FILTER (WHERE own_label = 'allowed'), 6) AS max_allowed, coalesce(max(score) FILTER (WHERE own_label = 'allowed') >= min(score) FILTER (WHERE own_label = 'disallowed' AND score > 0), false) AS overlap FROM voted")
def threshold_suggestion(spark: SparkSession, d: str) -> DataFrame:
    found = guard.threshold_suggestion(_loo(spark, d))
    return found.select(F.round("min_disallowed", 6).alias("min_disallowed"), F.round("max_allowed", 6).alias("max_allowed"), "overlap")


@query(f"WITH {VOTED_EVERY}, e AS (SELECT own_label AS l, CASE WHEN score >= {BLOCK} THEN 'block' WHEN score <= {ALLOW} THEN 'allow' ELSE 'flag' END AS a FROM voted) SELECT round(count(*) FILTER (WHERE l = 'disallowed' AND a = 'block') / greatest(count(*) FILTER (WHERE l = 'disallowed'), 1), 6) AS catch_rate, round(count(*) FILTER (WHERE l = 'disallowed' AND a <> 'allow') / greatest(count(*) FILTER (WHERE l = 'disallowed'), 1), 6) AS catch_or_flag, round(count(*) FILTER (WHERE l = 'allowed' AND a = 'block') / greatest(count(*) FILTER (WHERE l = 'allowed'), 1), 6) AS false_alarm, round(count(*) FILTER (WHERE l = 'allowed' AND a = 'flag') / greatest(count(*) FILTER (WHERE l = 'allowed'), 1), 6) AS benign_flag, count(*) AS n FROM e")
def guard_eval(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None)
    rows = voted(spark, d, every=True).withColumn("judge_score", none.cast("double")).withColumn("category_action", none.cast("string"))
    done = guard.evaluation(guard.decide(rows, "embedding-only", ALLOW, BLOCK).withColumnRenamed("own_label", "label"))
    return done.select(*[F.round(c, 6).alias(c) for c in ("catch_rate", "catch_or_flag", "false_alarm", "benign_flag")], "n")


@query(f"""WITH {VOTED_EVERY}, f AS (SELECT (20 + 5 * i) / 100.0::DOUBLE AS floor FROM range(9) t(i)),
v AS (SELECT floor, qid, own_label, coalesce(sum(greatest(similarity, 0)) FILTER (WHERE similarity >= floor AND label = 'disallowed') / nullif(sum(greatest(similarity, 0)) FILTER (WHERE similarity >= floor), 0), 0) AS score FROM nb, f GROUP BY ALL)
SELECT floor, round(avg((own_label = 'disallowed' AND score >= {BLOCK})::INT) / avg((own_label = 'disallowed')::INT), 6) AS catch_rate, round(min(score) FILTER (WHERE own_label = 'disallowed'), 6) AS min_violation, round(max(score) FILTER (WHERE own_label = 'allowed'), 6) AS max_benign, min(score) FILTER (WHERE own_label = 'disallowed') > max(score) FILTER (WHERE own_label = 'allowed') AS separable FROM v GROUP BY floor""")
def guard_floor_sweep(spark: SparkSession, d: str) -> DataFrame:
    floors = spark.range(9).select(((F.lit(20) + 5 * F.col("id")) / 100.0).alias("floor"))
    near = neighbours(spark, d, every=True).crossJoin(F.broadcast(floors))  # nine rows
    votes = F.col("similarity") >= F.col("floor")
    weight = F.greatest("similarity", F.lit(0.0))
    total = F.sum(F.when(votes, weight))
    against = F.sum(F.when(votes & (F.col("label") == "disallowed"), weight))
    rows = near.groupBy("floor", "qid", "own_label").agg(F.coalesce(against / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("score"))
    bad = F.col("own_label") == "disallowed"
    low, high = F.min(F.when(bad, F.col("score"))), F.max(F.when(~bad, F.col("score")))
    return rows.groupBy("floor").agg(
        F.round(F.avg((bad & (F.col("score") >= BLOCK)).cast("int")) / F.avg(bad.cast("int")), 6).alias("catch_rate"),
        F.round(low, 6).alias("min_violation"), F.round(high, 6).alias("max_benign"), (low > high).alias("separable"),
    )


# Segments and windows


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return chat.segments(read_table(spark, d, "conversations"), "conv_id", "turn", "role", "text", guard.CHECK_ROLES)


SEGMENTS = "seg AS (SELECT conv_id AS request_id, turn AS position, role, trim(text) AS text FROM conversations WHERE role IN ('user', 'system', 'tool') AND trim(coalesce(text, '')) <> '')"


@query(f"WITH {SEGMENTS} SELECT request_id, position, role, length(text) AS chars, sha256(text) AS text_sha FROM seg")
def guard_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("request_id", "position", "role", F.length("text").cast("long").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"))


WINDOWS = f"""{SEGMENTS}, lim AS (SELECT request_id, count(*) > {MAX_SEGMENTS} OR max(CASE WHEN length(text) <= {MAX_CHARS} THEN 1 ELSE ceil(length(text) / {int(MAX_CHARS * 0.75)}.0) END) > 4 OR sum(length(text)) > {MAX_CHARS * 4} AS refused FROM seg GROUP BY request_id),
win AS (SELECT s.request_id, position, i AS win, substr(text, i * {int(MAX_CHARS * 0.75)} + 1, {MAX_CHARS}) AS piece FROM seg s JOIN lim USING (request_id), range(4) r(i) WHERE NOT refused AND (i = 0 OR (length(text) > {MAX_CHARS} AND i * {int(MAX_CHARS * 0.75)} < length(text))))"""


@query(f"WITH {WINDOWS} SELECT request_id, position, win AS win_no, length(piece) AS chars, sha256(piece) AS piece_sha FROM win")
def guard_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = guard.windows(_segments(spark, d), MAX_CHARS, MAX_SEGMENTS).where("not refused")
    return rows.select("request_id", "position", F.col("window").cast("long").alias("win_no"), F.length("piece").cast("long").alias("chars"), F.sha2(F.col("piece").cast("binary"), 256).alias("piece_sha"))


@query(f"WITH {WINDOWS} SELECT request_id FROM lim WHERE refused")
def guard_refusals(spark: SparkSession, d: str) -> DataFrame:
    return guard.windows(_segments(spark, d), MAX_CHARS, MAX_SEGMENTS).where("refused").select("request_id")


@query(f"""WITH {VOTED}, o AS (SELECT qid, CASE WHEN qid % 11 = 0 THEN 'error' WHEN score >= {BLOCK} THEN 'block' WHEN score <= {ALLOW} THEN 'allow' ELSE 'flag' END AS action, CASE WHEN qid % 33 = 0 THEN 'config_invalid' ELSE 'judge_unreachable' END AS reason, qid % 2 = 0 AS degrade FROM voted)
SELECT qid, CASE WHEN reason = 'config_invalid' THEN 502 WHEN action = 'error' AND NOT degrade THEN 503 ELSE 200 END AS status, CASE WHEN reason = 'config_invalid' THEN 'config_invalid' WHEN action = 'error' AND degrade THEN 'degraded' WHEN action = 'error' THEN 'unavailable' WHEN action = 'block' THEN 'content_filter' WHEN action = 'flag' THEN 'flagged' ELSE 'passed' END AS guardrail FROM o""")
def guard_responses(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("score")
    action = F.when(F.col("qid") % 11 == 0, "error").when(score >= BLOCK, "block").when(score <= ALLOW, "allow").otherwise("flag")
    rows = voted(spark, d).select("qid", action.alias("action"), F.when(F.col("qid") % 33 == 0, "config_invalid").otherwise("judge_unreachable").alias("reason"), (F.col("qid") % 2 == 0).alias("degrade"), F.lit("error").alias("unavailable_response"))
    return guard.respond(rows).select("qid", "status", "guardrail")


NOTE = "CAST(json_merge_patch('{}', json_object('action', action, 'category', category, 'score', round(final_score, 4), 'judge_invoked', judge_invoked, 'policy', 'abcdef012345', 'request_id', 'r' || qid)) AS VARCHAR)"


def sse_sql(id_: str, created: str, text: str, finish: str, usage: str, note: str = "''") -> str:
    """A reply's stream as one text, for the SQL side."""
    head = f"'data: {{' || trim(CAST(json_object('id', {id_}, 'object', 'chat.completion.chunk', 'created', {created}, 'model', 'm') AS VARCHAR), '{{}}')"
    end = "'}' || chr(10) || chr(10)"
    choice = lambda delta, ended: f"',\"choices\":' || CAST(json_array(json_object('index', 0, 'delta', {delta}, 'finish_reason', {ended})) AS VARCHAR)"
    spent = "',\"choices\":[],\"usage\":{\"prompt_tokens\":0,\"completion_tokens\":0,\"total_tokens\":0}'"
    chunks = (("json_object('role', 'assistant')", "NULL", note), (f"json_object('content', {text})", "NULL", "''"), ("json_object()", finish, "''"))
    lines = [f"{head} || {choice(delta, ended)} || {own} || {end}" for delta, ended, own in chunks]
    return " || ".join([*lines, f"CASE WHEN {usage} THEN {head} || {spent} || {end} ELSE '' END", "'data: [DONE]' || chr(10) || chr(10)"])


def body_sql(id_: str, created: str, text: str, finish: str, name: str, note: str) -> str:
    """A whole reply of the rows of ``r``, for the SQL side."""
    choice = f"json_array(json_object('index', 0, 'message', json_object('role', 'assistant', 'content', {text}), 'finish_reason', '{finish}'))"
    usage = "json_object('prompt_tokens', 0, 'completion_tokens', 0, 'total_tokens', 0)"
    return f"CAST(json_object('id', {id_}, 'object', 'chat.completion', 'created', {created}, 'model', 'm', 'choices', {choice}, 'usage', {usage}, '{name}', CAST({note} AS JSON)) AS VARCHAR)"


_REFUSED = "'I can''t help with that request.'"


@query(f"""WITH r AS (SELECT * FROM ({_decided_sql("cascade", VOTED_APART)}) WHERE action = 'block')
SELECT qid, {sse_sql("'chatcmpl-guard-' || qid", "qid", _REFUSED, "'content_filter'", "qid % 2 = 0", f"',\"guardrail\":' || {NOTE}")} AS stream, {body_sql("'chatcmpl-guard-' || qid", "qid", _REFUSED, "content_filter", "guardrail", NOTE)} AS body FROM r""")
def guard_refusal_replies(spark: SparkSession, d: str) -> DataFrame:
    """What a blocked request is answered, as a whole body and as a stream."""
    rows = _decided(spark, d, "cascade", apart=True).where("action = 'block'")
    none = F.lit(None).cast("string")
    note = chat.guardrail_note(F.col("action"), F.col("category"), F.col("final_score"), F.col("judge_invoked"), F.lit("abcdef0123456789"), none, F.concat(F.lit("r"), F.col("qid").cast("string")))
    given = (F.concat(F.lit("chatcmpl-guard-"), F.col("qid").cast("string")), F.col("qid"), F.lit("m"), guard.refusal_text(none, none, none), "content_filter")
    stream = chat.reply_stream(*given, usage=F.col("qid") % 2 == 0, note=note)
    return rows.select("qid", F.array_join(stream, "").alias("stream"), chat.reply_body(*given, note=note, name="guardrail").alias("body"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_type ELSE 'I can''t help with that request.' END AS refusal FROM part")
def guard_refusal_text(spark: SparkSession, d: str) -> DataFrame:
    third = F.col("p_size") % 3
    category, policy = F.when(third == 0, F.col("p_brand")), F.when(third == 1, F.col("p_type")).otherwise("")
    return read_table(spark, d, "part").select("p_partkey", guard.refusal_text(category, policy, F.lit(None).cast("string")).alias("refusal"))


POLICY = """
default_refusal: No.
categories:
  - category_id: insult
    disallowed_exemplars: [you are worthless, what a moron]
    allowed_exemplars: [you are kind]
  - category_id: advice
    action: flag
    disallowed_exemplars: [which stock should i buy]
    allowed_exemplars: [what is a stock, how do markets work]
"""


@query("""WITH c AS (SELECT r_regionkey AS id, n_name, n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'block' ELSE 'flag' END AS action FROM nation JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT id, n_name AS category_id, action, unnest(['disallowed', 'allowed']) AS label, unnest([n_name || ' is bad', n_name || ' is good']) AS text, unnest([0, 1]) AS nth, n_nationkey FROM c),
fine AS (SELECT id, bool_or(action = 'block') AS ok FROM c GROUP BY id)
SELECT id, CASE WHEN ok THEN (row_number() OVER (PARTITION BY id ORDER BY n_nationkey, nth) - 1)::INT END AS ord, category_id, label, text, action, CASE WHEN NOT ok THEN 'no category blocks' END AS problem FROM e JOIN fine USING (id) WHERE ok
UNION ALL SELECT 10 + r_regionkey, NULL, NULL, NULL, NULL, NULL, 'policy.categories is empty' FROM region
UNION ALL SELECT 20 + r_regionkey, NULL, NULL, NULL, NULL, NULL, 'policy has no field ' || r_name FROM region""")
def policy_exemplars(spark: SparkSession, d: str) -> DataFrame:
    """Policies as rows, one for each region with its nations as categories, and broken ones beside them: exemplars and problems."""
    nations = read_table(spark, d, "nation")
    one = lambda kind: F.array(F.concat("n_name", F.lit(f" is {kind} ")))
    category = F.struct(
        "n_nationkey", F.struct(F.col("n_name").alias("category_id"), F.when(F.col("n_nationkey") % 2 == 0, "block").otherwise("flag").alias("action"), one("bad").alias("disallowed_exemplars"), one("good").alias("allowed_exemplars")).alias("c")
    )
    listed = nations.groupBy(F.col("n_regionkey").alias("id")).agg(F.sort_array(F.collect_list(category)).alias("l"))
    good = listed.select("id", F.to_json(F.struct(F.col("l.c").alias("categories"))).alias("document"))
    regions = read_table(spark, d, "region")
    empty = regions.select((F.col("r_regionkey") + 10).alias("id"), F.lit('{"categories": []}').alias("document"))
    odd = regions.select((F.col("r_regionkey") + 20).alias("id"), F.concat(F.lit('{"categories": [{"category_id": "c", "disallowed_exemplars": ["x"]}], "'), "r_name", F.lit('": 1}')).alias("document"))
    return policy_tables(good.unionByName(empty).unionByName(odd), "id", "document")


# Replies


@query(r"""SELECT event_id, k / 100.0::DOUBLE AS confidence, CASE WHEN k > 100 THEN 'out_of_range' END AS error FROM (SELECT event_id, CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k FROM events)""")
def judge_reply_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    body = F.concat(F.lit('Sure. {"score": '), (k / 100.0).cast("string"), F.lit(', "reason": "as asked"} That is all {ok}.'))
    rows = read_table(spark, d, "events").select("event_id", replies.judge_verdict(body).alias("v"))
    return rows.select("event_id", "v.confidence", "v.error")


@query(r"SELECT event_id, event_type AS kind, lower(event_type || ':' || user_id) AS identifier FROM events")
def entity_json_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events")
    item = F.struct(F.struct(F.col("event_type").alias("type"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("text")).alias("a"))
    reply = F.concat(F.lit("```json\n{\"entities\": [{\"type\": \"\"}, 7, "), F.to_json(item["a"]), F.lit("]}\n```"))
    found = rows.select("event_id", F.explode(replies.extracted_entities(reply)).alias("e"))
    return found.select("event_id", F.col("e.type").alias("kind"), F.lower("e.identifier").alias("identifier"))


@query("""SELECT item_id, sha256(replace(text || repeat('"', 3) || '"x"', repeat('"', 3), '“”“')) AS prompt_sha FROM benchmark""")
def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Texts made safe for a judge's prompt, with bells for spaces and three quotes put in before."""
    spoilt = F.concat(F.translate("text", " ", "\x07"), F.lit('"""' + '"x"'))
    return read_table(spark, d, "benchmark").select("item_id", F.sha2(text.sanitize_for_judging(spoilt).cast("binary"), 256).alias("prompt_sha"))


TASK = "a shop"


@query(f"""WITH c AS (SELECT string_agg('- ' || r_name || ': about ' || r_name, chr(10) ORDER BY r_name) AS topics FROM region)
SELECT item_id, sha256('Setting: {TASK}' || chr(10) || 'Topics:' || chr(10) || topics || chr(10) || 'Examples:' || chr(10) || '- (allowed) "' || text || '"' || chr(10) || '{guard.JUDGE_TASK}') AS system_sha, sha256(text) AS user_sha FROM benchmark, c""")
def judge_messages(spark: SparkSession, d: str) -> DataFrame:
    """The two messages of a judge, the regions as topics in any order of rows."""
    topic = F.struct(F.col("r_name").alias("name"), F.concat(F.lit("about "), "r_name").alias("description"))
    topics = read_table(spark, d, "region").agg(F.collect_list(topic).alias("topics"))
    example = F.array(F.struct(F.lit("allowed").alias("label"), F.col("text")))
    prompt = guard.judge_prompt(F.col("text"), F.lit(TASK), F.col("topics"), example)
    rows = read_table(spark, d, "benchmark").crossJoin(F.broadcast(topics)).select("item_id", prompt.alias("p"))  # one row
    return rows.select("item_id", *[F.sha2(F.col(f"p.{part}").cast("binary"), 256).alias(f"{part}_sha") for part in ("system", "user")])


# Replies of an embedding endpoint: batches of 64 vectors, with a fault by the batch's number.


@query("""WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS own, (vec_id // 64) % 16 AS fault, count(*) OVER (PARTITION BY vec_id // 64) AS n FROM embeddings),
p AS (SELECT *, CASE WHEN fault = 2 AND n > 1 THEN 'repeated_index' WHEN fault = 3 THEN 'wrong_count' WHEN fault = 4 AND n > 1 THEN 'mixed_dimensions' WHEN fault = 5 THEN 'endpoint_error' WHEN fault = 6 THEN 'bad_index' WHEN fault = 7 THEN 'no_reply' END AS problem FROM b)
SELECT vec_id, problem, CASE WHEN problem IS NULL THEN round(own[1] / sqrt(list_dot_product(own, own)), 6) END AS first, CASE WHEN problem IS NULL THEN round(own[-1] / sqrt(list_dot_product(own, own)), 6) END AS last FROM p""")
def embedding_replies(spark: SparkSession, d: str) -> DataFrame:
    """Every vector through a reply's JSON and back: out of order, without index, repeated, short, mixed, failed, out of range, missing."""
    rows = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.expr("vec_id div 64").alias("batch"))
    requests = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("own"))  # at most 64 rows
    fault, several = F.col("batch") % 16, F.size("own") > 1
    index = lambda i: F.when(fault == 2, 0).when(fault == 6, i + 1).when(fault != 1, i)
    vector = lambda x, i: F.when((fault == 4) & several & (i == 0), F.slice(x["v"], 2, F.size(x["v"]) - 1)).otherwise(x["v"])
    items = F.transform("own", lambda x, i: F.struct(index(i).alias("index"), vector(x, i).alias("embedding")))
    dealt = F.when(fault == 1, items).when(fault == 3, F.slice(items, 1, F.size(items) - 1)).otherwise(F.reverse(items))
    reply = F.when(fault == 5, F.lit('{"error":{"message":"overloaded"}}')).when(fault != 7, F.to_json(F.struct(dealt.alias("data"))))
    asked = requests.select(F.transform("own", lambda x: x["vec_id"].cast("string")).alias("texts"), reply.alias("reply"))
    read = embeddings.read_replies(asked, "texts", "reply")
    return read.select(F.col("text").cast("long").alias("vec_id"), "problem", F.round(F.col("vector")[0], 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"))


@query()
def guard_chain(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation through the whole guard: the policy's exemplars, the stand-in embedder, no judge."""
    policy = parse_policy(POLICY).frame(spark).select(F.col("ord").cast("long").alias("rid"), vectors.trigram_embedding(F.col("text")).alias("v"), "label", F.col("category_id").alias("category"), "text", "action", F.lit(None).cast("string").alias("description"))
    messages = read_table(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), "turn", "role", F.col("text").alias("content"))
    embed = lambda rows: rows.withColumn("vector", vectors.trigram_embedding(F.col("piece")))
    out = guard.check_requests(messages, policy, embed, floor=FLOOR, allow=ALLOW, block=BLOCK, max_chars=MAX_CHARS, max_segments=MAX_SEGMENTS)
    return out.select("request_id", "action", "reason", F.round("final_score", 6).alias("final_score"), "category")
