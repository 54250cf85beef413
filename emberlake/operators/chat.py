"""Chat requests: text of messages, last user turn, cacheability, streamed replies, response shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.functions.text import clean_edges

PARTS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))
# Request fields whose presence bypasses the cache.
BYPASS_FIELDS = ("tools", "tool_choice", "functions", "response_format")


def content_text(content: Column) -> Column:
    """A message's text: the string itself, or the typed text parts of a JSON list, joined by spaces."""
    parts = F.from_json(content, PARTS)
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & (p["text"] != "")), lambda p: p["text"])
    return F.when(_is_list(content, parts), F.array_join(texts, " ")).otherwise(content)


def _is_list(content: Column, parts: Column) -> Column:
    return F.startswith(F.ltrim(content), F.lit("[{")) & parts.isNotNull()


def guard_text(content: Column) -> Column:
    """The text a guard reads: that of every part, of whatever type."""
    parts = F.from_json(content, PARTS)
    texts = F.transform(F.filter(parts, lambda p: p["text"] != ""), lambda p: p["text"])
    return F.when(_is_list(content, parts), F.array_join(texts, " ")).otherwise(content)


def unreadable(content: Column) -> Column:
    """Whether a list of parts gives no text at all: content a guard cannot read."""
    parts = F.from_json(content, PARTS)
    return F.coalesce(_is_list(content, parts) & (clean_edges(guard_text(content)) == ""), F.lit(False))


def last_user_text(messages: DataFrame, request: str, turn: str, role: str, text: str) -> DataFrame:
    """The text of each request's last user message; blank is null. Requests without one have null."""
    mine = F.when(F.col(role) == "user", F.col(turn))
    found = messages.groupBy(request).agg(F.max_by(text, mine).alias("content")).select(request, content_text(F.col("content")).alias("cache_text"))
    return found.withColumn("cache_text", F.nullif(clean_edges(F.col("cache_text")), F.lit("")))


def segments(messages: DataFrame, request: str, turn: str, role: str, text: str, roles: tuple[str, ...]) -> DataFrame:
    """Texts to guard: (request_id, position, role, text) of the checked roles, stripped and not empty."""
    stripped = clean_edges(guard_text(F.col(text)))
    rows = messages.where(F.col(role).isin(*roles)).select(F.col(request).alias("request_id"), F.col(turn).alias("position"), F.col(role).alias("role"), stripped.alias("text"))
    return rows.where(F.coalesce(F.col("text"), F.lit("")) != "")


def unguardable(messages: DataFrame, request: str, role: str, text: str, roles: tuple[str, ...]) -> DataFrame:
    """Requests (request_id) with a message of the checked roles that a guard cannot read."""
    hidden = messages.where(F.col(role).isin(*roles) & unreadable(F.col(text)))
    return hidden.select(F.col(request).alias("request_id")).distinct()


def cacheable(enabled: Column, n: Column, bypass: Column) -> Column:
    """Requests may use the cache if it is on, one choice is asked for, and no bypass field is set."""
    return F.coalesce(enabled, F.lit(False)) & (F.coalesce(n, F.lit(1)) == 1) & ~F.arrays_overlap(F.coalesce(bypass, F.array().cast("array<string>")), F.array(*map(F.lit, BYPASS_FIELDS)))


def may_store(finish: Column, text: Column, degraded: Column) -> Column:
    """Replies may be written back if they ended by themselves, are not blank and not degraded."""
    return F.coalesce((finish == "stop") & (clean_edges(text) != "") & ~degraded, F.lit(False))


def accumulate_stream(lines: DataFrame, stream: str = "stream_id", seq: str = "seq", line: str = "line") -> DataFrame:
    """Server-sent event lines as replies: joined deltas of choice 0, last finish reason, last usage, end seen.

    Blanks and line ends around a line do not matter; lines that are no data, or
    no JSON, are passed over. An empty finish reason is none.
    """
    schema = "choices array<struct<index int, delta struct<content string>, finish_reason string>>, usage struct<total_tokens long>"
    data = F.trim(F.regexp_extract(clean_edges(F.col(line)), r"(?s)^data:\s*(.*)$", 1))
    body = F.from_json(F.when(data != "[DONE]", data), schema)
    first = F.filter(F.col("body.choices"), lambda c: F.coalesce(c["index"], F.lit(0)) == 0)
    pieces = F.array_join(F.transform(first, lambda c: F.coalesce(c["delta"]["content"], F.lit(""))), "")
    ended = F.filter(first, lambda c: F.coalesce(c["finish_reason"], F.lit("")) != "")
    finish = F.when(F.size(ended) > 0, F.element_at(ended, -1)["finish_reason"])
    rows = lines.select(stream, seq, data.alias("data"), body.alias("body")).withColumn("piece", pieces).withColumn("finish", finish)
    ordered = F.array_sort(F.collect_list(F.struct(seq, "piece")))
    return rows.groupBy(stream).agg(
        F.array_join(F.transform(ordered, lambda x: F.coalesce(x["piece"], F.lit(""))), "").alias("content"),
        F.max_by("finish", F.when(F.col("finish").isNotNull(), F.col(seq))).alias("finish_reason"),
        F.max_by("body.usage.total_tokens", F.when(F.col("body.usage").isNotNull(), F.col(seq))).alias("total_tokens"),
        F.max(F.col("data") == "[DONE]").alias("done"),
    )


def completion_chunks(replies: DataFrame, reply: str, text: str, model: str, size: int = 20) -> DataFrame:
    """A cached reply as stream chunks: (reply, seq, line), content pieces, a stop chunk and the end mark."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    chunk = lambda content, finish: F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("chat.completion.chunk").alias("object"), F.col(model).alias("model"), F.array(F.struct(F.lit(0).alias("index"), F.struct(content.alias("content")).alias("delta"), finish.alias("finish_reason"))).alias("choices"))))
    none = F.lit(None).cast("string")
    lines = F.concat(
        F.transform(starts, lambda s: chunk(F.substring(F.col(text), s + 1, F.lit(size)), none)),
        F.array(chunk(none, F.lit("stop")), F.lit("data: [DONE]")),
    )
    return replies.select(reply, F.posexplode(lines).alias("seq", "line"))


def guardrail_note(action: Column, category: Column, score: Column, judged: Column, policy: Column, reason: Column, request: Column | None = None) -> Column:
    """The guardrail field as JSON; empty parts are left out, the score has four places, the policy 12 characters.

    Whether a judge was asked is always told; null counts as not.
    """
    blank = lambda c: F.nullif(c, F.lit(""))
    asked = F.coalesce(judged, F.lit(False))
    request = F.lit(None).cast("string") if request is None else request
    return F.to_json(F.struct(
        action.alias("action"), blank(category).alias("category"), F.round(score, 4).alias("score"), asked.alias("judge_invoked"),
        blank(F.substring(policy, 1, 12)).alias("policy"), blank(request).alias("request_id"), blank(reason).alias("reason"),
    ))


def _members(fields: Column, shown: bool = False) -> Column:
    """A struct's JSON members without the braces; with ``shown`` nulls are written too."""
    text = F.to_json(fields, {"ignoreNullFields": str(not shown).lower()})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _usage() -> Column:
    """No upstream tokens are spent on what a cache or a guard answers."""
    return F.struct(*[F.lit(0).alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")])


def _note_member(note: Column | None, name: str) -> Column:
    """``,"name":note`` of a JSON text; nothing where it is null."""
    return F.lit("") if note is None else F.coalesce(F.concat(F.lit(f',"{name}":'), note), F.lit(""))


def hit_note(similarity: Column) -> Column:
    """The cache's field of a reply it answers; an exact hit has no similarity, written as null."""
    return F.concat(F.lit("{"), _members(F.struct(F.lit(True).alias("hit"), similarity.alias("similarity")), True), F.lit("}"))


def reply_body(reply: Column, created: Column, model: Column, text: Column, finish: str, note: Column | None = None, name: str = "semantic_cache") -> Column:
    """A whole reply as JSON. A cache's ends with ``stop``, a guard's refusal with ``content_filter``.

    ``note`` is JSON that is shown under ``name``: ``hit_note`` or ``guardrail_note``. A null text is empty.
    """
    message = F.struct(F.lit("assistant").alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit(finish).alias("finish_reason"))
    fields = F.struct(reply.alias("id"), F.lit("chat.completion").alias("object"), created.alias("created"), model.alias("model"), F.array(choice).alias("choices"), _usage().alias("usage"))
    return F.concat(F.lit("{"), _members(fields), _note_member(note, name), F.lit("}"))


def reply_stream(reply: Column, created: Column, model: Column, text: Column, finish: str, usage: Column | None = None, note: Column | None = None, name: str = "guardrail") -> Column:
    """A whole reply as an array of server-sent event lines, each ending in a blank line.

    A chunk with the role, one with the whole text, one with the finish reason,
    one with zero usage and no choices where ``usage`` is true, and the end
    mark. ``note``, JSON, is in the first chunk under ``name``, so that a client
    that stops reading has seen it. A null text is empty, a null ``usage`` false.
    """
    head = _members(F.struct(reply.alias("id"), F.lit("chat.completion.chunk").alias("object"), created.alias("created"), model.alias("model")))
    line = lambda members: F.concat(F.lit("data: {"), head, F.lit(","), members, F.lit("}\n\n"))
    no_delta = F.create_map().cast("map<string,string>")

    def choice(delta: Column, ended: Column) -> Column:
        return _members(F.struct(F.array(F.struct(F.lit(0).alias("index"), delta.alias("delta"), ended.alias("finish_reason"))).alias("choices")), True)

    open_end = F.lit(None).cast("string")
    first = F.concat(choice(F.create_map(F.lit("role"), F.lit("assistant")), open_end), _note_member(note, name))
    lines = [line(first), line(choice(F.create_map(F.lit("content"), F.coalesce(text, F.lit(""))), open_end)), line(choice(no_delta, F.lit(finish)))]
    spent = line(F.concat(F.lit('"choices":[],'), _members(F.struct(_usage().alias("usage")))))
    wanted = F.lit(False) if usage is None else F.coalesce(usage, F.lit(False))
    end = F.array(F.lit("data: [DONE]\n\n"))
    return F.concat(F.array(*lines), F.when(wanted, F.array(spent)).otherwise(F.array().cast("array<string>")), end)
