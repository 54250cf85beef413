"""Embeddings from an endpoint: texts dealt into batches, replies checked and put in order as column functions.

Python only carries texts out and replies back, one row a request; what a reply
holds is read and judged inside Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.functions import vectors
from emberlake.operators.seams import BATCH, call_with_retries

Post = Callable[[Sequence[str]], str]

# What goes before a query and before a document, by the model's style.
PREFIXES = {"none": ("", ""), "e5": ("query: ", "passage: ")}

REPLY = "error struct<message: string>, data array<struct<index: string, embedding: array<double>>>"


class ListRefused(Exception):
    """The endpoint takes no list of texts: each has to be sent alone."""


def read_reply(reply: Column, expected: Column) -> Column:
    """A reply to ``expected`` texts as (problem, vectors): its vectors in the order of the texts, or what is wrong.

    An item's ``index`` says which text it answers; without one (or with null) its place
    does. The first problem that holds is told: ``no_reply`` (null),
    ``not_json``, ``endpoint_error``, ``wrong_count``, ``bad_index`` (no whole
    number below the count), ``no_vector``, ``repeated_index``,
    ``mixed_dimensions``, ``not_finite``, ``zero_vector``. One bad item spoils
    its reply, because its neighbours can no longer be trusted to be in place.
    """

    def judge(body: Column) -> Column:
        items = F.transform(body["data"], lambda x, i: F.struct(F.coalesce(x["index"], i.cast("string")).alias("index"), x["embedding"].alias("v")))
        return _bind(items, lambda own: _judged(own, body, reply, expected))

    return _bind(F.from_json(reply, REPLY), judge)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.transform(F.array(value), use)[0]


def _judged(items: Column, body: Column, reply: Column, expected: Column) -> Column:
    vector_of = lambda x: x["v"]
    place = lambda x: x["index"].try_cast("int")
    in_range = lambda x: F.coalesce(x["index"].rlike("^[0-9]+$") & (place(x) < expected), F.lit(False))
    empty = lambda x: F.coalesce(F.size(x["v"]), F.lit(0)) <= 0
    holed = lambda x: F.exists(x["v"], lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    problem = (
        F.when(reply.isNull(), "no_reply")
        .when(body.isNull() | (body["error"].isNull() & body["data"].isNull()), "not_json")
        .when(body["error"].isNotNull(), "endpoint_error")
        .when(F.size(items) != expected, "wrong_count")
        .when(F.exists(items, lambda x: ~in_range(x)), "bad_index")
        .when(F.exists(items, empty), "no_vector")
        .when(F.size(F.array_distinct(F.transform(items, place))) < expected, "repeated_index")
        .when(F.size(F.array_distinct(F.transform(items, lambda x: F.size(x["v"])))) > 1, "mixed_dimensions")
        .when(F.exists(items, holed), "not_finite")
        .when(F.exists(items, lambda x: ~vectors.valid(x["v"])), "zero_vector")
    )
    ordered = F.transform(F.array_sort(F.transform(items, lambda x: F.struct(place(x).alias("place"), x["v"].alias("v")))), vector_of)
    return F.struct(problem.alias("problem"), F.when(problem.isNull(), ordered).alias("vectors"))


def read_replies(replies: DataFrame, texts: str, reply: str) -> DataFrame:
    """Rows of one request each (an array of texts, the reply) as one row a text.

    All other columns stay; ``slot`` is the text's place from 0, ``text`` the
    text, ``vector`` its unit vector or null, ``problem`` why it has none.
    A request without texts gives no row. Columns of these names are replaced.
    """
    rows = replies.withColumn("__read", read_reply(F.col(reply), F.size(texts)))
    left = [c for c in replies.columns if c not in (texts, reply, "slot", "text", "vector", "problem")]
    spread = rows.select(*[F.col(f"`{c.replace('`', '``')}`") for c in left], "__read", F.posexplode(texts).alias("slot", "text"))
    raw = F.col("__read.vectors")[F.col("slot")]
    return spread.withColumns({"vector": vectors.normalised(raw), "problem": F.col("__read.problem")}).drop("__read")


def embed(rows: DataFrame, text: str, post: Post, role: str = "document", style: str = "none", batch: int = BATCH) -> DataFrame:
    """``rows`` with ``vector`` (a unit vector or null) and ``problem`` from an endpoint.

    Each distinct text is sent once, with the prefix of its role, in batches of
    at most ``batch``. ``post`` answers a list of texts with the reply's JSON; transient
    errors are tried again. An endpoint that raises ``ListRefused`` is sent single
    texts from then on by that task. Any other failure gives its batch ``no_reply``. Null texts
    are not sent and have the problem ``no_text``. Empty tables give empty tables.
    """
    if style not in PREFIXES or role not in ("query", "document"):
        raise ValueError(f"unknown style {style!r} or role {role!r}")
    before = PREFIXES[style][role == "document"]
    schema = T.StructType([T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("reply", T.StringType())])

    def ask(texts: list[str]) -> str | None:
        try:
            return call_with_retries(post, [before + t for t in texts])
        except ListRefused:
            raise
        except Exception:
            return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = batch
        for part in parts:
            texts, asked, at = part["__text"].tolist(), [], 0
            while at < len(texts):
                own = texts[at : at + size]
                try:
                    asked.append((own, ask(own)))
                    at += len(own)
                except ListRefused:
                    if size == 1:
                        asked.append((own, None))
                        at += 1
                    size = 1
            yield pd.DataFrame(asked, columns=["texts", "reply"])

    given = F.col(f"`{text.replace('`', '``')}`")
    distinct = rows.select(given.alias("__text")).where("__text is not null").distinct()
    read = read_replies(distinct.mapInPandas(run, schema), "texts", "reply")
    found = read.select(F.col("text").alias("__text"), F.col("vector").alias("__vector"), F.col("problem").alias("__problem"))
    keep = [F.col(f"`{c.replace('`', '``')}`") for c in rows.columns if c not in ("vector", "problem")]
    joined = rows.select(*keep, given.alias("__own")).join(found, F.col("__own") == F.col("__text"), "left")
    problem = F.when(F.col("__own").isNull(), "no_text").otherwise(F.col("__problem"))
    return joined.withColumns({"vector": F.col("__vector"), "problem": problem}).drop("__own", "__text", "__vector", "__problem")
