"""Filter interaction audit: what each filter removes in every order of applying them.

A document's failed filters are a mask of five bits. Four of them are column
functions of its text. The fifth, copies, is settled over fingerprint-routed
RDD partitions: texts are routed by their xxhash, each hash keeps a chain of
the different full texts that have it with their least id, and the ids that are
not least come out. A chain is built in the map tasks first, so a text that a
third of all rows share leaves each task once. Masks are counted by ``combineByKey``
into one vector a part; the orders are read off these vectors alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
from pyspark import RDD
from pyspark.rdd import portable_hash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.llm.common import column, prepare, stage, unstage

FILTERS = "ABCDE"
COPY = FILTERS.index("E")
WORD_GAPS = r"[\x20\x09-\x0D]+"
PART_BYTES = 32 << 20  # text that a task's chains hold on average
HELD_BYTES = 32 << 20  # text that a map task holds before it passes its chains on
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def text_failures(text: Column) -> Column:
    """The mask of the filters A to D that a text (not null) fails: bit i for the i-th letter.

    A: under 200 words; B: distinct words are under half of all; C: over 2 % of
    the code points are A-Z; D: one of # $ % & * | occurs.
    """
    words = F.filter(F.split(text, WORD_GAPS), lambda w: w != "")
    bit = lambda test, i: F.when(test, 1 << i).otherwise(0)

    def judged(own: Column) -> Column:
        few = F.size(own) < 200
        poor = 100 * F.size(F.array_distinct(own)) < 50 * F.size(own)
        capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
        return bit(few, 0) + bit(poor, 1) + bit(100 * capitals > 2 * F.length(text), 2) + bit(text.rlike("[#$%&*|]"), 3)

    return F.transform(F.array(words), judged)[0]  # words are bound once a row


class _Chains:
    """Collision chains: for each hash the different full texts that have it, with the least id of each."""

    def __init__(self) -> None:
        self.held, self.bytes = {}, 0

    def add(self, hashed: int, ident, text: str) -> Iterator:
        """Take a text in; gives the id that turns out not to be the least, if there is one."""
        chain = self.held.setdefault(hashed, [])
        for link in chain:
            if link[0] == text:
                if ident != link[1]:
                    yield max(ident, link[1])
                    link[1] = min(ident, link[1])
                return
        chain.append([text, ident])
        self.bytes += 64 + 4 * len(text)

    def texts(self) -> Iterator:
        for hashed, chain in self.held.items():
            for text, ident in chain:
                yield hashed, ident, text


def _folded(rows: Iterator) -> Iterator:
    """(route, (hash, id, text)) of a map task's chains; ids known not to be least go with no text, by a route of their own."""
    chains = _Chains()
    for row in rows:
        for lost in chains.add(row["hash"], row["id"], row["text"]):
            yield portable_hash(lost), (row["hash"], lost, None)
        if chains.bytes > HELD_BYTES:
            for hashed, ident, text in chains.texts():
                yield hashed, (hashed, ident, text)
            chains = _Chains()
    for hashed, ident, text in chains.texts():
        yield hashed, (hashed, ident, text)


def _settled(rows: Iterator) -> Iterator:
    chains = _Chains()
    for _, (hashed, ident, text) in rows:
        if text is None:
            yield ident, hashed
        else:
            for lost in chains.add(hashed, ident, text):
                yield lost, hashed


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", total_bytes: int | None = None) -> DataFrame:
    """(id, hash): ids whose whole text, of that xxhash64, some smaller id has too; each once.

    A null text counts as an empty one. Null ids are neither copies nor
    originals; rows of one id with one text are no copies of each other. Texts
    are compared whole, so equal hashes alone make no copy. Ids must be of a
    type that Python orders, as numbers and strings are.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    rows = docs.where(column(id_col).isNotNull()).select(column(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    if total_bytes is None:
        total_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // PART_BYTES))
    routed: RDD = rows.rdd.mapPartitions(_folded).partitionBy(parts, lambda route: route)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("hash", T.LongType())])
    return docs.sparkSession.createDataFrame(routed.mapPartitions(_settled), schema).distinct()


def _counted(row: tuple) -> np.ndarray:
    return _more(np.zeros((1 << len(FILTERS), 3), np.int64), row)


def _more(vector: np.ndarray, row: tuple) -> np.ndarray:
    vector[row[0]] += (1, row[1], row[2])
    return vector


def _report(part_vector: tuple[str, np.ndarray]) -> Iterator[tuple]:
    """A row for each order and step, from a part's counts of (rows, good, toxic) by mask."""
    part, vector = part_vector
    masks = np.arange(1 << len(FILTERS))
    failed = np.array([bin(m).count("1") for m in masks])
    for order in ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            now = (masks & own != 0) & (masks & before == 0)
            fails = masks & own != 0
            # Of the orders of all filters, one in so many as the mask has bits puts this one first among them.
            shapley = (vector[fails, 0] * (len(ORDERS) // failed[fails])).sum()
            gone = vector[now].sum(axis=0)
            yield (
                part, order, step, int(vector[masks & (before | own) == 0, 0].sum()), int(gone[0]),
                int(vector[fails & (masks & before != 0), 0].sum()), int(vector[own, 0]), int(gone[1]), int(gone[2]), int(shapley),
            )
            before |= own


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What each filter removes, by part and by order of the five filters (``text_failures`` and E: a smaller id has this text).

    One row for every part (null: the empty string), order and step: documents
    ``kept`` after it, ``removed`` by it, ``redundant`` (they fail it but went
    before), ``unique_fails`` (they fail nothing else), labelled good or toxic
    documents lost to it, and ``shapley``: what its filter removes, summed over all orders.

    Every row of ``docs`` counts, repeated ones and those with a null id too
    (which fail E never and have no labels). An id labelled several times is
    good or toxic if one of its labels says so; null labels say nothing. An
    empty table has no parts and gives no rows. Other columns do not matter.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        column(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.coalesce(column(part_col).cast("string"), F.lit("")).alias("part"),
        text_failures(text).alias("mask"), F.octet_length(text).cast("long").alias("bytes"),
    )
    rows = stage(rows, "masks")
    again = stage(copies(docs, id_col, text_col, rows.agg(F.sum("bytes")).first()[0] or 0), "copies")
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("bad"))
    joined = rows.join(again.withColumn("copy", F.lit(1 << COPY)), ["id", "hash"], "left").join(known, "id", "left")
    joined = stage(joined.select("part", (F.col("mask") + F.coalesce("copy", F.lit(0))).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad")), "failures")
    counted = joined.rdd.map(lambda r: (r[0], (r[1], r[2], r[3]))).combineByKey(_counted, _more, lambda a, b: a + b)
    out = stage(docs.sparkSession.createDataFrame(counted.flatMap(_report), REPORT), "audit")
    unstage(rows, again, joined)
    return out
