"""Where models plug in: embedders, extractors, judges and translators as memoised batch functions.

A model is a Python callable on a batch of texts. It sees each distinct text
once; results are joined back. Failures are null, never a default value.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.sources.tables import delete, fits_broadcast, numbered, staged, unstage

BATCH = 64

Model = Callable[[Sequence[str]], Sequence[object]]


def call_with_retries(model: Model, texts: Sequence[str], retries: int = 2, base: float = 0.2, retry_on: tuple[type[Exception], ...] = (TimeoutError, ConnectionError)):
    """Call a batch function, waiting base, 2 base, 4 base, ... between tries on transient errors."""
    for attempt in range(retries + 1):
        try:
            return model(texts)
        except retry_on:
            if attempt == retries:
                raise
            time.sleep(base * 2**attempt)


def _text_key(text: str) -> Column:
    """The SHA-256 of a text, null for null: texts meet by it, so joins shuffle 32 bytes in place of a text."""
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def _answers(texts: DataFrame, out: str, kind: T.DataType, model: Model, batch: int = BATCH) -> DataFrame:
    """(__key, ``out``) of distinct (__key, __text) rows from the model, in batches; a failed batch is tried text by text."""
    schema = T.StructType([T.StructField("__key", T.BinaryType()), T.StructField(out, kind)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, made = part["__text"].tolist(), []
            for i in range(0, len(texts), batch):
                own = texts[i : i + batch]
                try:
                    got = list(call_with_retries(model, own))
                    if len(got) != len(own):
                        raise ValueError("a model must answer every text")
                except Exception:
                    got = []
                    for t in own:
                        try:
                            got.append(call_with_retries(model, [t])[0])
                        except Exception:
                            got.append(None)
                made += got
            yield pd.DataFrame({"__key": part["__key"], out: pd.Series(made, dtype=object)})

    return texts.mapInPandas(run, schema)


def apply_model(rows: DataFrame, text: str, out: str, kind: T.DataType, model: Model, batch: int = BATCH) -> DataFrame:
    """``rows`` with ``out`` from the model, which runs once for each distinct text, in batches.

    A batch that fails is tried text by text, so one bad text leaves the others
    their results. A null text gives null and is not sent.
    """
    keyed = rows.withColumn("__key", _text_key(text))
    distinct = keyed.where(F.col("__key").isNotNull()).select("__key", F.col(text).alias("__text")).distinct()
    return keyed.join(_answers(distinct, out, kind, model, batch), "__key", "left").drop("__key")


class Memo:
    """What a model answered, kept in a folder: a text that was answered within ``ttl`` seconds is not sent again.

    Answers are kept by their text's SHA-256 and appended, one short batch a call that had
    new ones; failures (null) are not kept, empty lists are. Of several answers to a text the newest counts.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: T.DataType, ttl: int = 3_600) -> None:
        self.spark, self.folder, self.ttl = spark, folder.rstrip("/"), ttl
        self.schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("answer", kind), T.StructField("at", T.LongType())])

    def answers(self, now: int) -> DataFrame:
        """(key, answer) of what is fresh at ``now``; an answer is stale from ``ttl`` seconds on."""
        numbers = numbered(self.spark, self.folder, "m")
        if not numbers:
            return self.spark.createDataFrame([], self.schema).drop("at")
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/m{n}" for n in numbers])
        fresh = rows.where(F.col("key").isNotNull() & (F.col("at") > now - self.ttl) & (F.col("at") <= now))
        return fresh.groupBy("key").agg(F.max_by("answer", "at").alias("answer"))

    def apply(self, rows: DataFrame, text: str, out: str, model: Model, now: int) -> tuple[DataFrame, dict[str, int]]:
        """``rows`` with ``out`` from the memo or, for the rest, from the model; and counts of the distinct texts by outcome.

        Keys alone tell what is known; a text is shuffled only on its way to the model.
        """
        keyed = rows.withColumn("__key", _text_key(text))
        texts = keyed.where(F.col("__key").isNotNull()).select("__key", F.col(text).alias("__text"))
        held = self.answers(now)
        known = held.select(F.col("key").alias("__key"), F.lit(True).alias("known"))
        wanted = staged(texts.select("__key").distinct().join(known.hint("merge"), "__key", "left"))  # kept answers grow with the texts: not broadcast
        fresh = staged(wanted.where("known is null").select("__key"))
        n_wanted, n_fresh, n_kept = wanted.count(), fresh.count(), 0
        if n_fresh:
            if n_fresh < n_wanted:
                texts = texts.join(fresh if fits_broadcast(fresh) else fresh.hint("shuffle_hash"), "__key", "left_semi")
            batch = f"{self.folder}/m{(numbered(self.spark, self.folder, 'm') or [0])[-1] + 1}"
            asked = _answers(texts.distinct(), "answer", self.schema["answer"].dataType, model).where("answer is not null")
            asked.select(F.col("__key").alias("key"), "answer", F.lit(now).cast("long").alias("at")).write.mode("overwrite").parquet(batch)
            made = self.spark.read.schema(self.schema).parquet(batch).drop("at")
            n_kept = made.count()
            if n_kept:
                held = held.unionByName(made)
            else:
                delete(self.spark, batch)
        unstage(wanted, fresh)
        joined = keyed.join(held.withColumnsRenamed({"key": "__key", "answer": out}).hint("merge"), "__key", "left").drop("__key")
        return joined, {"memo_hits": n_wanted - n_fresh, "extracted": n_kept, "extractor_errors": n_fresh - n_kept}


def checked_vectors(rows: DataFrame, vector: str, dim: int | None = None) -> DataFrame:
    """Adds ``problem`` to embedded rows: null, wrong length, or not finite; null where the vector is fine."""
    from emberlake.functions.vectors import valid

    v = F.col(vector)
    wrong = F.size(v) != dim if dim is not None else F.lit(False)
    return rows.withColumn("problem", F.when(v.isNull(), "missing").when(wrong, "dimension").when(~valid(v), "malformed"))
