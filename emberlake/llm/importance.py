"""Quality selection by importance resampling.

Two generative models over hashed word n-grams (one and two words), one of
target text and one of raw text, give each document the log of their ratio.
Adding Gumbel noise from the id's hash and taking the k largest draws k
documents without replacement, in proportion to their importance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import dealt, prepare, stage, unit_hash, unstage
from emberlake.llm.textkit import mix64, slices, word_hashes

BUCKETS = 1 << 15
SMOOTHING = 1.0
KEEP = 0.8


def ngram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of all texts, and the index of each one's text."""
    words, at = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    joined = mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) else words
    inside = owner[:-1] == owner[1:]
    both = np.concatenate([words, joined[inside]]) % np.uint64(BUCKETS)
    return both.astype(np.int64), np.concatenate([owner, owner[:-1][inside]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, raw, target): n-grams of all rows of a partition, and of those marked as target."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for part in slices(batches, "text"):
        buckets, owner = ngram_buckets(part.column("text").to_pylist())
        raw += np.bincount(buckets, minlength=BUCKETS)
        chosen = part.column("wanted").to_numpy(zero_copy_only=False)
        if chosen.any():
            target += np.bincount(buckets[chosen[owner]], minlength=BUCKETS)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])


def _scorer(log_ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            buckets, owner = ngram_buckets(texts)
            total = np.bincount(owner, log_ratio[buckets], len(texts)).astype(np.float64)
            n = np.bincount(owner, minlength=len(texts))
            columns = [part.column("id"), pa.array(n), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_grams", "log_ratio"])

    return run


def kth_largest(rows: DataFrame, name: str, k: int) -> float | None:
    """The exact k-th largest value of a double column without a global sort.

    The value's ordered bits are fixed 16 at a time by histograms of at most
    65,536 rows; four passes over a narrow staged table.
    """
    if k <= 0:
        return None
    pack = lambda b: np.where(b >= 0, b, ~b ^ np.int64(-(2**63)))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pack(bits))], names=["bits"])

    bits = stage(rows.select(name).mapInArrow(ordered, "bits long"), "bits")
    prefix, shift, left = None, 48, k
    while True:
        held = bits if prefix is None else bits.where(F.shiftright("bits", shift + 16) == prefix)
        steps = held.groupBy(F.shiftright("bits", shift).alias("step")).count().orderBy(F.desc("step")).collect()
        for row in steps:
            if row["count"] >= left:
                prefix = row["step"]
                break
            left -= row["count"]
        else:
            unstage(bits)
            return None
        if shift == 0:
            unstage(bits)
            return float(pack(np.array([prefix], np.int64)).view(np.float64)[0])
        shift -= 16


def importance_weights(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log importance of each document: ``id`` (cast to long), ``n_grams``, ``log_ratio``.

    ``targets`` has the ids of target documents; both models are fitted on all
    of their rows. Texts that are null or have no words get 0, as does every
    text where there are no targets with words. Null ids are scored and are no
    targets; repeated rows are rows. Counts are summed by bucket, so the models
    have a fixed size.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wanted = targets.select(F.col(id_col).cast("long").alias("id"), F.lit(True).alias("wanted")).where("id is not null").distinct()
    # One plan at every size: texts are shuffled once, targets are never broadcast, as they grow with the documents.
    marked = rows.join(wanted.hint("merge"), "id", "left").select("text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    counts = dealt(marked).mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for row in counts.collect():  # at most BUCKETS rows
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    if target.sum() == SMOOTHING * BUCKETS:  # nothing to tell
        ratio = np.zeros(BUCKETS)
    return dealt(rows).mapInArrow(_scorer(ratio), "id long, n_grams long, log_ratio double")


def resample(docs: DataFrame, targets: DataFrame, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> DataFrame:
    """Draw a share ``keep`` of the documents by importance: one row per document with ``selected``.

    The log weight is the log of the models' ratio for the whole text.
    ``gumbel_key`` is the log weight plus Gumbel noise from the id's hash; the
    largest keys are selected. Rows that tie at the limit (repeated rows) are
    selected together. Reruns give the same draw. An empty table gives no rows.
    """
    weights = importance_weights(docs, targets, id_col, text_col)
    noise = -F.log(-F.log((unit_hash(seed, "id") + F.lit(2.0**-54))))
    scored = stage(
        weights.withColumn("log_weight", F.col("log_ratio")).withColumn("gumbel_key", F.col("log_weight") + noise),
        "weights",
    )
    limit = kth_largest(scored, "gumbel_key", round(keep * scored.count()))
    selected = F.lit(False) if limit is None else F.col("gumbel_key") >= F.lit(limit)
    return scored.withColumn("selected", selected)
