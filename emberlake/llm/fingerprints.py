"""Document fingerprints by consistent weighted sampling.

Terms are five-word shingles, weighted by how often a text holds them. For each
of ``SAMPLES`` samples a term draws r and c from Gamma(2, 1) and b from the
uniform distribution, all from its hash; the text's sample is the term (and
weight level t) with the least ln c - r (t - b + 1), t = floor(ln w / r + b).
Two texts share a sample with a probability equal to their generalised Jaccard
similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.llm.common import prepare, unit_hash, with_texts
from emberlake.llm.textkit import mix64, shingle_hashes

SAMPLES = 64
SHINGLE = 5
BLOCK = 2048
SLICE_BYTES = 256 << 20
SAMPLES_PER_SLICE = 16


def _gamma_quantiles(levels: int = 65_536) -> np.ndarray:
    """Midpoint quantiles of Gamma(2, 1), by Newton's method on 1 - (1 + x) exp(-x)."""
    p = (np.arange(levels) + 0.5) / levels
    x = np.where(p < 0.2, np.sqrt(2 * p), -np.log1p(-p) + 1)
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), x / 8)
    return x


_GAMMA = _gamma_quantiles().astype(np.float32)
_LOG_GAMMA = np.log(_gamma_quantiles()).astype(np.float32)
_SEEDS = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _lanes(terms: np.ndarray) -> np.ndarray:
    """Four 16-bit random numbers for every sample and term: (samples, terms, 4)."""
    x = (terms[None, :] ^ _SEEDS[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x.view(np.uint16).reshape(len(_SEEDS), len(terms), 4)


def _unit_weight(terms: np.ndarray) -> np.ndarray:
    """ln a of every sample and term at weight 1, where t is 0."""
    out = np.empty((SAMPLES, len(terms)), np.float32)
    for i in range(0, len(terms), BLOCK):
        lane = _lanes(terms[i : i + BLOCK])
        rest = np.float32(1) - (lane[:, :, 2].astype(np.float32) + np.float32(0.5)) / np.float32(65_536)
        out[:, i : i + BLOCK] = _LOG_GAMMA[lane[:, :, 0]] - _GAMMA[lane[:, :, 1]] * rest
    return out


def _weighted(terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln a and t of every sample and term at the given weights."""
    lane = _lanes(terms)
    r = _GAMMA[lane[:, :, 1]]
    b = (lane[:, :, 2].astype(np.float32) + np.float32(0.5)) / np.float32(65_536)
    t = np.floor(np.log(weights.astype(np.float32)) / r + b)
    return _LOG_GAMMA[lane[:, :, 0]] - r * (t - b + 1), t.astype(np.int64)


def sample_texts(texts: list[str | None]) -> np.ndarray:
    """Signatures of texts: (texts, SAMPLES) 32-bit values; all zeros for a text without words."""
    shingles, at = shingle_hashes(texts, SHINGLE)
    terms, index = np.unique(shingles, return_inverse=True)
    base = _unit_weight(terms)
    labels = (mix64(terms) >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    out = np.zeros((len(texts), SAMPLES), np.uint32)
    every = np.arange(SAMPLES)
    for i in range(len(texts)):
        own = index[at[i] : at[i + 1]]
        if not len(own):
            continue
        own, weights = np.unique(own, return_counts=True)
        values = base[:, own]
        heavy = np.flatnonzero(weights > 1)
        level = None
        if len(heavy):
            values[:, heavy], level = _weighted(terms[own[heavy]], weights[heavy])
        best = values.argmin(axis=1)
        signature = labels[own[best]]
        if level is not None:
            where = np.searchsorted(heavy, best)
            where[where == len(heavy)] = 0
            t = np.where(heavy[where] == best, level[every, where], 0)
            signature = np.where(t != 0, (mix64(signature.astype(np.uint64) ^ (t.astype(np.uint64) << np.uint64(32))) >> np.uint64(33)).astype(np.uint32) + np.uint32(1), signature)
        out[i] = signature
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples, row by row: an estimate of generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def to_hex(signatures: np.ndarray) -> list[str]:
    return [row.astype(">u4").tobytes().hex() for row in signatures]


def edited_text(text: str | None, following: str | None) -> str:
    """``text`` with its last third of code points replaced by as many first ones of ``following``."""
    text, following = text or "", following or ""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with a fingerprint column (hex of ``SAMPLES`` 32-bit samples).

    A null text counts as empty; texts without words have the fingerprint of
    zeros. Equal texts have equal fingerprints. A column called ``name`` is
    replaced; all others stay.
    """
    return with_texts(docs, text_col, lambda texts: [pa.array(to_hex(sample_texts(texts)), pa.string())], **{name: T.StringType()})


def _slice_heads(rows: DataFrame, slice_bytes: int) -> np.ndarray:
    """The largest id of each slice, in ascending order: quantiles of sampled ids and the largest id of all.

    Slices are as many as ``slice_bytes`` go into the texts, and at least the
    shuffle partitions. Only the sample reaches the driver: ``SAMPLES_PER_SLICE``
    ids for a slice, 128 bytes for 256 MB of text.
    """
    size, n, top = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("id"), F.max("id")).first()
    if top is None:
        return np.zeros(0, np.int64)
    wanted = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // slice_bytes))
    drawn = rows.where(unit_hash(17, "id") < SAMPLES_PER_SLICE * wanted / n).select("id").toArrow().column("id").to_numpy()
    drawn = np.sort(np.unique(drawn))
    marks = drawn[(np.arange(1, wanted) * len(drawn)) // wanted] if len(drawn) else drawn
    return np.unique(np.append(marks, top))


def _dealt_descending(docs: DataFrame, id_col: str, text_col: str, slice_bytes: int) -> DataFrame:
    """Rows (id, text, part, ahead) in slices of descending ids, each slice followed by the
    first row of the next one (``ahead``), the last by the first of all."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    heads = _slice_heads(rows, slice_bytes)
    n = max(1, len(heads))
    held = rows.sparkSession.sparkContext.broadcast(heads)  # 8 bytes a slice

    @F.pandas_udf("struct<part: int, leads: boolean>")
    def place_of(ids: pd.Series) -> pd.DataFrame:
        known = held.value
        if not len(known):
            return pd.DataFrame({"part": np.zeros(len(ids), np.int32), "leads": np.ones(len(ids), bool)})
        empty = ids.isna().to_numpy()
        own = ids.fillna(0).to_numpy(np.int64)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        part = np.where(empty, len(known) - 1, len(known) - 1 - at)  # null ids come last
        return pd.DataFrame({"part": part.astype(np.int32), "leads": ~empty & (known[at] == own)})

    rows = rows.withColumn("at", place_of("id"))
    place = lambda p, ahead: F.struct(p.cast("int").alias("part"), F.lit(ahead).alias("ahead"))
    own = place(F.col("at.part"), False)
    before = place(F.pmod(F.col("at.part") - 1, F.lit(n)), True)
    places = F.when(F.col("at.leads"), F.array(own, before)).otherwise(F.array(own))
    return (
        rows.select("id", "text", F.explode(places).alias("place"))
        .select("id", "text", "place.part", "place.ahead")
        .repartitionById(n, "part")
        .sortWithinPartitions("part", "ahead", F.desc_nulls_last("id"), F.xxhash64("text"))
    )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, str]]:
    """(id, text, next text) for every row that is not ahead, in order of part and id.

    Of the rows ahead only the first of a part counts.
    """
    held = None  # part, id, text
    for batch in batches:
        columns = [batch.column(c) for c in ("id", "text", "part", "ahead")]
        for i in range(len(batch)):
            row_id, text, part, ahead = (c[i].as_py() for c in columns)
            if held is not None and held[0] == part:
                yield held[1], held[2], text
                held = None
            if not ahead:
                held = (part, row_id, text)
    if held is not None:  # cannot happen: every part has a row ahead
        yield held[1], held[2], held[2]


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are.

    The next document is the one of the next smaller id (after the smallest,
    the largest); rows of one id follow in the order of their text's hash, null
    ids come last. Returns ``id``, ``text``, ``edited``, both fingerprints,
    ``near_edited`` and ``near_next`` (to the next document's fingerprint). A
    null text counts as empty. A table of one row is its own next. Text is
    shuffled once, in slices of ids.
    """
    prepare(docs.sparkSession)
    dealt = _dealt_descending(docs, id_col, text_col, slice_bytes)
    schema = "id long, text string, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def flush(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
        ids, texts, following = ([r[i] for r in rows] for i in range(3))
        edited = [edited_text(a, b) for a, b in zip(texts, following)]
        made = sample_texts([*texts, *edited, following[-1]])
        n = len(rows)
        own, other = made[:n], made[n : 2 * n]
        nxt = np.concatenate([own[1:], made[2 * n :]])
        gap = [i for i in range(n - 1) if following[i] != texts[i + 1]]  # where a part ends
        if gap:
            nxt[gap] = sample_texts([following[i] for i in gap])
        columns = [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(edited, pa.string()), pa.array(to_hex(own), pa.string()), pa.array(to_hex(other), pa.string())]
        columns += [pa.array(likeness(own, other)), pa.array(likeness(own, nxt))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for row in _pairs(batches):
            rows.append(row)
            chars += len(row[1])
            if chars > 150_000 or len(rows) >= 2048:
                yield flush(rows)
                rows, chars = [], 0
        if rows:
            yield flush(rows)

    return dealt.mapInArrow(run, schema)
