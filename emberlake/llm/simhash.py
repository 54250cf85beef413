"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Fingerprints within a radius of r bits share a variant that differs from either
in at most r/2 bits (rounded up). So every distinct fingerprint emits all its
variants within that half, variants meet in a shuffle, and fingerprints that
emit the same one are verified and linked.

The shuffle is keyed by the first bits of the variants: a fingerprint's row goes
to each prefix that some variant of it has, and stands there for all of them;
the task of a prefix spells them out in chunks of bounded size. That moves a
few dozen short rows a fingerprint in place of 2,081 variants. Equal
fingerprints are folded before, so copies cost nothing, and a prefix returns a
spanning forest of its links, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import column, dealt, join_spread, prepare, stage, unstage
from emberlake.llm.near_dedup import components
from emberlake.llm.textkit import slices

WORDS = 4
RADIUS = 4
SEED = 42
SLICE_BYTES = 1_000_000
BUCKET_VARIANTS = 1 << 20  # variants of a prefix, on average
CHUNK_VARIANTS = 1 << 22  # variants spelled out at a time in a task
BUCKET_ROWS = 1 << 21  # fingerprints of a prefix at most, as far as PREFIX_BITS allow
PREFIX_BITS = 32


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The majority bits of the XXH64 hashes of a text's shingles, A-Z lower-cased; 0 without words."""
    own = text.lower().split()  # of bytes: ASCII letters, ASCII white space
    if not own:
        return 0
    joined, size = b" ".join(own), min(words, len(own))
    ends = np.cumsum([len(w) + 1 for w in own])
    starts = (ends - [len(w) + 1 for w in own])[: len(own) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), 1 << 16):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + (1 << 16)], stops[i : i + (1 << 16)])], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def _fingerprinted(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            made = np.array([fingerprint(t or b"", words, seed) for t in part.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(made.view(np.int64))], names=["id", "bits"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, bits): the 64-bit SimHash of each row's whole text, as a signed long.

    A text of fewer than ``words`` words has one shingle of them all; a null or
    empty text, or one of white space, has the fingerprint 0.
    """
    prepare(docs.sparkSession)
    rows = dealt(docs).select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprinted(words, seed), "id long, bits long")


def _flips(bits: int, most: int) -> list[int]:
    """All masks of at most ``most`` bits among the first ``bits`` of 64."""
    return [sum(1 << (63 - i) for i in own) for n in range(min(most, bits) + 1) for own in combinations(range(bits), n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _prefixes(bits: Column, n: int, half: int) -> Column:
    """The first ``n`` bits of every variant of a fingerprint."""
    kept = _signed(((1 << n) - 1) << (64 - n)) if n else 0
    masks = F.array(*[F.lit(_signed(m)) for m in _flips(n, half)])
    return F.transform(masks, lambda m: bits.bitwiseAND(F.lit(kept)).bitwiseXOR(m))


def _variant_counts(left: int, half: int) -> np.ndarray:
    """How many variants remain in ``left`` bits for 0 .. half flips already used."""
    from math import comb

    return np.array([sum(comb(left, k) for k in range(half - used + 1)) for used in range(half + 1)], np.int64)


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least node of each node's component, links (a, b) added to those of ``label``."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, low, high = a[differ], b[differ], np.minimum(x, y)[differ], np.maximum(x, y)[differ]
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]


def meet(own: np.ndarray, used: np.ndarray, moved: np.ndarray, bit: int, radius: int, chunk: int = CHUNK_VARIANTS) -> np.ndarray:
    """Components of fingerprints ``own`` that share a variant of one prefix and are ``radius`` bits apart at most.

    ``moved`` are the fingerprints with their first ``bit`` bits turned into the
    prefix, ``used`` how many flips that took. Where all variants are more than
    ``chunk``, the next bit splits them into two prefixes, one after the other.
    """
    half, label = (radius + 1) // 2, np.arange(len(own))
    todo = [(np.arange(len(own)), moved, used, bit)]
    while todo:
        index, at, flips, depth = todo.pop()
        counts = _variant_counts(64 - depth, half)[flips]
        if depth < 64 and counts.sum() > chunk:
            mask = np.uint64(1 << (63 - depth))
            one = (at & mask) != 0
            for side in (one, ~one):
                far = flips < half
                pick = np.concatenate([np.flatnonzero(side), np.flatnonzero(~side & far)])
                turned = np.where(side[pick], at[pick], at[pick] ^ mask)
                todo.append((index[pick], turned, flips[pick] + ~side[pick], depth + 1))
            continue
        values, owners = [], []
        for k in range(half + 1):
            group = np.flatnonzero(flips == k)
            masks = np.array([m >> depth for m in _flips(64 - depth, half - k)], np.uint64)
            values.append((at[group][:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(index[group], len(masks)))
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(value)
        value, owner = value[order], owner[order]
        same = np.flatnonzero(value[1:] == value[:-1])
        a, b = owner[same], owner[same + 1]
        near = np.bitwise_count(own[a] ^ own[b]) <= radius
        label = forest(len(own), a[near], b[near], label)
    return label


def _met(bits: int, radius: int):
    half = (radius + 1) // 2

    def run(rows: pa.Table) -> pa.Table:
        own = rows.column("bits").to_numpy().view(np.uint64)
        first = np.uint64(((1 << bits) - 1) << (64 - bits))
        prefix = rows.column("prefix").to_numpy().view(np.uint64)
        moved = (own & ~first) | prefix
        label = meet(own, np.bitwise_count(own ^ moved).astype(np.int64), moved, bits, radius)
        tied = np.flatnonzero(label != np.arange(len(own)))
        return pa.Table.from_arrays([pa.array(own[tied].view(np.int64)), pa.array(own[label[tied]].view(np.int64))], names=["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all of the ``distinct`` fingerprints (bits) within ``radius`` bits, directly or over others."""
    half, total = (radius + 1) // 2, distinct.count()
    n = min(PREFIX_BITS, max(0, (total * int(_variant_counts(64, half)[0]) // BUCKET_VARIANTS).bit_length()))

    def largest(bits: int) -> int:
        return distinct.groupBy(F.shiftrightunsigned("bits", 64 - bits)).count().agg(F.max("count")).first()[0] or 0

    while 0 < n < PREFIX_BITS and largest(n) > BUCKET_ROWS:  # many alike: longer prefixes
        n = min(PREFIX_BITS, n + 4)
    rows = distinct.select("bits", F.explode(_prefixes(F.col("bits"), n, half)).alias("prefix"))
    return rows.groupBy("prefix").applyInArrow(_met(n, radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` with an id: ``id`` (cast to long), ``bits`` and ``component``.

    Two texts are linked if their fingerprints differ in ``radius`` bits at
    most, texts without words (null ones too) by their fingerprint 0 like any
    other; ``component`` is the least id that links reach. Repeated rows stay;
    rows of one id with different texts are linked by their id's own
    fingerprints only where those are near. Null ids get no row; an empty table
    gives none. No link is lost whatever the number of copies. The result is
    staged; what led to it is deleted.
    """
    made = stage(fingerprints(docs.where(column(id_col).isNotNull()), id_col, text_col, words, seed), "fingerprints")
    least = stage(made.groupBy("bits").agg(F.min("id").alias("least")), "distinct")
    # Nodes are fingerprints, numbered in no order; their components take the least id of their members.
    found = stage(links(least.select("bits"), radius), "links")
    roots = components(found)
    grouped = least.join(roots.select(F.col("id").alias("bits"), "root"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    grouped = stage(grouped, "grouped")
    firsts = grouped.groupBy("root").agg(F.min("least").alias("component"))
    named = stage(join_spread(grouped, firsts, "root").select("bits", "component"), "named")
    out = stage(join_spread(made, named, "bits").select("id", "bits", "component"), "components")
    unstage(made, least, found, roots, grouped, named)
    return out
