"""Approximate nearest neighbours by a forest of hash prefixes.

Vectors are dealt into blocks of at most about ``BLOCK_ROWS`` rows. A block's
index is a forest: per tree, the sorted array of the rows' long hash strings
(64 sign bits of random projections). A query finds the entries that share its
longest prefix in every tree, then goes up all trees together, one bit at a
time, until enough candidates are met. Candidates are compared exactly, in
double precision, and the blocks' answers are merged per query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlake.llm.common import stage

BITS = 64


class PrefixForest:
    """Sorted arrays of hash strings, one per tree, over the rows of a matrix."""

    def __init__(self, unit: np.ndarray, trees: int, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.planes = draw.standard_normal((trees, unit.shape[1], BITS)).astype(np.float32)
        self.order, self.keys = [], []
        for t in range(trees):
            keys = self.hash(unit, t)
            order = np.argsort(keys, kind="stable")
            self.order.append(order.astype(np.int32))
            self.keys.append(keys[order])

    def hash(self, unit: np.ndarray, tree: int) -> np.ndarray:
        bits = unit.astype(np.float32) @ self.planes[tree] > 0
        return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)

    def ranges(self, unit: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query, the entries with the longest common prefix length at
        which all trees together hold ``enough`` candidates (or every row)."""
        trees, n = len(self.keys), len(unit)
        keys = [self.hash(unit, t) for t in range(trees)]
        low = np.zeros((trees, n), np.int64)
        high = np.full((trees, n), len(self.order[0]), np.int64)
        open_ = np.arange(n)
        for length in range(BITS, 0, -1):
            rest = np.uint64((1 << (BITS - length)) - 1)
            lo = np.stack([np.searchsorted(self.keys[t], keys[t][open_] & ~rest) for t in range(trees)])
            hi = np.stack([np.searchsorted(self.keys[t], keys[t][open_] | rest, side="right") for t in range(trees)])
            full = (hi - lo).sum(axis=0) >= enough
            low[:, open_[full]], high[:, open_[full]] = lo[:, full], hi[:, full]
            open_ = open_[~full]
            if not len(open_):
                break
        return low, high

    def candidates(self, low: np.ndarray, high: np.ndarray, query: int) -> np.ndarray:
        seen = np.zeros(len(self.order[0]), dtype=bool)
        for t, order in enumerate(self.order):
            seen[order[low[t, query] : high[t, query]]] = True
        return np.flatnonzero(seen)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _search(trees: int, share: float, k: int, seed: int):
    names = ["query_id", "vec_id", "score"]
    types = [pa.int64(), pa.int64(), pa.float64()]

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            base, ids = _matrix(rows.column("v")), rows.column("id").to_numpy()
            asked, asked_ids = _matrix(queries.column("v")), queries.column("id").to_numpy()
            norms = np.sqrt((base * base).sum(axis=1))
            asked_norms = np.sqrt((asked * asked).sum(axis=1))
            unit = base / norms[:, None]
            forest = PrefixForest(unit, trees, seed)
            enough = trees * max(4 * k, math.ceil(share * len(ids)))
            low, high = forest.ranges(asked / asked_norms[:, None], enough)
            for q in range(len(asked)):
                found = forest.candidates(low, high, q)
                found = found[ids[found] != asked_ids[q]]
                score = (base[found] * asked[q]).sum(axis=1) / (norms[found] * asked_norms[q])
                if len(found) > k:  # all that tie with the k-th stay until the ids decide
                    kept = score >= np.partition(score, len(score) - k)[len(score) - k]
                    found, score = found[kept], score[kept]
                best = np.lexsort((ids[found], -score))[:k]
                out[0].append(np.full(len(best), asked_ids[q]))
                out[1].append(ids[found[best]])
                out[2].append(score[best])
        columns = [pa.array(np.concatenate(c) if c else np.zeros(0), t) for c, t in zip(out, types)]
        return pa.Table.from_arrays(columns, names=names)

    return run


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    base: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    trees: int = 12,
    share: float = 0.08,
    block_rows: int = 16_384,
    query_rows: int = 4_096,
    seed: int = 5,
) -> DataFrame:
    """The ``k`` nearest rows of ``base`` by cosine for each row of ``queries``.

    A query goes up the trees until they hold ``share`` of a block's rows on
    average, so ``share`` trades time for recall. Returns ``query_id``,
    ``rank`` from 1, ``vec_id`` and ``score``; ties go to the smaller id; a
    row with the query's own id is no candidate. Vectors that are null, zero
    or hold null or non-finite components take no part, nor do null ids; only
    vectors of the same length are compared. A repeated id counts once per row
    of ``base`` and once as a query. Every row is indexed.
    """
    row = lambda df: df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & usable(F.col("v"))
    ).withColumn("dim", F.size("v"))
    base, asked = row(base), stage(row(queries).dropDuplicates(["id"]), "queries")
    blocks = max(1, -(-base.count() // block_rows))
    asked_blocks = max(1, -(-asked.count() // query_rows))
    spread = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.withColumn("block", spread(blocks, 1)).withColumn("part", every(asked_blocks))
    right = asked.withColumn("part", spread(asked_blocks, 2)).withColumn("block", every(blocks))
    keys = ["dim", "block", "part"]
    found = (
        left.groupBy(*keys).cogroup(right.groupBy(*keys))
        .applyInArrow(_search(trees, share, k, seed), "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
