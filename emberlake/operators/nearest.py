"""Exact nearest rows by dot product: a stated query set against all rows, in blocks.

A set of rows of checked size (the exemplars of a policy) is one broadcast
matrix that meets the queries where they are. Larger sets and queries are dealt
into blocks; each pair of blocks is one group, whose similarities are one matrix
product. Only the k best of each block leave it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 8_192
BROADCAST_BYTES = 16 << 20
STRIDE = 32  # rows in a group whose largest similarity bounds the k best from below


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _block(k: int, floor: float | None, skip_self: bool):
    """The k best rows of each query; a column ``least`` of the queries says from where on they are wanted (-inf: all)."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q_out, r_out, s_out = [], [], []
        if queries.num_rows and rows.num_rows:
            a, b = _matrix(queries.column("v")), _matrix(rows.column("v"))
            q_ids, r_ids = queries.column("qid").to_numpy(), rows.column("rid").to_numpy()
            wanted = queries.column("least").to_numpy() if "least" in queries.column_names else np.full(len(a), -np.inf)
            by_id = np.argsort(r_ids, kind="stable")
            sorted_ids = r_ids[by_id]
            for i in range(0, len(a), 256):
                sims = a[i : i + 256] @ b.T
                if skip_self:
                    first, last = (np.searchsorted(sorted_ids, q_ids[i : i + 256], side) for side in ("left", "right"))
                    for j in np.flatnonzero(first < last):
                        sims[j, by_id[first[j] : last[j]]] = -np.inf
                least = wanted[i : i + 256] - 2e-9
                n = len(b) // STRIDE
                if n >= k and np.isneginf(least).any():  # of k groups' largest each reaches the k-th of them, so k rows do; rounding keeps the order
                    tops = sims[:, : n * STRIDE].reshape(len(sims), STRIDE, n).max(axis=1)
                    least = np.maximum(least, np.partition(tops, n - k, axis=1)[:, n - k] - 2e-9)
                if floor is not None:
                    least = np.maximum(least, floor - 2e-9)
                of, found = np.divmod(np.flatnonzero(sims >= least[:, None]), len(b))
                starts = np.searchsorted(of, np.arange(len(sims) + 1))
                for j in np.flatnonzero(starts[:-1] < starts[1:]):
                    at = found[starts[j] : starts[j + 1]]
                    if skip_self:
                        at = at[r_ids[at] != q_ids[i + j]]
                    own = np.round(sims[j, at], 9)
                    if floor is not None:
                        at, own = at[own >= floor], own[own >= floor]
                    best = np.lexsort((r_ids[at], -own))[:k]
                    at, own = at[best], own[best]
                    q_out.append(np.full(len(at), q_ids[i + j]))
                    r_out.append(r_ids[at])
                    s_out.append(own)
        join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        return pa.Table.from_arrays([join(q_out, pa.int64()), join(r_out, pa.int64()), join(s_out, pa.float64())], names=["qid", "rid", "similarity"])

    return run


def _against(rows: pa.Table, search):
    """Batches of queries against rows held whole, each length of vectors by itself."""
    sizes = rows.column("__dim").to_numpy()
    held = {int(n): rows.filter(pa.array(sizes == n)) for n in np.unique(sizes)}

    def run(batches):
        for batch in batches:
            own = batch.column("__dim").to_numpy()
            for n in np.unique(own):
                if int(n) in held:
                    yield from search(pa.Table.from_batches([batch.filter(pa.array(own == n))]), held[int(n)]).to_batches()

    return run


def nearest(
    queries: DataFrame, rows: DataFrame, k: int, floor: float | None = None, skip_self: bool = False, on: Sequence[str] = ()
) -> DataFrame:
    """For each query (qid, v) its ``k`` rows (rid, v) of largest dot product: qid, rid, similarity, rank.

    ``floor`` is inclusive; ``on`` names columns both sides must share (scope,
    domain), applied before the search. Similarities are rounded to nine
    places, ties go to the smaller ``rid``. Vectors must be valid and of one
    length within ``on`` and their own length.
    """
    columns = [F.col(c) for c in on]
    shape = lambda name: [F.col(name).cast("long").alias(name), F.col("v").cast("array<double>").alias("v"), F.size("v").alias("__dim"), *columns]
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("v") * 8 + 8), F.lit(0))).first()
    best = Window.partitionBy("qid").orderBy(F.desc("similarity"), "rid")
    schema = "qid long, rid long, similarity double"
    if not on and n_bytes <= BROADCAST_BYTES:
        found = queries.select(*shape("qid")).mapInArrow(_against(rows.select(*shape("rid")).toArrow(), _block(k, floor, skip_self)), schema)
        return found.withColumn("rank", F.row_number().over(best))
    n_queries = queries.count()
    blocks, parts = -(-n_rows // BLOCK_ROWS) or 1, -(-n_queries // BLOCK_ROWS) or 1
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(*shape("qid")).withColumn("__q", deal("qid", parts)).withColumn("__r", every(blocks))
    right = rows.select(*shape("rid")).withColumn("__r", deal("rid", blocks)).withColumn("__q", every(parts))
    keys = ["__dim", "__q", "__r", *on]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block(k, floor, skip_self), schema)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

