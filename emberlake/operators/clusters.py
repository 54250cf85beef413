"""Exact nearest rows by a scan that skips what cannot reach the answer.

Rows are dealt to clusters, each with a centre and a radius (the largest angle
between the centre and a member). No member is nearer to a query than the
query's angle to the centre less the radius. So a query first scans the clusters
nearest to it, which gives a k-th best; after that only clusters whose
bound reaches it are scanned. The result is that of a full scan.

Rows and queries are packed into blocks. A task holds a block of queries and lets
all blocks of rows pass by, twice: for the nearest clusters, then for the others.
No row or query is copied for another's sake, so disk grows with the tables,
however many pairs are compared; what is read and compared grows with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlake.operators.nearest import BLOCK_ROWS, _block, _matrix
from emberlake.sources.tables import staged, unstage

MOST_CENTRES = 4_096  # all centres are held in a task: this many times the length of a vector
CHOOSE_ROWS = 256  # queries whose clusters are chosen at once
LEAST_ROWS, TURNS = 64, 4  # queries are dealt into this many blocks for each core, where a block then has so many
BLOCK_BYTES = 8 << 20  # of the vectors of a block
ROUNDS = 2  # of moving centres to the mean of their members
SLACK = 1e-6  # radians: angles are taken from rounded products


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _sums(centres: np.ndarray):
    """A row for each cluster and task: the sum of its members there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(centres)
        for batch in batches:
            v = _matrix(pa.chunked_array([batch.column("v")]))
            np.add.at(total, (v @ centres.T).argmax(axis=1), v)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["cluster", "v"])

    return run


def _packed(df: DataFrame, name: str, apart: bool) -> DataFrame:
    """Rows (``name``, v, cluster, angle) in blocks, their ids and vectors as bytes; ``apart``: each block of one cluster, by which the rows are sorted."""
    most_rows, most_bytes = BLOCK_ROWS, BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, None

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            made = {"cluster": [last], "angle": [t.column("angle").to_numpy().max()], "n": [n], "ids": [t.column(name).to_numpy().tobytes()], "v": [_matrix(t.column("v")).tobytes()]}
            return pa.RecordBatch.from_pydict(made, schema)

        for batch in batches:
            own, at = batch.column("cluster").to_numpy(), 0
            while at < len(own):
                most = max(1, min(most_rows, most_bytes // (8 * max(1, len(batch.column("v")[at])))))
                if held and (n >= most or apart and own[at] != last):
                    yield block()
                    held, n = [], 0
                end = min(len(own), at + most - n)
                if apart:
                    end = at + int((own[at:end] == own[at]).argmin() or end - at)
                held.append(batch.slice(at, end - at))
                at, n, last = end, n + end - at, int(own[at])
        if held:
            yield block()

    schema = pa.schema([("cluster", pa.int64()), ("angle", pa.float64()), ("n", pa.int64()), ("ids", pa.binary()), ("v", pa.binary())])
    return df.mapInArrow(run, "cluster long, angle double, n long, ids binary, v binary")


def _unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["v"], np.float64).reshape(row["n"], -1)


def _table(name: str, ids: np.ndarray, v: np.ndarray, **more: np.ndarray) -> pa.Table:
    return pa.table({name: ids, "v": pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), v.shape[1])} | more)


class _Asked:
    """A block of queries and the ``k`` best found so far for each of its ids."""

    def __init__(self, row, k: int, least: int, centres: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.v = _unpacked(row)
        self.own, self.of = np.unique(self.ids, return_inverse=True)
        self.best, self.found = np.full((len(self.own), k), -np.inf), np.zeros((len(self.own), k), np.int64)
        self.centres, self.passed, self.compared = centres, 0, 0
        pairs = []
        for start in range(0, len(self.v), CHOOSE_ROWS):
            angle = _angles(self.v[start : start + CHOOSE_ROWS], centres)
            order = np.argsort(angle, axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            near = np.zeros(angle.shape, bool)
            np.put_along_axis(near, order, held - sizes[order] < least, axis=1)
            q, c = np.nonzero(near & (sizes > 0)[None, :])
            pairs.append((q + start, c))
        q, c = (np.concatenate(x) for x in zip(*pairs))
        order = np.argsort(c, kind="stable")
        used, starts = np.unique(c[order], return_index=True)
        self.near = dict(zip(used.tolist(), np.split(q[order], starts[1:])))  # a cluster's queries: those it is nearest to

    def meet(self, row, block) -> None:
        """Compare the queries that ask for a block of rows with it."""
        self.passed += 1
        at = self.near.get(row["cluster"], np.zeros(0, np.int64))
        if row["turn"]:
            angle = _angles(self.v, self.centres[row["cluster"]][None, :])[:, 0]
            reach = np.cos(np.maximum(0.0, angle - row["angle"] - SLACK))
            asks = reach + SLACK >= self.best[self.of, -1]
            asks[at] = False
            at = np.flatnonzero(asks)
        if not len(at):
            return
        self.compared += len(at) * row["n"]
        got = block(_table("qid", self.ids[at], self.v[at], least=self.best[self.of[at], -1]), _table("rid", *_unpacked(row)))
        k = self.best.shape[1]
        hit, of = np.unique(np.searchsorted(self.own, got.column("qid").to_numpy()), return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(hit)), k), of])
        best, found = (np.concatenate([old[hit].reshape(-1), got.column(c).to_numpy()]) for old, c in ((self.best, "similarity"), (self.found, "rid")))
        order = np.lexsort((found, -best, of))
        order = order[np.arange(len(of)) - np.searchsorted(of[order], of[order]) < k]
        self.best[hit], self.found[hit] = best[order].reshape(-1, k), found[order].reshape(-1, k)

    def rows(self) -> Iterator[tuple]:
        """Rows (qid, rid, similarity), and one without qid: how many pairs were compared."""
        yield None, int(self.compared), None
        q, at = np.nonzero(self.best > -np.inf)
        yield from zip(self.own[q].tolist(), self.found[q, at].tolist(), self.best[q, at].tolist())


class Clusters:
    """Rows (rid, v) of unit vectors of one length, in clusters; staged until ``close``."""

    def __init__(self, rows: DataFrame, centres: int | None = None, rounds: int = ROUNDS) -> None:
        rows = rows.select(F.col("rid").cast("long").alias("rid"), F.col("v").cast("array<double>").alias("v")).where("rid IS NOT NULL")
        self.spark, self.n = rows.sparkSession, rows.count()
        count = min(MOST_CENTRES, centres or max(1, round(self.n**0.5)))
        # Centres begin as the rows of the least hashes: a sample of bounded size.
        self.centres = np.array([r["v"] for r in rows.orderBy(F.xxhash64("rid"), "rid").limit(count).collect()], np.float64)
        for _ in range(rounds if self.n else 0):
            found = rows.mapInArrow(_sums(self.centres), "cluster long, v array<double>").groupBy("cluster", F.lit(0).alias("x"))
            moved = found.agg(F.collect_list("v").alias("l")).select("cluster", F.aggregate("l", F.expr("transform(l[0], x -> 0D)"), lambda s, v: F.zip_with(s, v, lambda a, b: a + b)).alias("v")).collect()
            for r in moved:  # a row for each centre
                mean = np.array(r["v"])
                if (size := np.linalg.norm(mean)) > 1e-9:
                    self.centres[r["cluster"]] = mean / size
        self.rows = staged(_packed(self._placed(rows).repartitionByRange("cluster", F.xxhash64("rid")).sortWithinPartitions("cluster"), "rid", True)) if self.n else None
        facts = self.rows.groupBy("cluster").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).collect() if self.n else []
        self.sizes, self.blocks = np.zeros(len(self.centres), np.int64), sum(r["blocks"] for r in facts)
        for r in facts:
            self.sizes[r["cluster"]] = r["n"]
        self.compared = 0.0

    def close(self) -> None:
        if self.rows is not None:
            unstage(self.rows)

    def _placed(self, df: DataFrame) -> DataFrame:
        """``df`` with the nearest cluster of each vector and the angle to its centre."""
        centres = self.centres

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(pa.chunked_array([batch.column("v")]))
                products = v @ centres.T
                own = products.argmax(axis=1)
                angle = np.arccos(np.clip(products[np.arange(len(v)), own], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(angle)], names=[*batch.schema.names, "cluster", "angle"])

        return df.mapInArrow(place, f"{df.columns[0]} long, v array<double>, cluster long, angle double")

    def nearest(self, queries: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
        """For each query (qid, v) its ``k`` rows of largest dot product, as ``nearest.nearest`` gives them.

        ``compared`` is then the share of all pairs that was compared.
        """
        queries = queries.select(F.col("qid").cast("long").alias("qid"), F.col("v").cast("array<double>").alias("v")).where("qid IS NOT NULL")
        n_queries = queries.count() if self.n else 0
        if not n_queries:
            return self.spark.createDataFrame([], "qid long, rid long, similarity double, rank int")
        centres, sizes, passing = self.centres, self.sizes, 2 * self.blocks
        turns = TURNS * self.spark.sparkContext.defaultParallelism
        parts = max(-(-n_queries // BLOCK_ROWS), min(turns, -(-n_queries // LEAST_ROWS)))
        dealt = self._placed(queries).repartitionByRange(parts, "cluster", F.xxhash64("qid")).sortWithinPartitions("cluster")
        asked = staged(_packed(dealt, "qid", False).withColumn("at", F.monotonically_increasing_id()))
        # The rows as one partition that no task holds: it is read anew, block by block, for each block of queries.
        past = self.rows.withColumn("turn", F.lit(0)).unionByName(self.rows.withColumn("turn", F.lit(1))).coalesce(1)
        block = _block(k, None, skip_self)

        def run(pairs: Iterator[tuple]) -> Iterator[tuple]:
            held = {}
            for q, r in pairs:
                if q["at"] not in held:
                    held[q["at"]] = _Asked(q, k, k + skip_self, centres, sizes)
                own = held[q["at"]]
                own.meet(r, block)
                if own.passed == passing:
                    yield from held.pop(q["at"]).rows()
            if held:
                raise RuntimeError("blocks of rows are missing")

        found = staged(self.spark.createDataFrame(asked.rdd.cartesian(past.rdd).mapPartitions(run), "qid long, rid long, similarity double", verifySchema=False))
        self.compared = found.where("qid IS NULL").agg(F.sum("rid")).first()[0] / (n_queries * self.n)
        unstage(asked)
        best = Window.partitionBy("qid").orderBy(F.desc("similarity"), "rid")
        return found.where("qid IS NOT NULL").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
