"""Size-balanced sharding by sampled splitters.

A size-weighted sample of text hashes gives quantile boundaries; records are
range-partitioned by them; ranges above a shard's share (a hot group of equal
texts) or above ``RANGE_ROWS`` rows are subdivided by sampled (hash, id)
splitters. Ranges are then packed into shards, largest first. Equal texts have
one hash, so a group stays in one shard unless it is larger than a shard's
share. Only range statistics reach the driver, never rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlake.llm.common import stage, unit_hash

RANGES_PER_SHARD = 48
RANGE_ROWS = 500_000
SAMPLES_PER_RANGE = 12
RANGE_BYTES = 4 << 30
UNITS_PER_PIECE = 16


class Splitters:
    """Boundaries of the ranges, and of the units within subdivided ranges."""

    def __init__(self, bounds: np.ndarray) -> None:
        self.bounds = bounds
        self.sub: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.base = np.arange(len(bounds) + 1, dtype=np.int64)

    def subdivide(self, sub: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.sub = sub
        units = np.ones(len(self.bounds) + 1, dtype=np.int64)
        for r, (hashes, _) in sub.items():
            units[r] += len(hashes)
        self.base = np.concatenate([[0], np.cumsum(units)[:-1]])

    def units(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        ranges = np.searchsorted(self.bounds, hashes, side="right")
        unit = self.base[ranges]
        for r, (split_hash, split_id) in self.sub.items():
            rows = np.flatnonzero(ranges == r)
            if len(rows):
                h, d = hashes[rows, None], ids[rows, None]
                above = (h > split_hash) | ((h == split_hash) & (d >= split_id))
                unit[rows] += above.sum(axis=1)
        return unit


def _with_unit(splitters: Splitters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hash").to_numpy(zero_copy_only=False)
            ids = batch.column("id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            step = 65_536
            parts = [splitters.units(hashes[i : i + step], ids[i : i + step]) for i in range(0, len(ids), step)]
            unit = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, unit], names=[*batch.schema.names, "unit"])

    return run


def _quantiles(hashes: np.ndarray, ids: np.ndarray, weights: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (hash, id) pairs at ``pieces - 1`` even weights of a sample."""
    if not len(hashes) or pieces < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((ids, hashes))
    summed = np.cumsum(weights[order])
    at = np.unique(np.searchsorted(summed, summed[-1] * np.arange(1, pieces) / pieces))
    at = order[np.minimum(at, len(order) - 1)]
    pairs = np.unique(np.stack([hashes[at], ids[at]], axis=1), axis=0)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _sample(rows: DataFrame, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows drawn with probability size x rate; each stands for weight max(1, size x rate)."""
    drawn = rows.where(unit_hash(11, "id", "hash") < F.col("size") * rate)
    got = drawn.select("hash", F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "size", "unit").toPandas()
    weight = np.maximum(1.0, got["size"].to_numpy(np.float64) * rate)
    return got["hash"].to_numpy(np.int64), got["id"].to_numpy(np.int64), weight, got["unit"].to_numpy(np.int64)


def _pack(stats: dict[int, tuple[int, int]], splitters: Splitters, n_shards: int) -> dict[int, tuple[int, int]]:
    """unit -> (shard, rows of that shard before it). Largest first into the emptiest shard."""
    total = sum(size for size, _ in stats.values())
    share = total / n_shards
    owner = np.searchsorted(splitters.base, np.arange(max(stats, default=0) + 1), side="right") - 1
    atoms: list[tuple[int, list[int]]] = []
    by_range: dict[int, list[int]] = {}
    for unit in sorted(stats):
        by_range.setdefault(int(owner[unit]), []).append(unit)
    for units in by_range.values():
        whole = sum(stats[u][0] for u in units)
        pieces = max(1, int(np.ceil(whole / share))) if share else 1
        done, cut = 0, [[] for _ in range(pieces)]
        for u in units:
            cut[min(pieces - 1, int((done + stats[u][0] / 2) * pieces / whole))].append(u)
            done += stats[u][0]
        atoms += [(sum(stats[u][0] for u in c), c) for c in cut if c]
    load = [(0, s) for s in range(n_shards)]
    heapq.heapify(load)
    rows, place = [0] * n_shards, {}
    for size, units in sorted(atoms, key=lambda a: (-a[0], a[1])):
        held, shard = heapq.heappop(load)
        for u in units:
            place[u] = (shard, rows[shard])
            rows[shard] += stats[u][1]
        heapq.heappush(load, (held + size, shard))
    return place


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard so that the shards' sizes are near equal.

    Returns ``id``, ``size`` (UTF-8 bytes + 8; a null text has none),
    ``text_crc32`` (a null text counts as empty), ``shard`` and ``slot``
    (gapless from 0 in each shard, by text hash and id). Rows with a null id or
    repeated ids are placed like any other. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("hash"),
        ),
        "sizes",
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(n_shards * RANGES_PER_SHARD, -(-n // RANGE_ROWS))
    hashes, ids, weights, _ = _sample(rows.withColumn("unit", F.lit(0).cast("long")), ranges * SAMPLES_PER_RANGE / max(total, 1))
    bounds, _ = _quantiles(hashes, np.zeros_like(hashes), weights, ranges)
    splitters = Splitters(bounds)
    schema = "id long, size long, text_crc32 long, hash long, unit long"

    def stats_of() -> dict[int, tuple[int, int]]:
        ranged = rows.mapInArrow(_with_unit(splitters), schema)
        got = ranged.groupBy("unit").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        return {r["unit"]: (r["size"], r["n"]) for r in got}

    stats = stats_of()
    share = total / n_shards
    over = {u: max(UNITS_PER_PIECE * int(np.ceil(s / share)), 2 * -(-c // RANGE_ROWS)) for u, (s, c) in stats.items() if s > share or c > 2 * RANGE_ROWS}
    if over:
        crowded = rows.mapInArrow(_with_unit(splitters), schema).where(F.col("unit").isin(list(over)))
        rate = SAMPLES_PER_RANGE * 8 * sum(over.values()) / max(1, sum(stats[u][0] for u in over))
        hashes, ids, weights, unit = _sample(crowded, rate)
        subs = {}
        for u, pieces in over.items():
            own = unit == u
            at_hash, at_id = _quantiles(hashes[own], ids[own], weights[own], pieces)
            groups, place = np.unique(hashes[own], return_inverse=True)
            held = np.bincount(place, weights[own], len(groups)) / rate  # bytes of each group, estimated
            small = held[np.searchsorted(groups, at_hash)] <= min(share, RANGE_BYTES)
            at_id[small] = np.iinfo(np.int64).min  # a group that fits is never cut
            pairs = np.unique(np.stack([at_hash, at_id], axis=1), axis=0)
            subs[u] = (pairs[:, 0].copy(), pairs[:, 1].copy())
        splitters.subdivide(subs)
        stats = stats_of()
    place = _pack(stats, splitters, n_shards)
    size = max(place, default=0) + 1
    shard_of, before = np.zeros(size, np.int32), np.zeros(size, np.int64)
    for u, (s, b) in place.items():
        shard_of[u], before[u] = s, b
    with_unit = _with_unit(splitters)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in with_unit(batches):
            unit = batch.column("unit").to_numpy()
            more = [pa.array(shard_of[unit]), pa.array(before[unit])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "shard", "before"])

    order = Window.partitionBy("unit").orderBy("hash", "id", "text_crc32")
    return (
        rows.mapInArrow(placed, schema + ", shard int, before long")
        .withColumn("slot", F.col("before") + F.row_number().over(order) - 1)
        .select("id", "size", "text_crc32", "shard", "slot")
    )
