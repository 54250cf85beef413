"""Streaming twins of the lifecycle operators: bounded state per key, the same rules as in batch."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.operators import logs
from emberlake.operators.lifecycle import breaker_step
from emberlake.sources.tables import delete, numbered, staged, unstage


class Limit:
    """At most ``limit`` allowed requests in a window; saved: their times."""

    def __init__(self, limit: int = 60, window: float = 60.0) -> None:
        self.limit, self.window = limit, window

    def begin(self, saved: list[float] | None) -> None:
        self.log = deque(saved if saved is not None else ())

    def step(self, at: float, failed: bool) -> bool:
        while self.log and self.log[0] < at - self.window:
            self.log.popleft()
        allowed = len(self.log) < self.limit
        if allowed:
            self.log.append(at)
        return allowed

    def save(self) -> list[float]:
        return list(self.log)


class Breaker:
    """Refuses while open; saved: window start, failures and open until, nothing where there is no failure."""

    def __init__(self, window: float = 60.0, threshold: int = 10, cooldown: float = 30.0) -> None:
        self.rules = window, threshold, cooldown

    def begin(self, saved: list[float] | None) -> None:
        self.held = (saved[0], int(saved[1]), saved[2]) if saved is not None and len(saved) else None

    def step(self, at: float, failed: bool) -> bool:
        self.held, refused = breaker_step(self.held, at, failed, *self.rules)
        return refused

    def save(self) -> list[float]:
        return [float(x) for x in self.held or ()]


class Hits:
    """Whether a lookup hits: sliding expiry, permanent from ``threshold`` hits on; saved: last use, hits, permanent."""

    def __init__(self, ttl: float, threshold: int) -> None:
        self.ttl, self.threshold = ttl, threshold

    def begin(self, saved: list[float] | None) -> None:
        self.last, self.hits, self.forever = saved if saved is not None and len(saved) else (None, 0, False)

    def step(self, at: float, failed: bool) -> bool:
        hit = bool(self.forever or (self.last is not None and at - self.last < self.ttl))
        self.hits = self.hits + 1 if hit else 1
        self.forever = self.forever or (hit and 0 < self.threshold <= self.hits)
        self.last = at
        return hit

    def save(self) -> list[float]:
        return [self.last, float(self.hits), float(self.forever)]


ROWS = "key string, ts double, id long, result boolean, saved array<double>"


def _stepped(machine):
    """Rows sorted by key and time, each key's saved state first: results, and at a key's end its new state."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        for frame in frames:
            out = []
            for own, at, ident, failed, saved in frame[["key", "ts", "id", "failed", "saved"]].itertuples(index=False, name=None):
                if own != key:
                    if key is not None:
                        out.append((key, None, None, None, machine.save()))
                    key = own
                    machine.begin(saved)
                if saved is None:
                    out.append((key, at, ident, machine.step(at, failed), None))
            yield _frame(out)
        if key is not None:
            yield _frame([(key, None, None, None, machine.save())])

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["key", "ts", "id", "result", "saved"])
    return made.astype({"ts": "float64", "id": "Int64", "result": "boolean"})


class KeyedStream:
    """A stateful operator over a stream of (key, ts seconds, id, failed): micro-batches, and a table of what each key has saved.

    A micro-batch is sorted by key and time in Spark and streamed through the
    machine, so a task holds one key's bounded state and never a key's rows,
    however many one key has. Results and states are folders by the batch's
    number: a batch that is replayed reads the states before it and replaces
    its own. Rows must not come later than their key's rows of earlier batches.
    """

    def __init__(self, spark: SparkSession, folder: str, machine) -> None:
        self.spark, self.folder, self.machine = spark, folder.rstrip("/"), machine

    def states(self, before: int | None = None) -> DataFrame:
        """(key, saved) after the last whole batch (below ``before``)."""
        done = [n for n in numbered(self.spark, f"{self.folder}/states", "b") if before is None or n < before]
        if not done:
            return self.spark.createDataFrame([], "key string, saved array<double>")
        return self.spark.read.schema("key string, saved array<double>").parquet(f"{self.folder}/states/b{done[-1]}")

    def write(self, batch: DataFrame, number: int) -> None:
        none = F.lit(None)
        rows = batch.select("key", "ts", "id", "failed", none.cast("array<double>").alias("saved"))
        old = self.states(number)
        mine = old.join(batch.select("key").distinct(), "key", "left_semi").select("key", none.cast("double").alias("ts"), none.cast("long").alias("id"), none.cast("boolean").alias("failed"), "saved")
        ordered = rows.unionByName(mine).repartition("key").sortWithinPartitions("key", F.col("saved").isNull(), "ts", "id")
        made = staged(ordered.mapInPandas(_stepped(self.machine), ROWS))
        made.where("saved is null").drop("saved").write.mode("overwrite").parquet(f"{self.folder}/results/b{number}")
        new = made.where("saved is not null").select("key", "saved")
        old.join(new.select("key"), "key", "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{self.folder}/states/b{number}")
        unstage(made)
        delete(self.spark, f"{self.folder}/states/b{number - 2}")  # only the last batch can be replayed

    def run(self, events: DataFrame, checkpoint: str) -> DataFrame:
        """Take in a stream until its source is used up; all results so far: (key, ts, id, result)."""
        writer = events.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
        return self.results()

    def results(self) -> DataFrame:
        done = numbered(self.spark, f"{self.folder}/results", "b")
        schema = "key string, ts double, id long, result boolean"
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/results/b{n}" for n in done]) if done else self.spark.createDataFrame([], schema)


def sliding_rates(events: DataFrame, ts: str, bad: Column, width: str, slide: str, ratio: float, late: str) -> DataFrame:
    """``logs.sliding_rates`` of a stream: a window is given out once the watermark, ``late`` behind the newest event, has passed it."""
    return logs.sliding_rates(events.withWatermark(ts, late), ts, bad, width, slide, ratio)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write an append stream as Parquet until its source is used up."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
