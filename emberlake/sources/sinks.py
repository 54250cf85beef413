"""Writers: upserts by key, and the micro-batch decision log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlake.sources.tables import numbered, staged, unstage


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in ``order``."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__turn", turn).where("__turn = 1").drop("__turn")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys; the latest of ``new`` counts.

    One aggregation shuffle of ``new`` and one anti join; ``old`` rows are not sorted.
    """
    fresh = latest(new, keys, order).select(*old.columns)
    return old.join(fresh.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(fresh)


def bounded_queue(rows: DataFrame, batch: Sequence[str], order: Sequence[Column], capacity: int) -> DataFrame:
    """Which rows of each batch a queue of ``capacity`` takes: ``accepted`` in arrival order."""
    turn = F.row_number().over(Window.partitionBy(*batch).orderBy(*order))
    return rows.withColumn("accepted", turn <= capacity)


class DecisionLog:
    """An append-only log of micro-batches, with a row of counts for each.

    A scope's queue takes its first ``capacity`` rows of a micro-batch, in the
    order of ``order``; what overflows is dropped and counted. A row that was
    delivered twice in a batch (same ``key``) is one. Batches are folders by
    number and are replaced whole, the counts after the rows, so a batch that
    is replayed, or that a failure cut short, leaves nothing twice.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "request_id", scope: str = "scope", order: Sequence[str] = ("created_at", "id"), capacity: int = 1_000) -> None:
        self.spark, self.folder, self.key, self.scope, self.order, self.capacity = spark, folder.rstrip("/"), key, scope, list(order), capacity

    def write(self, batch: DataFrame, number: int) -> None:
        rows = latest(batch, [self.key], [F.asc(c) for c in self.order])
        marked = staged(bounded_queue(rows, [self.scope], [F.asc(c) for c in self.order], self.capacity))
        marked.where("accepted").drop("accepted").write.mode("overwrite").parquet(f"{self.folder}/rows/b{number}")
        counts = marked.groupBy(self.scope).agg(F.count("*").alias("received"), F.count_if("accepted").alias("written"))
        counts.withColumn("dropped", F.col("received") - F.col("written")).write.mode("overwrite").parquet(f"{self.folder}/counts/b{number}")
        unstage(marked)

    def run(self, decisions: DataFrame, checkpoint: str) -> None:
        """Take in a stream until its source is used up."""
        writer = decisions.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()

    def _read(self, table: str) -> DataFrame:
        done = numbered(self.spark, f"{self.folder}/counts", "b")  # written last
        return self.spark.read.parquet(*[f"{self.folder}/{table}/b{n}" for n in done])

    def rows(self) -> DataFrame:
        """What was written, in whole batches."""
        return self._read("rows")

    def counts(self) -> DataFrame:
        """Received, written and dropped rows by scope, over all batches."""
        return self._read("counts").groupBy(self.scope).agg(*[F.sum(c).alias(c) for c in ("received", "written", "dropped")])
