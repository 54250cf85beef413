"""The cache's entries as a table of changes: writes, touches and deletes are appended and merged when read.

A folder holds numbered batches of changes (``log/c1``, ``log/c2``, ...) and
compacted tables (``base/b2`` has all changes up to 2 in it). A hit costs a short
row in the next batch, not a write of the whole table. The newest base and the
batches after it give the current entries; compaction writes the next base.
Batches stay, so the log is also the feed that mirrors read, as a stream too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.sources.tables import CACHE_ENTRY, numbered

PUT, TOUCH, DELETE = "put", "touch", "delete"
ENTRY = T.StructType([*CACHE_ENTRY.fields, T.StructField("entry_id", T.LongType()), T.StructField("written", T.LongType())])
CHANGE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("at", T.LongType()), T.StructField("count", T.LongType()), *CACHE_ENTRY.fields, T.StructField("entry_id", T.LongType())])
COMPACT_AFTER = 16


def merge(base: DataFrame, changes: DataFrame, ttl: int, threshold: int) -> DataFrame:
    """``base`` entries with ``changes`` (which have their batch's number as ``change``) applied.

    The newest write of a key counts, unless a later delete takes it. Touches
    after that write add up: each adds its count to the hits and renews the
    expiry to ``ttl`` after the last of them; an entry that has no expiry, or
    whose hits reach ``threshold`` (0: never) by a touch, has none any more.
    Touches meet only entries that were live, so their order does not matter.
    """
    fields = [c for c in ENTRY.fieldNames() if c not in ("entry_key", "entry_id", "written")]
    own = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    made = changes.select(
        "entry_key", "entry_id", *[own(PUT, c).alias(c) for c in fields], own(PUT, "change").alias("written"),
        own(DELETE, "change").alias("gone"), own(TOUCH, "count").alias("more"), own(TOUCH, "at").alias("last"),
    )
    # One shuffle by key and no join: base and changes, whatever their sizes, are never sent through the driver.
    rows = base.unionByName(made, allowMissingColumns=True).repartition("entry_key")
    writes = rows.groupBy("entry_key", "entry_id").agg(  # touches are those of this write of the key alone
        *[F.max_by(c, "written").alias(c) for c in fields], F.max("written").alias("written"), F.max("gone").alias("gone"), F.sum("more").alias("more"), F.max("last").alias("last"),
    )
    newest = F.when(F.col("written").isNotNull(), F.struct("written", "entry_id"))
    kept = writes.groupBy("entry_key").agg(*[F.max_by(c, newest).alias(c) for c in (*fields, "entry_id", "more", "last")], F.max("written").alias("written"), F.max("gone").alias("gone"))
    kept = kept.where(F.col("written").isNotNull() & (F.col("gone").isNull() | (F.col("gone") < F.col("written"))))
    rows = kept.withColumn("total", F.col("hits") + F.coalesce("more", F.lit(0)).cast("int"))
    permanent = F.col("expires_at").isNull() | ((F.col("total") >= threshold) if threshold > 0 else F.lit(False))
    renewed = F.when(F.col("more").isNull(), F.col("expires_at")).when(~permanent, F.col("last") + ttl)
    return rows.withColumns({"expires_at": renewed, "hits": F.col("total")}).select(*base.columns)


class EntryTable:
    """Entries in a folder. One writer at a time; readers see whole batches only."""

    def __init__(self, spark: SparkSession, folder: str, ttl: int = 86_400, threshold: int = 0, compact_after: int = COMPACT_AFTER) -> None:
        self.spark, self.folder, self.ttl, self.threshold, self.compact_after = spark, folder.rstrip("/"), ttl, threshold, compact_after

    def batches(self) -> list[int]:
        return numbered(self.spark, f"{self.folder}/log", "c")

    def _base(self) -> int:
        return (numbered(self.spark, f"{self.folder}/base", "b") or [0])[-1]

    def changes(self, after: int = 0) -> DataFrame:
        """The changes of the batches after a number, each with its batch as ``change``."""
        numbers = [n for n in self.batches() if n > after]
        if not numbers:
            return self.spark.createDataFrame([], CHANGE).withColumn("change", F.lit(0).cast("long"))
        rows = self.spark.read.schema(CHANGE).parquet(*[f"{self.folder}/log/c{n}" for n in numbers])
        return rows.withColumn("change", F.regexp_extract(F.col("_metadata.file_path"), r"/c(\d+)/[^/]*$", 1).cast("long"))

    def batch(self, number: int) -> DataFrame:
        """The changes of one batch, of which alone the folder is read."""
        return self.spark.read.schema(CHANGE).parquet(f"{self.folder}/log/c{number}")

    def stream(self) -> DataFrame:
        """The changes as a stream, batch by batch as they are written."""
        rows = self.spark.readStream.schema(CHANGE).parquet(f"{self.folder}/log/c*")
        return rows.withColumn("change", F.regexp_extract(F.col("_metadata.file_path"), r"/c(\d+)/[^/]*$", 1).cast("long"))

    def base(self) -> DataFrame:
        """The compacted entries; with a filter on ``scope`` only that scope's folder is read."""
        number = self._base()
        if not number:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(f"{self.folder}/base/b{number}").select(*ENTRY.fieldNames())

    def entries(self) -> DataFrame:
        """The current entries, expired ones too, with ``entry_id`` and the batch that wrote them (``written``)."""
        return merge(self.base(), self.changes(self._base()), self.ttl, self.threshold)

    def append(self, changes: DataFrame, number: int | None = None) -> int:
        """Write a batch of changes, as the next or as ``number``; writing a number again replaces it."""
        number = number or (self.batches() or [0])[-1] + 1
        columns = [(F.col(f.name) if f.name in changes.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHANGE.fields]
        changes.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/log/c{number}")
        return number

    def compact(self) -> None:
        """Write the current entries as the next base: a folder for each scope, sorted by key, with Bloom filters.

        Ranges split a scope of many entries over several tasks and files.
        """
        numbers = self.batches()
        if not numbers or numbers[-1] <= self._base():
            return
        rows = self.entries().repartitionByRange("scope", "entry_key").sortWithinPartitions("scope", "entry_key")
        rows.write.mode("overwrite").partitionBy("scope").option("parquet.bloom.filter.enabled#entry_key", "true").parquet(f"{self.folder}/base/b{numbers[-1]}")

    def lookup(self, keys: list[str]) -> DataFrame:
        """The entries of a few keys: the filter reaches the files' Bloom filters."""
        wanted = F.col("entry_key").isin(keys)
        return merge(self.base().where(wanted), self.changes(self._base()).where(wanted), self.ttl, self.threshold)

    def of_scope(self, tag: str) -> DataFrame:
        """The entries of one scope: of the base its folder alone is read.

        A key belongs to one scope, so changes of other scopes cannot touch these entries.
        """
        mine = F.col("scope") == tag
        keys = self.changes(self._base())
        return merge(self.base().where(mine), keys.where(mine), self.ttl, self.threshold)


def mirror(table: EntryTable, into: EntryTable, checkpoint: str):
    """Follow a table's feed into another until all that is written has been taken over.

    A batch is taken over whole and under its own number, so a micro-batch
    that is replayed, or that saw some of a batch's files only, changes nothing.
    """

    def write(rows: DataFrame, number: int) -> None:
        seen = {r[0] for r in rows.select("change").distinct().collect()}  # numbers of batches, not rows
        held = set(into.batches())
        for n in table.batches():
            if n in seen or n not in held:
                into.append(table.batch(n), n)

    stream = table.stream().writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return stream
