"""What the training-data operators share: staging, samples and ordered numbering."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from emberlake.llm.textkit import slices


# Session settings that bound disk and memory, each with Spark's default that it replaces:
# a query's shuffle files go when it has ended, and batches for Python stay small
# however long the texts are.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": ("false", "true"),
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"),
}


def prepare(spark: SparkSession) -> None:
    """Apply ``SETTINGS`` where the session still has Spark's defaults."""
    for name, (default, value) in SETTINGS.items():
        if spark.conf.get(name, None) == default:
            spark.conf.set(name, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only in local mode, where one machine is all there is, a folder of this
    process stands in for an absent setting; a cluster without it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"emberlake-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table survives lost executors and cuts the lineage, so an
    expensive parse runs once. The folder belongs to the checkpoint directory
    and goes when that is cleaned, or by ``unstage``. Shuffle files go with
    the query (``SETTINGS``): what stays is staged.
    """
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{label}")
    out = spark.read.schema(df.schema).parquet(f"{path}/{label}")
    out._staged = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Sequence[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as set it apart from ``taken`` in any case of letters."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str, total: int) -> DataFrame:
    """The keys of ``counts`` that hold more than a quarter of a partition's even share, ready to broadcast.

    With P shuffle partitions a hot key has over total / 4P rows (1,000 at
    least), so there are at most 4P of them, whatever the input.
    """
    spark = counts.sparkSession
    limit = max(1_000, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    narrow = counts.where(F.col(n) > limit).select(*keys)
    rows = narrow.collect() if total > limit else []
    return F.broadcast(spark.createDataFrame(rows, narrow.schema))


def _measured(df: DataFrame) -> int:
    """Spark's own estimate of a table's bytes: the size of the files of a staged one."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _broadcast_limit(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes; -1 where broadcasts are off."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def join_spread(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join of staged ``rows`` with a table of one row a key, such that no hot key lands in one task.

    A lookup that Spark measures under its broadcast threshold is broadcast
    whole, and nothing is shuffled. For others hot keys are counted first
    (``hot_keys``); their few rows of ``lookup`` are broadcast, the rest meet
    in a shuffle. ``how`` is inner or left.
    """
    if _measured(lookup) <= _broadcast_limit(rows.sparkSession):
        return rows.join(F.broadcast(lookup), key, how)
    total = rows.count()
    if total <= 1_000:  # no key can be hot
        return rows.join(lookup, key, how)
    (n,) = fresh([key], "n")
    hot = hot_keys(rows.groupBy(key).agg(F.count("*").alias(n)), [key], n, total)
    if hot.isEmpty():
        return rows.join(lookup, key, how)
    picked = F.broadcast(lookup.join(hot, key, "left_semi"))  # a row for each hot key at most
    warm = rows.join(hot, key, "left_semi").join(picked, key, how)
    return rows.join(hot, key, "left_anti").join(lookup, key, how).unionByName(warm)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it has fewer files than there are cores: one small file is one task.

    Tables of at least as many files as cores are not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df._jdf.inputFiles()) < cores else df


def extended(df: DataFrame, **columns: T.DataType) -> T.StructType:
    """The schema of ``df`` with more columns."""
    return T.StructType([*df.schema.fields, *[T.StructField(name, kind) for name, kind in columns.items()]])


def with_texts(docs: DataFrame, text_col: str, make: Callable[[list[str | None]], Sequence[pa.Array]], **columns: T.DataType) -> DataFrame:
    """``docs`` with the ``columns`` that ``make`` gives for the texts of a slice of an Arrow batch.

    Columns go through Arrow under plain names and have their own again after
    it, so they may be called anything; those called as the new ones are replaced.
    """
    prepare(docs.sparkSession)
    kept = dealt(docs.drop(*columns))
    names, place = kept.columns, kept.columns.index(text_col)
    plain = kept.toDF(*[f"c{i}" for i in range(len(names))])
    schema = extended(plain, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{place}"):
            made = make(part.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*names, *columns)


def id_remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids give null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def unit_hash(seed: int, *cols: str) -> Column:
    """A repeatable number in [0, 1) for a row, from the hash of ``cols``."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def bounded_sample(df: DataFrame, limit: int, seed: int, *cols: str) -> DataFrame:
    """At most ``limit`` rows, chosen by the hash of ``cols``: the same rows in every run."""
    total = df.count()
    if total > limit:
        df = df.where(unit_hash(seed, *cols) < 1.2 * limit / total + 20.0 / total)
    return df.orderBy(unit_hash(seed, *cols), *cols).limit(limit)


def ordered_index(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number all rows from 0 in a global order without one global sort task.

    Rows are range-partitioned, staged with their partition number, counted by
    partition (one row each on the driver) and numbered within partitions.
    """
    part, base = fresh([*df.columns, name], "part", "before")
    ranged = stage(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ordered")
    before, counts = 0, []
    for row in ranged.groupBy(part).agg(F.count("*").alias("n")).orderBy(part).collect():
        counts.append((row[part], before))
        before += row["n"]
    schema = T.StructType([T.StructField(part, T.IntegerType()), T.StructField(base, T.LongType())])
    offsets = df.sparkSession.createDataFrame(counts, schema)  # a row for each partition
    within = Window.partitionBy(part).orderBy(*order)
    out = (
        ranged.withColumn(name, F.row_number().over(within).cast("long") - 1)
        .join(F.broadcast(offsets), part)
        .withColumn(name, F.col(name) + F.col(base))
        .drop(part, base)
    )
    out._staged = ranged._staged
    return out
