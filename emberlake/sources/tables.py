"""Tables of a folder, and frames with the schemas the engine works on."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_S, _L, _I, _D, _B, _T = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
CACHE_ENTRY = _schema(
    entry_key=_S, scope=_S, domain=_S, text=_S, response=_S, metadata=_S, entities=_S, entity_sig=_S,
    embedding=T.ArrayType(T.FloatType()), hits=_I, ts=_L, expires_at=_L, schema_version=_I,
)
MESSAGE = _schema(id=_L, scope=_S, model=_S, request_id=_S, role=_S, content=_S, cached=_B, created_at=_T)
DECISION = _schema(
    id=_L, request_id=_S, scope=_S, action=_S, category=_S, score=_D, judge_invoked=_B, reason=_S, policy_hash=_S, created_at=_T,
)
SCHEMA_VERSION = 3


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it has fewer files than there are cores: one small file is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df._jdf.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; on one machine alone, where unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (root or os.path.join(tempfile.gettempdir(), f"emberlake-{os.getpid()}")).rstrip("/")


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return system.exists(found)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it, if it is there."""
    found, system = _path(spark, path)
    system.delete(found, True)


def numbered(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers of the folders ``prefix``N whose writing ended, in order."""
    found, system = _path(spark, folder)
    if not system.exists(found):
        return []
    names = [s.getPath().getName() for s in system.listStatus(found)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and exists(spark, f"{folder}/{n}/_SUCCESS"))


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._staged)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own measure of a staged table is under its threshold for broadcast joins."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: computed once, whatever reads it."""
    path = f"{shared_dir(df.sparkSession)}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def migrate(entries: DataFrame, domain: str = "general") -> DataFrame:
    """Old entries with the later columns filled in: signature, domain, entities, scope; ``migrated`` marks them.

    Missing columns and nulls are filled alike.
    """
    fills = {"entity_sig": "none", "domain": domain, "entities": "[]", "scope": "_default"}
    changed: Column = F.lit(False)
    out = entries
    for name, value in fills.items():
        old = F.col(name) if name in entries.columns else F.lit(None).cast("string")
        changed = changed | old.isNull()
        out = out.withColumn(f"__{name}", F.coalesce(old, F.lit(value)))
    out = out.withColumn("migrated", changed)
    for name in fills:
        out = out.withColumn(name, F.col(f"__{name}")).drop(f"__{name}")
    return out.withColumn("schema_version", F.lit(SCHEMA_VERSION))


def pack_vector(v: Column) -> Column:
    """Little-endian 32-bit floats of an array, as bytes."""
    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(v)


def unpack_vector(data: Column, dim: int) -> Column:
    """The floats of packed bytes; null where the length is not that of ``dim`` floats."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None or len(b) != 4 * dim else np.frombuffer(b, "<f4").tolist())

    return run(data)
