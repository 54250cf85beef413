"""A stored inverted index: tokens are taken out of a text once, when it is written.

A part of the index holds four tables of the same entries:

* ``vocabulary``: each token with its number, document frequency, and the bounds
  of what it can add to a score (largest frequency, least length of a text);
* ``postings``: blocks of at most ``BLOCK`` entries of a token, those it counts
  most in first, with the same two bounds for the block;
* ``forward``: each entry's tokens, their numbers and frequencies;
* ``deletes``: the spelling index, what a token's first letters become by leaving out characters.

All are sorted by the column they are looked up by, so Parquet's statistics of
pages prune what is read; only ``forward`` stays dealt as the entries were. Parts are added and never changed; readers take their union.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from emberlake.functions.text import tokens
from emberlake.sources.tables import exists, shared_dir

BLOCK = 128  # entries of a block of postings
SPREAD_ROWS = 1_000_000  # entries among which a token's blocks are ordered in one task
PREFIX = 8  # letters of a token that the spelling index covers
COUNT_ROWS = 256  # texts whose tokens are counted at once
DISTANCE = 1  # edits the stored spelling index is made for


def left_out(token: Column, distance: int, prefix: int = PREFIX) -> Column:
    """The first letters of a token, and all they become by leaving out up to ``distance`` characters.

    Tokens within that edit distance share one of them at least.
    """
    shorter = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    out = F.array(F.substring(token, 1, prefix))
    for _ in range(distance):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, shorter))))
    return out


def _counted(rows: DataFrame) -> DataFrame:
    """Rows with ``length``, the distinct ``tokens`` of each and how often they occur (``tfs``): counted within the row, without a shuffle."""
    columns = [c for c in rows.columns if c != "tokens"]
    schema = T.StructType([*[rows.schema[c] for c in columns], *T.StructType.fromDDL("length int, tokens array<string>, tfs array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, COUNT_ROWS):
                part = batch.slice(start, COUNT_ROWS)
                lists = part.column("tokens")
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                known = pc.dictionary_encode(lists.flatten())
                kinds = max(1, len(known.dictionary))
                keys = np.repeat(np.arange(len(sizes)), sizes) * kinds + known.indices.to_numpy(zero_copy_only=False)
                pairs, counts = np.unique(keys, return_counts=True)
                ends = pa.array(np.searchsorted(pairs, np.arange(len(sizes) + 1) * kinds), pa.int32())
                made = [pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, known.dictionary.take(pa.array(pairs % kinds))), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def build(entries: DataFrame, folder: str, id_col: str = "entry_id", text_col: str = "text", keep: Sequence[str] = (), distance: int = DISTANCE) -> None:
    """Write the part of the index for ``entries`` (unique ids; a null text has no tokens) to ``folder``.

    ``keep`` names columns of the entries, such as their scope, that ``forward`` has too.
    """
    spark = entries.sparkSession
    words = F.transform(tokens(F.coalesce(F.col(text_col), F.lit(""))), F.lower)
    rows = entries.select(F.col(id_col).alias("entry_id"), *keep, words.alias("tokens"))
    forward = _counted(rows).withColumn("words", F.transform("tokens", lambda t: F.xxhash64(t)))
    forward.sortWithinPartitions("entry_id").write.mode("overwrite").parquet(f"{folder}/forward")
    forward = spark.read.parquet(f"{folder}/forward")
    held = forward.select("length", F.explode(F.arrays_zip("tokens", "words", "tfs")).alias("t")).select("length", "t.*")
    vocabulary = held.groupBy(F.col("tokens").alias("token"), F.col("words").alias("word")).agg(F.count("*").alias("df"), F.max("tfs").alias("max_tf"), F.min("length").alias("min_length"))
    vocabulary.repartition("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{folder}/vocabulary")
    vocabulary = spark.read.parquet(f"{folder}/vocabulary")
    if vocabulary.groupBy("word").count().where("count > 1").limit(1).count():
        raise ValueError("two tokens have one number")  # 64 bits: never seen; the index would be wrong
    parts = -(-forward.count() // SPREAD_ROWS) or 1
    # A frequent token's entries are ordered in several tasks, each of which makes blocks of its own.
    spot = F.pmod(F.xxhash64("entry_id"), F.lit(parts)).cast("int")
    counted = forward.select("entry_id", "length", F.explode(F.arrays_zip("words", "tfs")).alias("t")).select("entry_id", "length", F.col("t.words").alias("word"), F.col("t.tfs").alias("tf"))
    turn = F.row_number().over(Window.partitionBy("word", "spot").orderBy(F.desc(F.col("tf") / F.col("length")), "entry_id"))
    blocks = counted.withColumn("spot", spot).withColumn("block", F.floor((turn - 1) / BLOCK).cast("int"))
    postings = blocks.groupBy("word", "spot", "block").agg(F.collect_list("entry_id").alias("ids"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"))
    postings.sortWithinPartitions("word").write.mode("overwrite").parquet(f"{folder}/postings")  # where the window has dealt them: a spot of a word lies in one file
    spelled = vocabulary.select("token", "word", "df", F.explode(left_out(F.col("token"), distance)).alias("variant"))
    spelled.repartition("variant").sortWithinPartitions("variant").write.mode("overwrite").parquet(f"{folder}/deletes")
    spark.createDataFrame([(distance,)], "distance int").write.mode("overwrite").parquet(f"{folder}/made")  # last: a part without it is not whole


class TextIndex:
    """The union of parts; tables are read as far as a query's columns and filters need."""

    def __init__(self, spark: SparkSession, folders: Sequence[str]) -> None:
        self.spark, self.folders = spark, list(folders)

    def table(self, name: str) -> DataFrame:
        out = self.spark.read.parquet(f"{self.folders[0]}/{name}")
        for folder in self.folders[1:]:
            out = out.unionByName(self.spark.read.parquet(f"{folder}/{name}"))
        return out

    def vocabulary(self) -> DataFrame:
        if len(self.folders) == 1:
            return self.table("vocabulary")
        return self.table("vocabulary").groupBy("token", "word").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))


def stored(entries: DataFrame, source: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = ()) -> TextIndex:
    """The index of ``entries``, made from the files of ``source``, built where the shared folder does not have it yet.

    Its place is named by the files' names, sizes and times and by what is
    indexed, so other files make another index.
    """
    spark = source.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    names = [jvm.org.apache.hadoop.fs.Path(f) for f in sorted(source._jdf.inputFiles())]
    states = [p.getFileSystem(conf).getFileStatus(p) for p in names]
    known = [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in states] + [id_col, text_col, *keep, str((BLOCK, PREFIX, DISTANCE))]
    folder = f"{shared_dir(spark)}/text_index/{hashlib.sha256(chr(10).join(known).encode()).hexdigest()[:32]}"
    if not exists(spark, f"{folder}/made/_SUCCESS"):
        build(entries, folder, id_col, text_col, keep)
    return TextIndex(spark, [folder])
