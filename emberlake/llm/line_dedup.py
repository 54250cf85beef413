"""Line deduplication over a whole corpus, in DataFrame operations only.

Every line becomes a 128-bit hash with its document and position. The hashes
are range-partitioned and sorted by hash, document and position, so that one
pass over each partition meets the first document of a line before the others.
Results are run-length keep bitmaps per document; text is not shuffled to make
them. A hot line (``common.hot_keys``: more than a quarter of an even range's
share) is settled by its pre-aggregated first document instead, and does not
land in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlake.llm.common import column, fresh, hot_keys, stage, unstage

# The white space stripped from both ends of a line.
LINE_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line with white space stripped at both ends and A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(LINE_SPACE)), UPPER, UPPER.lower())


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(id, row, pos) of the lines that go, and the staged table they are read from."""
    exploded = (
        docs.where(F.col(id_col).isNotNull() & (F.length(text_col) >= min_chars))
        .select(
            F.col(id_col).alias("id"),
            F.xxhash64(text_col).alias("row"),
            F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"),
        )
        .select("id", "row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "id", "row", "pos")
    )
    lines = stage(exploded, "lines")
    total = lines.count()
    firsts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    hot = hot_keys(firsts, ["h1", "h2", "first_id"], "n", total)
    first = F.first("id").over(Window.partitionBy("h1", "h2").orderBy("id", "pos"))
    cold = (
        lines.join(hot, ["h1", "h2"], "left_anti")
        .repartitionByRange("h1", "h2")
        .withColumn("first_id", first)
    )
    both = cold.unionByName(lines.join(hot, ["h1", "h2"]))
    return both.where(F.col("id") != F.col("first_id")).select("id", "row", "pos").distinct(), lines


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10
) -> DataFrame:
    """Documents that lose lines, with the runs of lines that go.

    Returns ``id``, ``row`` (hash of the text, which tells repeated ids with
    different texts apart), ``n_dropped`` and ``runs``: the drop bitmap as
    sorted runs (start, len). Documents that keep every line have no row.
    Lines with a key under ``min_chars`` code points never count. Rows with a
    null id take no part; rows that share an id are one document. The result
    is staged; the hashes it was made from are deleted. An empty table gives none.
    """
    gone, lines = _dropped_lines(docs, id_col, text_col, min_chars)
    order = Window.partitionBy("id", "row").orderBy("pos")
    runs = (
        gone.withColumn("island", F.col("pos") - F.row_number().over(order))
        .groupBy("id", "row", "island")
        .agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("len"))
    )
    bitmaps = runs.groupBy("id", "row").agg(
        F.sum("len").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("start", "len"))).alias("runs"),
    )
    out = stage(bitmaps, "bitmaps")
    unstage(lines)
    return out


def kept_text(text: Column, runs: Column) -> Column:
    """The lines outside ``runs``, joined by newlines, in time linear in lines and runs."""

    def kept(lines: Column) -> Column:
        def keep(i: Column) -> Column:
            start = F.when(i == 0, 0).otherwise(F.get(runs, i - 1)["start"] + F.get(runs, i - 1)["len"])
            end = F.when(i == F.size(runs), F.size(lines)).otherwise(F.get(runs, i)["start"])
            return F.slice(lines, start + 1, end - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), keep)), "\n")

    bound = F.transform(F.array(lines_of(text)), kept)[0]  # the lines are split once, not at every run
    return F.when(F.size(runs) > 0, bound).otherwise(text)


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")
) -> DataFrame:
    """``docs`` with ``text_col`` cut to the kept lines, plus the two ``counts``: lines before, and lines dropped.

    A null text stays null where nothing is dropped from it (it counts as one
    empty line). All other columns of ``docs`` stay as they are, of whatever
    name; only columns called as the ``counts`` are replaced.
    """
    plain = docs.drop(*counts)
    own_id, row, gone, runs = fresh([*plain.columns, *counts], "id", "row", "gone", "runs")
    own = bitmaps.select(F.col("id").alias(own_id), F.col("row").alias(row), F.col("n_dropped").alias(gone), F.col("runs").alias(runs))
    joined = plain.join(own, (plain[id_col] == own[own_id]) & (F.xxhash64(plain[text_col]) == own[row]), "left")
    text = F.col(text_col)
    kept = F.when(F.col(runs).isNull(), text).otherwise(kept_text(text, F.col(runs)))
    return joined.select(
        *[kept.alias(c) if c == text_col else column(c) for c in plain.columns],
        F.size(lines_of(text)).cast("long").alias(counts[0]),
        F.coalesce(F.col(gone), F.lit(0)).cast("long").alias(counts[1]),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``docs`` without repeated lines, the columns unchanged, of whatever name.

    Rows that lose every line stay, with an empty text.
    """
    counts = tuple(fresh(docs.columns, "n_lines", "n_dropped"))
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col, counts).drop(*counts)
