"""Message and decision logs: listings, metrics, histograms, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(rows: DataFrame, scope: str, id_col: str, n: int) -> DataFrame:
    """The newest ``n`` (1 to 500) rows of every scope, with ``turn`` from 1."""
    if not 1 <= n <= 500:
        raise ValueError("n must be from 1 to 500")
    turn = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc(id_col)))
    return rows.withColumn("turn", turn).where(F.col("turn") <= n)


def counters(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("value"))


def histogram(rows: DataFrame, value: str, bounds: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """Cumulative histogram rows (labels, le, count) with a last bucket ``+Inf``; one pass, no expansion of rows."""
    sums = [F.count(F.when(F.col(value) <= b, 1)).alias(f"__{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*labels).agg(*sums, F.count(value).alias("__inf"))
    steps = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"__{i}").alias("count")) for i, b in enumerate(bounds)]
    steps.append(F.struct(F.lit("+Inf").alias("le"), F.col("__inf").alias("count")))
    return wide.select(*labels, F.inline(F.array(*steps)))


def exposition(metrics: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """Text exposition lines of counters: name{label="value",...} value."""
    pairs = [F.concat(F.lit(f'{label}="'), F.col(label).cast("string"), F.lit('"')) for label in labels]
    return metrics.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} "), F.col("value").cast("string")).alias("line"))


def alert_rates(events: DataFrame, ts: str, bad: Column, width: str, ratio: float) -> DataFrame:
    """Bad share by tumbling window, and whether it passes ``ratio``."""
    by = events.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("bad"))
    rate = F.col("bad") / F.col("n")
    return by.select(F.col("w.start").alias("window_start"), "n", "bad", F.round(rate, 6).alias("rate"), (rate > ratio).alias("alert"))


def above_daily_mean(events: DataFrame, ts: str, bad: Column, factor: float = 2.0) -> DataFrame:
    """Hours whose bad count is over ``factor`` times the mean of their day's hours."""
    hourly = events.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.when(bad, 1)).alias("bad"))
    mean = F.avg("bad").over(Window.partitionBy(F.to_date("hour")))
    return hourly.withColumn("daily_mean", F.round(mean, 6)).withColumn("alert", F.col("bad") > factor * mean)


def sliding_rates(events: DataFrame, ts: str, bad: Column, width: str, slide: str, ratio: float) -> DataFrame:
    """Bad share of every window of ``width`` that starts each ``slide``, and whether it passes ``ratio``; for streams with a watermark too."""
    by = events.groupBy(F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("bad"))
    rate = F.col("bad") / F.col("n")
    return by.select(F.col("w.start").alias("window_start"), "n", "bad", F.round(rate, 6).alias("rate"), (rate > ratio).alias("alert"))


def above_moving_mean(events: DataFrame, ts: str, bad: Column, width_s: int, back_s: int, factor: float, labels: Sequence[str] = ()) -> DataFrame:
    """Windows of ``width_s`` seconds whose bad count is over ``factor`` times the mean of those that began in the ``back_s`` seconds before and in it.

    Events are counted by window first, so what is ordered is one row a window and label.
    """
    start = (F.floor(F.col(ts).cast("timestamp").cast("double") / width_s) * width_s).cast("long")
    counted = events.groupBy(*labels, start.alias("start_s")).agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("bad"))
    mean = F.avg("bad").over(Window.partitionBy(*labels).orderBy("start_s").rangeBetween(-back_s, 0))
    rows = counted.withColumn("mean", mean)
    return rows.select(*labels, "start_s", "n", "bad", F.round("mean", 6).alias("moving_mean"), (F.col("bad") > factor * F.col("mean")).alias("alert"))
