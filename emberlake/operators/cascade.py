"""The retrieval cascade: tiers in order, the first hit wins, later tiers see the rest only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlake.sources.tables import staged

MODES = ("off", "exact", "bm25", "fuzzy", "semantic", "entity-aware")
REASONS = ("no_candidate", "below_threshold", "extractor_error")  # why a lookup missed


def resolve_modes(mode: str | Sequence[str], exact_tier: bool = False) -> list[str]:
    """The tiers of a configured mode: a list as it is, ``off`` none, a single mode after ``exact`` if asked for."""
    if isinstance(mode, str):
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        if mode == "off":
            return []
        return ["exact", mode] if exact_tier and mode != "exact" else [mode]
    modes = list(mode)
    if not modes or "off" in modes or any(m not in MODES for m in modes):
        raise ValueError("a list of modes must be non-empty, without off, and known")
    return modes


def exact_hits(queries: DataFrame, entries: DataFrame, key: str = "entry_key") -> DataFrame:
    """Key equality: (query_id, entry_id, similarity 1.0); the least entry id of a key answers."""
    firsts = entries.groupBy(key).agg(F.min("entry_id").alias("entry_id"))
    return queries.join(firsts, key).select("query_id", "entry_id", F.lit(1.0).alias("similarity"))


def entity_aware_hits(ranked: DataFrame, overlap: Column, floor: float = 0.95, k: int = 10) -> DataFrame:
    """Of the ``k`` nearest (ranked first, filtered after) the nearest that shares an entity and reaches the floor."""
    good = ranked.where((F.col("rank") <= k) & overlap & (F.col("similarity") >= floor))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return good.withColumn("turn", turn).where("turn = 1").select("query_id", "entry_id", "similarity")


def cascade(queries: DataFrame, tiers: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], answers: DataFrame | None = None) -> DataFrame:
    """Run each tier on the queries that no earlier tier answered.

    A tier maps queries to (query_id, entry_id, similarity). Its hits are staged
    once: later tiers and the result read them, so plans grow by a scan a tier.
    Returns every query with ``hit``, ``method``, ``entry_id`` and ``similarity``,
    and the columns that ``answers`` has for its ``entry_id``. Both sides of these joins
    grow with the queries, so they are merged, not broadcast through the driver.
    """
    left, parts = queries, []
    for name, tier in tiers:
        hits = tier(left).select("query_id", "entry_id", F.col("similarity").cast("double").alias("similarity"), F.lit(name).alias("method"))
        hits = staged(hits)
        parts.append(hits)
        left = left.join(hits.select("query_id").hint("merge"), "query_id", "left_anti")
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    more = []
    if answers is not None:  # before the misses come in, which have no entry to be dealt out by
        hits, more = hits.join(answers.hint("merge"), "entry_id", "left"), [c for c in answers.columns if c != "entry_id"]
    out = queries.select("query_id").join(hits.hint("merge"), "query_id", "left")
    out = out.select("query_id", F.col("method").isNotNull().alias("hit"), "method", "entry_id", "similarity", *more)
    out._parts = parts  # staged; whoever has read the result may delete them
    return out


def miss_reason(hit: Column, best_score: Column, floor: float) -> Column:
    """Why the last tier missed: nothing found, or the best below its floor."""
    return F.when(hit, F.lit(None)).when(best_score.isNull(), "no_candidate").when(best_score < floor, "below_threshold").otherwise("no_candidate")
