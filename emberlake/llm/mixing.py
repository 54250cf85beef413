"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length. Each source gets whole
repeats of all its documents, then a share of every length, and a bounded
knapsack over the lengths closes the remaining budget; where that misses (few or
very long documents), the knapsack covers the whole budget. Which documents of a
length are taken follows a seeded hash. Only one row per source and length
meets in a task, never a source's documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlake.llm.common import column, fresh, hot_keys, ordered_index, stage, unstage

# The token pattern, the repeated source weights, the cap on repeats.
TOKEN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
KNAPSACK_BUDGET = 32_768
WHOLE_BUDGET = 1 << 24  # words up to which the knapsack can cover a whole budget (150 MB), and its steps
WHOLE_STEPS = 1 << 32
RANK_ROWS = 1_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets for sources from (source, source_size): weights 1, 2, 3 by code point order, null last.

    All sizes together are shared by weight; a target stops at ``MAX_REPEATS``
    times its source's size, and the excess is shared again until none is
    above. Each round is one aggregate over the sources.
    """
    (rank,) = fresh(sizes.columns, "rank")
    numbered = ordered_index(sizes, [F.col("source").asc_nulls_last()], rank)
    weights = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col(rank) % len(WEIGHTS) + 1).cast("int"))
    ranked = stage(numbered.withColumn("weight", weights), "sources")
    unstage(numbered)
    cap = F.col("source_size") * MAX_REPEATS
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, rest = 0.0, total or 0
    while weight:
        level = rest / weight
        above = F.col("weight") * F.lit(level) > cap
        capped, open_weight = ranked.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        if open_weight in (0, weight):
            break
        rest, weight = total - capped, open_weight
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(float(level)))
    out = ranked.select("source", "source_size", target.alias("target"))
    out._staged = ranked._staged
    return out


def knapsack(lengths: np.ndarray, left: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take (at most ``left``) for the sum nearest to ``budget``, the lower of two as near.

    Dynamic programming over reachable sums; a length's copies are split into
    binary chunks, and each sum remembers the first chunk that reached it.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    usable = np.flatnonzero((lengths > 0) & (left > 0))
    if budget <= 0 or not len(usable):
        return taken
    top = budget + int(min(lengths[usable].max(), budget))  # a nearest sum without any one of its documents is under the budget
    reached = np.zeros(top + 1, dtype=bool)
    reached[0] = True
    by = np.full(top + 1, -1, dtype=np.int32)
    chunks: list[tuple[int, int]] = []
    for i in usable[lengths[usable] <= top]:
        copies, k = min(int(left[i]), top // int(lengths[i])), 1
        while copies > 0 and not reached[budget]:
            take = min(k, copies)
            weight = take * int(lengths[i])
            new = np.zeros_like(reached)
            new[weight:] = reached[: top + 1 - weight]
            new &= ~reached
            by[new] = len(chunks)
            chunks.append((int(i), take))
            reached |= new
            copies, k = copies - take, 2 * k
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - budget).argmin()])
    while at:
        i, take = chunks[by[at]]
        taken[i] += take
        at -= take * int(lengths[i])
    return taken


def _fill(lengths: np.ndarray, room: np.ndarray, amount: int) -> np.ndarray:
    """How many of each length to take for ``amount``: long ones first until the knapsack can close the rest."""
    taken = np.zeros(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        if amount <= KNAPSACK_BUDGET:
            break
        if lengths[i] > 0:
            length = int(lengths[i])
            taken[i] = min(int(room[i]), amount // length, -((KNAPSACK_BUDGET - amount) // length))
            amount -= int(taken[i]) * length
    return taken if amount > KNAPSACK_BUDGET else taken + knapsack(lengths, room - taken, amount)


def _nearer(lengths: np.ndarray, room: np.ndarray, budget: int, taken: np.ndarray) -> np.ndarray:
    """``taken`` if no other choice comes nearer to ``budget``, else that choice.

    The knapsack decides over the whole budget if its table is small enough;
    beyond, each length too long for the rest is tried as an overshoot, less
    what brings the sum back.
    """
    def miss(choice: np.ndarray) -> int:
        return budget - int((choice * lengths).sum())

    usable = np.flatnonzero((lengths > 0) & (room > 0))
    if miss(taken) == 0 or not len(usable):
        return taken
    top = budget + min(int(lengths[usable].max()), budget)
    fits = np.minimum(room[usable], top // lengths[usable])
    if top <= WHOLE_BUDGET and top * int(np.ceil(np.log2(fits + 1)).sum()) <= WHOLE_STEPS:
        choices = [knapsack(lengths, room, budget)]
    else:
        rest = miss(taken)
        one = np.eye(1, len(lengths), dtype=np.int64)[0]
        choices = (
            taken + np.roll(one, i) - _fill(lengths, taken, int(lengths[i]) - rest)
            for i in usable[(lengths[usable] > rest) & (room[usable] > taken[usable])] if rest > 0
        )
    best = taken
    for choice in choices:
        if abs(miss(choice)) < abs(miss(best)):
            best = choice
            if miss(best) == 0:
                break
    return best


def fit_budget(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """Whole repeats of all documents, and for each length how many more are taken (no document over the cap).

    Most of the rest is an even share of every length; the last
    ``KNAPSACK_BUDGET`` words are left to the knapsack. Where the sum then
    misses the target, ``_nearer`` looks for a nearer one.
    """
    total = int((lengths * counts).sum())
    if total == 0:
        return 0, np.zeros(len(lengths), np.int64)
    repeats = min(MAX_REPEATS, int(target // total))
    budget = rest = max(0, round(target - repeats * total)) if repeats < MAX_REPEATS else 0
    room = counts * (MAX_REPEATS - repeats)
    extra = np.minimum(counts, (counts * (max(0, rest - KNAPSACK_BUDGET) / total)).astype(np.int64))
    rest -= int((extra * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):  # one more of a length at a time, until the knapsack can close it
        if rest <= KNAPSACK_BUDGET:
            break
        if 0 < lengths[i] <= rest and extra[i] < room[i]:
            extra[i] += 1
            rest -= int(lengths[i])
    return repeats, _nearer(lengths, room, budget, extra + _fill(lengths, room - extra, rest))


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """One source: a row for each of its lengths, with its repeats and extra documents."""
    order = rows.sort_values("size").reset_index(drop=True)
    lengths, counts = order["size"].to_numpy(np.int64), order["n"].to_numpy(np.int64)
    repeats, extra = fit_budget(lengths, counts, float(order["target"].iloc[0]))
    order["repeats"] = (repeats + extra // counts).astype(np.int32)
    order["extra"] = extra % counts
    return order[["skey", "size", "n", "source_size", "target", "repeats", "extra"]]


def mix(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each row goes into a mix that holds each source near its target.

    Returns ``id``, ``row`` (hash of the text), ``size`` (words; a null text
    has none), ``source_size``, ``target`` and ``copies`` (0 to 3). A null
    source is a source of its own. Rows of size 0 are never taken. Repeated
    rows are taken alike or not, as their count falls. Same input, same mix. An
    empty table gives no rows; ids may be null or repeat. The result reads two
    staged tables, which stay until it has been used.
    """
    rows = stage(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(text_col).alias("row"),
            F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), source_col)).alias("skey"),
            F.col(source_col).alias("source"),
            token_count(F.col(text_col)).alias("size"),
        ),
        "sizes",
    )
    lengths = stage(rows.groupBy("source", "skey", "size").agg(F.count("*").alias("n")), "lengths")
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes)
    plan = stage(
        lengths.join(targets, lengths["source"].eqNullSafe(targets["source"]))
        .select("skey", "size", "n", "source_size", "target")
        .groupBy("skey")
        .applyInPandas(_fit, "skey string, size long, n long, source_size long, target double, repeats int, extra long"),
        "plan",
    )
    unstage(targets, lengths)
    key = ["skey", "size"]
    hot = hot_keys(plan, plan.columns, "n", rows.count())  # lengths that would crowd a task: broadcast
    cold = rows.join(hot.select(*key), key, "left_anti").join(plan.join(hot.select(*key), key, "left_anti").hint("merge"), key)
    draw = F.xxhash64(F.lit(seed), "id", "row")
    planned = (
        cold.unionByName(rows.join(hot, key).select(*cold.columns))
        .withColumn("draw", draw)
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(2), "draw"), F.ceil(F.col("n") / RANK_ROWS)).cast("int"))
    )
    split = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    bucket_rows = planned.where(split).groupBy("skey", "size", "bucket").agg(F.count("*").alias("held"))
    before = bucket_rows.withColumn(
        "before",
        F.sum("held").over(Window.partitionBy("skey", "size").orderBy("bucket")) - F.col("held"),
    ).drop("held")
    rank = F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy("draw", "id"))
    chosen = (
        planned.where(split)
        .withColumn("rank", rank)
        .join(before, ["skey", "size", "bucket"])
        .withColumn("more", (F.col("before") + F.col("rank") <= F.col("extra")).cast("int"))
    )
    whole = planned.where(~split).withColumn("more", (F.col("extra") > 0).cast("int"))
    columns = ["id", "row", "size", "source_size", "target", (F.col("repeats") + F.col("more")).alias("copies")]
    out = chosen.select(*columns).unionByName(whole.select(*columns))
    return out.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0))


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, columns unchanged, of whatever name.

    Repeated rows (same id and text) share their copies evenly.
    """
    own_id, row, taken, held, turn, copy = fresh(docs.columns, "id", "row", "taken", "held", "turn", "copy")
    copies = mixed.groupBy(F.col("id").alias(own_id), F.col("row").alias(row)).agg(F.sum("copies").alias(taken), F.count("*").alias(held))
    copies = copies.where(F.col(taken) > 0)
    joined = docs.join(copies, docs[id_col].eqNullSafe(copies[own_id]) & (F.xxhash64(docs[text_col]) == copies[row]))
    single = joined.where(F.col(held) == 1).withColumn(turn, F.lit(1))
    shared = joined.where(F.col(held) > 1).withColumn(turn, F.row_number().over(Window.partitionBy(own_id, row).orderBy(F.lit(0))))
    times = F.floor(F.col(taken) / F.col(held)) + (F.col(turn) <= F.col(taken) % F.col(held)).cast("int")
    each = single.unionByName(shared).withColumn(copy, times.cast("int")).where(F.col(copy) > 0)
    own = [column(c) for c in docs.columns]
    return each.select(*own, F.explode(F.sequence(F.lit(1), F.col(copy))).alias(turn)).select(*own)
