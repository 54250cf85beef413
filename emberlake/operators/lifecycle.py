"""Entry lifecycle: hits, sliding expiry, promotion, purge, rebuild and eviction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replay_hits(events: DataFrame, keys: Sequence[str], ts: Column, tie: str, ttl: float, threshold: int) -> DataFrame:
    """Replay lookups of keys in order: a miss writes the entry, a hit renews it, enough hits make it permanent.

    ``ts`` is in seconds. A gap of ``ttl`` or more starts a new island (the
    entry expired); the row whose turn in its island reaches ``threshold`` (two
    at least) promotes, and every later row of the key hits. Adds ``island``,
    ``turn``, ``promotes`` and ``hit``. ``threshold`` 0 never promotes.
    """
    order = Window.partitionBy(*keys).orderBy("__ts", tie)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.col("__ts") - F.lag("__ts").over(order)
    rows = events.withColumn("__ts", ts).withColumn("__new", F.when(gap.isNull() | (gap >= ttl), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("__new").over(so_far))
    # The turn within an island, from the row number of its start: no second sort by island.
    rows = rows.withColumn("__n", F.row_number().over(order))
    rows = rows.withColumn("turn", F.col("__n") - F.max(F.when(F.col("__new") == 1, F.col("__n"))).over(so_far) + 1)
    reached = (F.col("turn") == max(threshold, 2)) if threshold > 0 else F.lit(False)
    rows = rows.withColumn("__reached", F.min(F.when(reached, F.col("__n"))).over(so_far))
    permanent = F.coalesce(F.col("__n") > F.col("__reached"), F.lit(False))
    return (
        rows.withColumn("hit", (F.col("turn") > 1) | permanent)
        .withColumn("promotes", F.coalesce(F.col("__n") == F.col("__reached"), F.lit(False)))
        .drop("__ts", "__new", "__n", "__reached")
    )


def live(entries: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Entries without an expiry or with one after ``now``."""
    return entries.where(F.col(expires).isNull() | (F.col(expires) > now))


def rebuild(mirror: DataFrame, present: DataFrame, key: str, now: Column, expires: str = "expires_at") -> DataFrame:
    """Mirror rows to restore: absent from the cache and with whole seconds left; null is permanent."""
    left = F.floor(F.col(expires) - now).cast("long")
    absent = mirror.join(present.select(key), key, "left_anti")
    return absent.withColumn("remaining", left).where(F.col("remaining").isNull() | (F.col("remaining") > 0))


def purge(entries: DataFrame, scopes: DataFrame, scope: str = "scope") -> tuple[DataFrame, DataFrame]:
    """(kept, counts by purged scope)."""
    counts = entries.join(scopes.select(scope).distinct(), scope, "left_semi").groupBy(scope).agg(F.count("*").alias("purged"))
    return entries.join(scopes.select(scope), scope, "left_anti"), counts


def keep_recent(rows: DataFrame, by: Sequence[str], recency: Sequence[Column], entries: int, bytes_col: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """Least-recently-used eviction: ``kept`` for the newest ``entries`` of each pool, within
    ``max_bytes`` counted from the newest, and never fewer than one."""
    order = Window.partitionBy(*by).orderBy(*recency)
    turn = F.row_number().over(order)
    kept = turn <= entries
    if bytes_col is not None:
        held = F.sum(bytes_col).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        kept = (kept & (held <= max_bytes)) | (turn == 1)
    return rows.withColumn("kept", kept)


def fixed_memo(events: DataFrame, keys: Sequence[str], ts: Column, tie: str, ttl: float) -> DataFrame:
    """A memo whose expiry counts from its write and does not slide: ``hit`` per lookup, in one streaming pass.

    Rows are sorted by key and time; a task holds one key's write time only.
    """
    columns = [*events.columns, "hit"]
    schema = events.withColumn("hit", F.lit(True)).schema
    ordered = events.withColumn("__ts", ts.cast("double")).repartition(*keys).sortWithinPartitions(*keys, "__ts", tie)

    def run(batches):
        key, written = None, None
        for pdf in batches:
            hits = []
            for own, at in zip(pdf[list(keys)].itertuples(index=False, name=None), pdf["__ts"]):
                if own != key or at - written >= ttl:
                    key, written = own, at
                    hits.append(False)
                else:
                    hits.append(True)
            yield pdf.assign(hit=hits)[columns]

    return ordered.mapInPandas(run, schema)


def rate_limit(events: DataFrame, keys: Sequence[str], ts: Column, tie: str, limit: int = 60, window: float = 60.0) -> DataFrame:
    """A sliding log per key: ``allowed`` unless ``limit`` allowed requests lie in the last ``window`` seconds.

    Refused requests are not logged; one exactly at the window's edge still
    counts. A task holds at most ``limit`` times of one key.
    """
    from collections import deque

    columns = [*events.columns, "allowed"]
    schema = events.withColumn("allowed", F.lit(True)).schema
    ordered = events.withColumn("__ts", ts.cast("double")).repartition(*keys).sortWithinPartitions(*keys, "__ts", tie)

    def run(batches):
        key, log = None, deque()
        for pdf in batches:
            allowed = []
            for own, at in zip(pdf[list(keys)].itertuples(index=False, name=None), pdf["__ts"]):
                if own != key:
                    key, log = own, deque()
                while log and log[0] < at - window:
                    log.popleft()
                allowed.append(len(log) < limit)
                if allowed[-1]:
                    log.append(at)
            yield pdf.assign(allowed=allowed)[columns]

    return ordered.mapInPandas(run, schema)


def breaker_step(state: tuple[float, int, float] | None, at: float, failed: bool, window: float, threshold: int, cooldown: float) -> tuple[tuple[float, int, float] | None, bool]:
    """One request through a circuit breaker: the next (window start, failures, open until) and whether it was refused."""
    if state is not None and state[2] > at:
        return state, True
    if state is not None and state[2]:
        state = (state[0], 0, 0.0)  # half open: one request tries
    if not failed:
        return None, False
    start, failures, until = state or (0.0, 0, 0.0)
    if at - start > window:
        start, failures = at, 0
    failures += 1
    if failures >= threshold and not until:
        until = at + cooldown
    return (start, failures, until), False


def breaker(events: DataFrame, keys: Sequence[str], ts: Column, tie: str, failed: Column, window: float = 60.0, threshold: int = 10, cooldown: float = 30.0) -> DataFrame:
    """Circuit breaker per key over requests in order: ``refused`` while open, ``failures`` after each request."""
    columns = [*events.columns, "refused", "failures"]
    schema = events.withColumn("refused", F.lit(True)).withColumn("failures", F.lit(0)).schema
    ordered = events.withColumn("__ts", ts.cast("double")).withColumn("__bad", failed).repartition(*keys).sortWithinPartitions(*keys, "__ts", tie)

    def run(batches):
        key, state = None, None
        for pdf in batches:
            out = []
            for own, at, bad in zip(pdf[list(keys)].itertuples(index=False, name=None), pdf["__ts"], pdf["__bad"]):
                if own != key:
                    key, state = own, None
                state, refused = breaker_step(state, at, bad, window, threshold, cooldown)
                out.append((refused, state[1] if state else 0))
            yield pdf.assign(refused=[x[0] for x in out], failures=[x[1] for x in out])[columns]

    return ordered.mapInPandas(run, schema)
