"""The cache as a table: set, search, purge and migrate over a folder of changes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.functions import text, vectors
from emberlake.operators import cascade, lexical, lifecycle, nearest, seams
from emberlake.sources import sinks, text_index
from emberlake.sources.entry_table import COMPACT_AFTER, DELETE, PUT, TOUCH, EntryTable
from emberlake.sources.tables import CACHE_ENTRY, SCHEMA_VERSION, exists, migrate, numbered, staged, unstage


def _entities(rows: DataFrame) -> Column:
    """Lower-cased identifiers of rows, none where the column is missing or null."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.transform("entities", lambda x: F.lower(text.clean_edges(x))), none) if "entities" in rows.columns else none


def _metadata(rows: DataFrame) -> Column:
    """What rows carry along as JSON: a string as it is, a map or struct written out, an empty object where there is none."""
    if "metadata" not in rows.columns:
        return F.lit("{}")
    given = F.col("metadata")
    return F.coalesce(given if isinstance(rows.schema["metadata"].dataType, T.StringType) else F.to_json(given), F.lit("{}"))


def _domain(rows: DataFrame) -> Column:
    return F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.lit("general")) if "domain" in rows.columns else F.lit("general")


class RecallEngine:
    """A cache of answers in a folder: a table of changes with compacted bases, and a text index beside it.

    A write appends its entries and the index of their texts, a search appends
    what it touched; a failed one leaves no whole batch, so nothing changes.
    ``permanent_hits`` (0: never) is the number of hits from which an entry no
    longer expires. ``last`` has the counters of the last call: lookups by
    result, writes and extractions. ``totals`` has those of all calls by name and
    labels, with the reasons of misses; ``exposition`` writes them out.
    """

    def __init__(
        self, spark: SparkSession, folder: str, mode: str | Sequence[str] = "semantic", exact_tier: bool = True, floor: float = 0.85, min_score: float = 0.0,
        ttl: int = 86_400, extractor: seams.Model | None = None, permanent_hits: int = 0, compact_after: int = COMPACT_AFTER, memo_ttl: int = 3_600,
    ) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.tiers = cascade.resolve_modes(mode, exact_tier)
        self.floor, self.min_score, self.ttl = floor, min_score, ttl
        self.extractor = extractor if "entity-aware" in self.tiers else None
        self.table = EntryTable(spark, self.folder, ttl, permanent_hits, compact_after)
        self.memo = seams.Memo(spark, f"{self.folder}/memo", T.ArrayType(T.StringType()), memo_ttl)
        self.last: dict[str, int] = {}
        self.totals: Counter[tuple[str, tuple[tuple[str, str], ...]]] = Counter()

    def _count(self, name: str, n: int, **labels: str) -> None:
        self.totals[name, tuple(labels.items())] += n

    def exposition(self, prefix: str = "cache") -> DataFrame:
        """The counters of all calls (a handful of rows) as lines of text: ``line``."""
        rows = [(f"{prefix}_{name}", dict(labels), n) for (name, labels), n in sorted(self.totals.items())]
        metrics = self.spark.createDataFrame(rows, "name string, labels map<string,string>, value long")
        shown = F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
        return metrics.select(F.concat("name", F.lit("{"), F.array_join(shown, ","), F.lit("} "), F.col("value").cast("string")).alias("line"))

    def _extracted(self, rows: DataFrame, now: int) -> DataFrame:
        """Rows with ``entities`` from the extractor where there is one; null where it failed. What it found is kept."""
        if self.extractor is None:
            return rows
        out, counts = self.memo.apply(rows.drop("entities"), "text", "entities", self.extractor, now)
        for name, n in counts.items():
            self.last[name] = self.last.get(name, 0) + n
        self._count("extractor_calls_total", counts["extracted"], outcome="ok")
        self._count("extractor_calls_total", counts["extractor_errors"], outcome="error")
        self._count("extraction_cache_total", counts["memo_hits"], result="hit")
        self._count("extraction_cache_total", counts["extracted"] + counts["extractor_errors"], result="miss")
        return out

    def entries(self) -> DataFrame:
        """The current entries, expired ones too; empty at first."""
        return self.table.entries().select(*CACHE_ENTRY.fieldNames())

    def _put(self, rows: DataFrame, now: int) -> int:
        """Append writes of entries, one a key, and the index of their texts; how many."""
        number = (self.table.batches() or [0])[-1] + 1
        # Unique while a batch has under 2^15 partitions of under 2^28 rows: the batch, the partition, the row.
        place = F.monotonically_increasing_id()
        unique = F.shiftleft(F.lit(number).cast("long"), 43) + F.shiftleft(F.shiftright(place, 33), 28) + place.bitwiseAND(F.lit((1 << 28) - 1))
        rows = staged(rows.withColumn("entry_id", unique))
        n = rows.count()
        if n:
            if {"bm25", "fuzzy"} & set(self.tiers):
                text_index.build(rows, f"{self.folder}/text/c{number}", "entry_id", "text", ["scope"])
            self.table.append(rows.withColumns({"kind": F.lit(PUT), "at": F.lit(now), "count": F.lit(1)}), number)
        unstage(rows)
        return n

    def _index(self) -> text_index.TextIndex:
        """The text index of all entries: the last compacted part, and those of the writes after it."""
        whole = (numbered(self.spark, f"{self.folder}/text", "b") or [0])[-1]
        made = set(self.table.batches())
        parts = [f"{self.folder}/text/b{whole}"] if whole else []
        later = [f"{self.folder}/text/c{n}" for n in sorted(made) if n > whole]
        return text_index.TextIndex(self.spark, parts + [f for f in later if exists(self.spark, f"{f}/made/_SUCCESS")])

    def compact(self) -> None:
        """Merge the changes into the next base, and the parts of the text index into one."""
        numbers = self.table.batches()
        self.table.compact()
        if numbers and {"bm25", "fuzzy"} & set(self.tiers):
            folder = f"{self.folder}/text/b{numbers[-1]}"
            text_index.build(self.table.entries(), folder, "entry_id", "text", ["scope"])
            self.spark.range(0).write.mode("append").parquet(folder)  # marks the part as whole

    def _maintain(self) -> None:
        base = (numbered(self.spark, f"{self.folder}/base", "b") or [0])[-1]
        if sum(n > base for n in self.table.batches()) >= self.table.compact_after:
            self.compact()

    def set(self, rows: DataFrame, now: int) -> None:
        """Store (text, response, scope, embedding): hits 1, a fresh expiry; the last row of a key wins.

        ``entities`` (array of identifiers), ``domain`` and ``metadata`` (JSON, a
        map or a struct) are stored where the
        rows have them; a blank domain is ``general``. Without tiers nothing is
        stored; without a semantic or entity-aware tier no vector is. With an
        ``extractor`` (entity-aware tiers only) entities are its answers.
        """
        if not self.tiers:
            return
        self.last = {}
        skipped = Observation()
        if self.extractor is not None:  # a row whose entities could not be found is not stored
            rows = self._extracted(rows, now).observe(skipped, F.count_if(F.col("entities").isNull()).alias("n")).where(F.col("entities").isNotNull())
        clean = text.clean(F.col("text"))
        given = _entities(rows)
        vector = vectors.normalised(F.col("embedding")).cast("array<float>") if {"semantic", "entity-aware"} & set(self.tiers) else F.lit(None).cast("array<float>")
        fresh = rows.select(
            text.entry_key(F.col("scope"), clean).alias("entry_key"), text.scope_tag(F.col("scope")).alias("scope"), _domain(rows).alias("domain"),
            clean.alias("text"), "response", _metadata(rows).alias("metadata"), F.to_json(given).alias("entities"), text.entity_signature(given).alias("entity_sig"),
            vector.alias("embedding"), F.lit(1).alias("hits"), F.lit(now).cast("long").alias("ts"), F.lit(now + self.ttl).cast("long").alias("expires_at"),
            F.lit(SCHEMA_VERSION).alias("schema_version"),
        )
        self.last["writes"] = self._put(sinks.latest(fresh, ["entry_key"], [F.desc("ts"), F.desc("response")]), now)
        self._count("writes_total", self.last["writes"], outcome="ok")
        if self.extractor is not None:
            self._count("writes_total", skipped.get["n"], outcome="skipped_extractor_error")
        self._maintain()

    def search(self, queries: DataFrame, now: int) -> DataFrame:
        """Answers for (query_id, text, scope, embedding): hit, method, similarity, response, metadata and reason.

        ``reason`` says why a query missed, by the last tier: ``extractor_error``,
        ``below_threshold`` where there were candidates, else ``no_candidate``.

        The entity-aware tier also reads ``entities`` and ``domain`` of queries
        that have them: of the ten nearest entries of the scope and domain the
        first that shares an entity and reaches the floor answers. A hit counts,
        renews the entry's expiry and may make it permanent.
        """
        self.last = {}
        held = lifecycle.live(self.table.entries(), F.lit(now))
        clean = queries.withColumn("text", text.clean(F.col("text"))).withColumn("entry_key", text.entry_key(F.col("scope"), F.col("text")))
        clean = clean.withColumn("scope", text.scope_tag(F.col("scope")))

        near, failed = [], []  # of the last tier: its candidates, staged, and the queries whose extraction failed

        def candidates(tier: str, found: DataFrame) -> DataFrame:
            if tier == self.tiers[-1]:
                found = staged(found)
                near.append(found)
            return found

        def lexical_tier(fuzzy: bool):
            tier = "fuzzy" if fuzzy else "bm25"
            least = 0.0 if tier in self.tiers[-1:] else self.min_score

            def run(left: DataFrame) -> DataFrame:
                index = self._index()
                asked = lexical.query_words(left, "query_id", "text", "scope")
                if not index.folders:
                    return left.where("false").select("query_id", F.lit(0).cast("long").alias("entry_id"), F.lit(None).cast("double").alias("similarity"))
                if fuzzy:
                    found = lexical.best_match(lexical.indexed_fuzzy(index, asked, scoped=("scope",), live=held), least)
                else:
                    found = lexical.indexed_best(index, asked, "BM25", least, scoped=("scope",), live=held)
                found = candidates(tier, found.select("query_id", "entry_id", "score")).where(F.col("score") >= self.min_score)
                return found.select("query_id", "entry_id", F.lit(None).cast("double").alias("similarity"))

            return run

        def semantic(left: DataFrame) -> DataFrame:
            mine = left.select(F.col("query_id").alias("qid"), vectors.normalised(F.col("embedding")).alias("v"), "scope").where("v is not null")
            rows = held.select(F.col("entry_id").alias("rid"), F.col("embedding").alias("v"), "scope").where("v is not null")
            least = None if self.tiers[-1] == "semantic" else self.floor
            found = nearest.nearest(mine, rows, 1, floor=least, on=["scope"]).where("rank = 1")
            found = candidates("semantic", found.select(F.col("qid").alias("query_id"), F.col("rid").alias("entry_id"), "similarity"))
            return found.where(F.col("similarity") >= self.floor)

        def entity_aware(left: DataFrame) -> DataFrame:
            if self.extractor is not None:  # a failure is a miss of this tier alone
                left = self._extracted(left, now)
                if self.tiers[-1] == "entity-aware":
                    failed.append(left.where(F.col("entities").isNull()).select("query_id"))
                left = left.where(F.col("entities").isNotNull())
            domain, own = _domain(left), _entities(left)
            mine = left.select(F.col("query_id").alias("qid"), vectors.normalised(F.col("embedding")).alias("v"), "scope", domain.alias("domain"), own.alias("asked")).where("v is not null")
            rows = held.select(F.col("entry_id").alias("rid"), F.col("embedding").alias("v"), "scope", "domain").where("v is not null")
            found = nearest.nearest(mine.drop("asked"), rows, 10, on=["scope", "domain"])
            kept = held.select(F.col("entry_id").alias("rid"), F.from_json("entities", "array<string>").alias("kept"))
            ranked = found.join(mine.select("qid", "asked"), "qid").join(kept, "rid").withColumnsRenamed({"qid": "query_id", "rid": "entry_id"})
            ranked = candidates("entity-aware", ranked)
            return cascade.entity_aware_hits(ranked, text.entities_overlap(F.col("asked"), F.col("kept")), self.floor)

        known = {"entity-aware": entity_aware, "exact": lambda left: cascade.exact_hits(left.hint("merge"), held), "bm25": lexical_tier(False), "fuzzy": lexical_tier(True), "semantic": semantic}
        tiers = [(t, known[t]) for t in self.tiers]
        if not tiers:
            return queries.select("query_id", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("double").alias("similarity"), *[F.lit(None).cast("string").alias(c) for c in ("response", "metadata", "reason")])
        answers = held.select("entry_id", "entry_key", F.col("scope").alias("entry_scope"), "response", "metadata")
        out = hits = cascade.cascade(clean, tiers, answers)
        seen = Observation()
        reason = F.lit("no_candidate")
        for name, ids in [*(("below_threshold", x) for x in near), *(("extractor_error", x) for x in failed)]:
            out = out.join(ids.select("query_id").distinct().withColumn(f"__{name}", F.lit(True)).hint("merge"), "query_id", "left")
            reason = F.when(F.col(f"__{name}"), name).otherwise(reason)
        out = out.withColumn("reason", F.when(~F.col("hit"), reason)).drop(*[f"__{r}" for r in cascade.REASONS])
        misses = [F.count_if(F.col("reason") == r).alias(f"miss_{r}") for r in cascade.REASONS]
        out = out.observe(seen, F.count("*").alias("lookups"), F.count_if("hit").alias("hits"), *[F.count_if(F.col("method") == t).alias(f"hits_{t}") for t in self.tiers], *misses)
        out = staged(out)
        unstage(*hits._parts, *near)
        counts = dict(seen.get)
        for r in cascade.REASONS:
            self._count("lookups_total", counts.pop(f"miss_{r}"), result="miss", reason=r)
        self._count("lookups_total", counts["hits"], result="hit", reason="hit")
        self.last |= counts
        if self.last["hits"]:
            touched = out.where("hit").groupBy("entry_id", "entry_key", F.col("entry_scope").alias("scope")).count()
            self.table.append(touched.withColumns({"kind": F.lit(TOUCH), "at": F.lit(now)}))
            self._maintain()
        return out.select("query_id", "hit", "method", "similarity", "response", "metadata", "reason")

    def purge(self, scope: str | None = None, now: int = 0) -> int:
        """Delete everything, or one scope, of which alone the stored folder is read; the number of entries that went."""
        if scope is None:
            rows = self.table.entries()
        else:
            tag = self.spark.range(1).select(text.scope_tag(F.lit(scope))).first()[0]
            rows = self.table.of_scope(tag)
        gone = staged(rows.select("entry_key", "entry_id", "scope"))
        n = gone.count()
        if n:
            self.table.append(gone.withColumns({"kind": F.lit(DELETE), "at": F.lit(now)}))
        unstage(gone)
        return n

    def migrate(self, now: int = 0) -> int:
        """Fill the later columns of old entries; how many had to be."""
        rows = migrate(self.table.entries())
        return self._put(rows.where("migrated").select(*CACHE_ENTRY.fieldNames()), now)
