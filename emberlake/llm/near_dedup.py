"""MinHash near-deduplication with darts.

A text is a weighted set of five-word shingles (weight: how often it occurs).
Darts are thrown into each element's region: one unit-rate stream of ranks for
each unit of weight, drawn from the element's hash, so that texts that share an
element share its darts. Only darts under a rank limit that holds about
K ln K + 2K of them are made; each dart falls on one of K coordinates, and a
coordinate keeps its earliest dart. Signatures are cut into bands; texts that
share a band are candidates, and every candidate pair is verified exactly.

Equal texts are folded into one before signatures are made. In a band's bucket each
text is paired with the bucket's least id and with its neighbour in the order
of another hash, not with every other text; texts that fail against the least id
are compared again among themselves, with the least id among them, for up to
``ROUNDS`` more rounds. Buckets that then still hold several components are
settled exactly: few pairs are compared one by one, and what lies outside a
crowd's largest component is compared with all of the crowd in blocks, as matrix
products that pass on only what joins components. Every two texts that share a
band are thus linked, connected over others, or proven to be under the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlake.llm.common import column, dealt, fresh, join_spread, stage, unstage
from emberlake.llm.textkit import mix64, shingle_hashes, slices

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 125
BANDS = 25
ROWS = COORDINATES // BANDS
BUCKET_ROWS = 5_000
ROUNDS = 2  # of comparisons with heads before what is left is settled exactly
DIRECT = 4  # pairs a member up to which a bucket's rest is compared one by one
CROWD_ROWS = 256  # texts of a block in which a crowd is compared
ELEMENT_COLUMNS = 4_096  # shared shingles in a slice of a block's matrix
LAYER = np.uint64(0xD1B54A32D192ED03)


def _exponential(h: np.ndarray) -> np.ndarray:
    return -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owners: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """Signatures (n, k) of ``n`` weighted sets given as parallel arrays of element, weight and owner.

    Weights may be fractions: the last, partial layer keeps a dart only if its
    position lies under the remaining weight. Sets without weight get zeros.
    """
    total = np.bincount(owners, weights, n) if len(owners) else np.zeros(n)
    limit = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    best = np.full((n, k), np.uint64(2**64 - 1))
    low = np.zeros(n)
    todo = total > 0
    while todo.any():
        use = np.flatnonzero(todo[owners])
        layers = np.ceil(weights[use]).astype(np.int64)
        who = np.repeat(use, layers)
        layer = np.arange(len(who)) - np.repeat(np.cumsum(layers) - layers, layers)
        height = np.minimum(1.0, weights[who] - layer)
        region = mix64(elements[who] + layer.astype(np.uint64) * LAYER)
        owner, rank, stream = owners[who], np.zeros(len(who)), region
        while len(stream):
            stream = stream + np.uint64(0x9E3779B97F4A7C15)
            dart = mix64(stream)
            rank = rank + _exponential(dart)
            alive = rank < limit[owner]
            stream, owner, rank, height, dart = stream[alive], owner[alive], rank[alive], height[alive], dart[alive]
            inside = (rank >= low[owner]) & (((mix64(dart + LAYER) >> np.uint64(40)).astype(np.float64) / (1 << 24)) < height)
            name = mix64(dart[inside] ^ LAYER)
            key = rank[inside].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | (name >> np.uint64(32))
            at = owner[inside] * k + (name % np.uint64(k)).astype(np.int64)
            np.minimum.at(best.reshape(-1), at, key)
        todo &= (best == np.uint64(2**64 - 1)).any(axis=1)  # a coordinate without a dart: throw further
        low = np.where(todo, limit, low)
        limit = np.where(todo, 2 * limit, limit)
    signature = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    signature[total <= 0] = 0
    return signature


def distinct_shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts as (hashes, counts, offsets by text), sorted within each text."""
    shingles, at = shingle_hashes(texts, SHINGLE)
    owners = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((shingles, owners))
    h, o = shingles[order], owners[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    begin = np.flatnonzero(first)
    return h[begin], np.diff(np.append(begin, len(h))), np.searchsorted(o[begin], np.arange(len(texts) + 1))


def text_signatures(texts: list[str | None], k: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts, k), and how many distinct shingles each text has."""
    h, counts, offsets = distinct_shingles(texts)
    sizes = np.diff(offsets)
    return dart_signatures(h, counts.astype(np.float64), np.repeat(np.arange(len(texts)), sizes), len(texts), k), sizes


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    rows = signatures.reshape(len(signatures), bands, signatures.shape[1] // bands).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64) * LAYER
    key = np.repeat(key[None, :], len(signatures), axis=0)
    for r in range(rows.shape[2]):
        key = mix64(key ^ rows[:, :, r])
    return key.view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bands): the band keys of each text; none for a text without words."""
    for part in slices(batches, "text", 200_000):
        signatures, sizes = text_signatures(part.column("text").to_pylist())
        filled = sizes > 0
        ends = np.concatenate([[0], np.cumsum(filled * BANDS)]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(signatures[filled], BANDS).ravel()))
        yield pa.RecordBatch.from_arrays([part.column("id"), bands], names=["id", "bands"])


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, shingles, again): 64-bit hashes of the distinct shingles, and (place, extra weight) of those that repeat."""
    for part in slices(batches, "text", 200_000):
        hashes, counts, at = distinct_shingles(part.column("text").to_pylist())
        shingles = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
        heavy = np.flatnonzero(counts > 1)
        owner = np.searchsorted(at, heavy, side="right") - 1
        ends = np.concatenate([[0], np.cumsum(2 * np.bincount(owner, minlength=len(part)))]).astype(np.int32)
        pairs = np.stack([heavy - at[owner], counts[heavy] - 1], axis=1).ravel().astype(np.int32)
        again = pa.ListArray.from_arrays(pa.array(ends), pa.array(pairs))
        yield pa.RecordBatch.from_arrays([part.column("id"), shingles, again], names=["id", "shingles", "again"])


def _weights(n: int, again: np.ndarray) -> np.ndarray:
    w = np.ones(n, np.int64)
    w[again[0::2]] += again[1::2]
    return w


def jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Generalised Jaccard similarity of two weighted sets with distinct elements."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = np.minimum(wa[i], wb[j]).sum()
    return float(shared / (wa.sum() + wb.sum() - shared))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for s, g in (("sa", "ga"), ("sb", "gb")):
            values, repeats = batch.column(s), batch.column(g)
            sides.append((values.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(values).to_numpy())]), repeats.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(repeats).to_numpy())])))
        score = np.empty(len(batch))
        for i in range(len(batch)):
            x, y = [(v[o[i] : o[i + 1]], _weights(o[i + 1] - o[i], r[p[i] : p[i + 1]])) for v, o, r, p in sides]
            score[i] = jaccard(*x, *y)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(score)], names=["a", "b", "score"])


def _scored(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Exact similarity of distinct pairs (a, b)."""
    side = features.select("id", "shingles", "again")
    left = side.select(F.col("id").alias("a"), F.col("shingles").alias("sa"), F.col("again").alias("ga"))
    right = side.select(F.col("id").alias("b"), F.col("shingles").alias("sb"), F.col("again").alias("gb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "ga", "sb", "gb").mapInArrow(_verify, "a long, b long, score double")


def components(links: DataFrame) -> DataFrame:
    """(id, root): connected components of (a, b), root the least id in each.

    Every round hangs each node of the remaining links under the least node
    around it, follows that one step further, and contracts: links between
    nodes that now have one root go, the others join the roots. All but local
    minima vanish in a round, so links shrink fast and long chains halve.
    Rounds are staged; nothing but a count of links reaches the driver.
    """
    left = stage(links.select("a", "b").distinct(), "contracted")
    labels = stage(left.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")), "labels")
    while left.limit(1).count():
        ends = left.select("a", F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("other")))
        hung = stage(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("other"), F.col("a")).alias("up")), "hung")
        further = hung.select(F.col("node").alias("up"), F.col("up").alias("top"))
        tops = stage(join_spread(hung, further, "up").select("node", "top"), "tops")
        renamed = join_spread(labels, tops.select(F.col("node").alias("root"), "top"), "root", "left")
        renamed = stage(renamed.select("id", F.coalesce("top", "root").alias("root")), "labels")
        one = join_spread(left, tops.select(F.col("node").alias("a"), F.col("top").alias("top_a")), "a")
        half = stage(one.select("b", "top_a"), "half")
        moved = join_spread(half, tops.select(F.col("node").alias("b"), F.col("top").alias("top_b")), "b").where(F.col("top_a") != F.col("top_b"))
        moved = stage(moved.select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b")).distinct(), "contracted")
        unstage(hung, tops, labels, left, half)
        labels, left = renamed, moved
    unstage(left)
    return labels


def _crossing(rows: DataFrame) -> DataFrame:
    """Pairs (a < b) of (key, id, comp) that share a key and lie in different components; for keys of few such pairs.

    Members of a key's largest component meet only those outside it, so a
    component costs nothing among itself.
    """
    keys = _tallied(rows).where("n > m").select("key", "major")
    held = join_spread(rows, keys, "key").withColumn("minor", F.col("comp") != F.col("major"))
    left = held.where("minor").select("key", F.col("id").alias("x"), F.col("comp").alias("cx"))
    right = held.select("key", F.col("id").alias("y"), F.col("comp").alias("cy"), "minor")
    met = left.join(right, "key").where((F.col("cx") != F.col("cy")) & (~F.col("minor") | (F.col("x") < F.col("y"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _tallied(rows: DataFrame) -> DataFrame:
    """(key, n, major, m, within): members of each key, its largest component, and the pairs inside components, doubled."""
    counts = rows.groupBy("key", "comp").agg(F.count("*").alias("m"))
    made = counts.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "comp")).alias("top"), F.sum(F.col("m") * F.col("m")).alias("within"))
    return made.select("key", "n", F.col("top.comp").alias("major"), F.col("top.m").alias("m"), "within")


def _elements(shingles: pa.ListArray, again: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multisets as sets: (element, owner, size by owner), the k-th copy of a shingle being an element of its own."""
    owners, values, n = [], [], len(shingles)
    for row in range(n):
        h = shingles[row].values.to_numpy()
        w = _weights(len(h), again[row].values.to_numpy())
        copy = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        values.append(mix64(np.repeat(h.view(np.uint64), w) + copy.astype(np.uint64) * LAYER))
        owners.append(np.full(len(copy), row))
    values, owners = np.concatenate(values), np.concatenate(owners)
    return values, owners, np.bincount(owners, minlength=n)


def _overlaps(values: np.ndarray, owners: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """How many elements each owner of ``left`` shares with each of ``right``: matrix products over slices of the elements."""
    _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    column, owners = (np.cumsum(counts > 1) - 1)[column[shared]], owners[shared]
    order = np.argsort(column, kind="stable")
    column, owners = column[order], owners[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, ELEMENT_COLUMNS):
        low, high = np.searchsorted(column, [begin, begin + ELEMENT_COLUMNS])
        held = np.zeros((n, ELEMENT_COLUMNS), np.float32)
        held[owners[low:high], column[low:high] - begin] = 1
        out += held[left] @ held[right].T
    return out


def _settled(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        ids, comps = rows.column("id").to_numpy(), rows.column("comp").to_numpy()
        left, right = (np.flatnonzero(rows.column(c).to_numpy()) for c in ("left", "right"))
        listed = [rows.column(c).combine_chunks() for c in ("shingles", "again")]
        values, owners, sizes = _elements(*[c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in listed])
        shared = _overlaps(values, owners, left, right, len(ids))
        score = shared / (sizes[left][:, None] + sizes[right][None, :] - shared)
        at, to = np.nonzero((score >= threshold) & (comps[left][:, None] != comps[right][None, :]))
        top: dict[int, int] = {}

        def root(x: int) -> int:
            while top.get(x, x) != x:
                x = top[x]
            return x

        made = []
        for a, b in zip(left[at].tolist(), right[to].tolist()):
            x, y = root(int(comps[a])), root(int(comps[b]))
            if x != y:  # the links of a block that join its components, no others
                top[max(x, y)] = min(x, y)
                made.append(sorted((int(ids[a]), int(ids[b]))))
        made = np.array(made, np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])

    return run


def _crowd_links(rows: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """Links (a < b) that join the components of (key, id, comp) in each key, by comparing its blocks.

    A key's members outside its largest component are dealt into blocks of
    ``CROWD_ROWS``, those inside it into others. Each block of the former is
    compared with every block, each two as one matrix product: no pair becomes a
    row, and only the links that join components leave a block.
    """
    parts = lambda n: F.ceil(n / CROWD_ROWS).cast("int")
    keys = stage(_tallied(rows).select("key", "major", parts(F.col("n") - F.col("m")).alias("outer"), parts(F.col("m")).alias("inner")), "crowds")
    held = join_spread(rows, keys, "key").withColumn("minor", F.col("comp") != F.col("major"))
    held = held.withColumn("place", F.pmod(F.xxhash64("id"), F.when(F.col("minor"), F.col("outer")).otherwise(F.col("inner"))).cast("int"))
    block = lambda inside, i, j, left, right: F.struct(F.lit(inside).alias("inside"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    place, yes, no = F.col("place"), F.lit(True), F.lit(False)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    outer = F.concat(
        F.transform(upto("outer"), lambda k: block(False, F.least(place, k), F.greatest(place, k), place <= k, place >= k)),
        F.transform(upto("inner"), lambda k: block(True, place, k, yes, no)),
    )
    inner = F.transform(upto("outer"), lambda k: block(True, k, place, no, yes))
    dealt_out = held.select("key", "id", "comp", F.explode(F.when(F.col("minor"), outer).otherwise(inner)).alias("b")).select("key", "id", "comp", "b.*")
    whole = dealt_out.join(features.select("id", "shingles", "again"), "id")
    found = whole.groupBy("key", "inside", "i", "j").applyInArrow(_settled(threshold), "a long, b long")
    out = stage(found.distinct(), "crowd")
    unstage(keys)
    return out


def _links(banded: DataFrame, texts: Callable[[DataFrame], DataFrame], threshold: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Verified links (a < b) between different texts and their components (id, root), staged; what led to them is deleted.

    ``banded`` has the bands of every distinct text, ``texts`` gives (id, text) for a set of ids.
    """
    scratch = [banded]

    def keep(df: DataFrame, label: str) -> DataFrame:
        scratch.append(stage(df, label))
        return scratch[-1]

    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    buckets = keep(banded.select("id", F.explode(F.array_distinct("bands")).alias("band")), "buckets")
    heads = keep(buckets.groupBy("band").agg(F.min("id").alias("head"), F.count("*").alias("n")).where(F.col("n") > 1), "heads")
    members = keep(join_spread(buckets, heads, "band"), "members")
    # One order of ids for all bands: neighbours in one band are mostly neighbours in the next.
    salted = members.where("n > 2").withColumn("spot", F.xxhash64("id"))
    salted = salted.withColumn("salt", F.floor(F.col("spot") / F.lit(2.0**64) * F.ceil(F.col("n") / BUCKET_ROWS)))
    order = Window.partitionBy("band", "salt").orderBy("spot")
    neighbour = salted.withColumn("near", F.lag("id").over(order)).where(F.col("near").isNotNull())
    todo = members.where(F.col("id") != F.col("head")).select("id", "band", "head")
    pairs = keep(todo.select(*pair("head", "id")).unionByName(neighbour.select(*pair("near", "id"))).distinct(), "pairs")
    involved = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = keep(texts(involved).mapInArrow(_weighed, "id long, shingles array<long>, again array<int>"), "shingles")
    found = scored = keep(_scored(pairs, held), "scored")
    for _ in range(rounds):
        far = scored.where(F.col("score") < threshold)
        failed = keep(todo.join(far, (F.col("a") == F.col("head")) & (F.col("b") == F.col("id"))).select("id", "band"), "failed")
        heads = failed.groupBy("band").agg(F.min("id").alias("head"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
        todo = keep(join_spread(failed, heads, "band").where(F.col("id") != F.col("head")), "again")
        pairs = todo.select(*pair("head", "id")).distinct()
        if not pairs.limit(1).count():
            break
        known = found.join(pairs, ["a", "b"], "left_semi")
        scored = keep(_scored(pairs.join(found, ["a", "b"], "left_anti"), held).unionByName(known).distinct(), "scored")
        found = found.unionByName(scored)
    links = stage(found.where(F.col("score") >= threshold).select("a", "b").distinct(), "links")
    roots = components(links)
    # What the rounds left: pairs of a bucket whose members are not connected.
    crowded = members.where("n > 2").select(F.col("band").alias("key"), "id").join(roots, "id", "left")
    crowded = keep(crowded.select("key", "id", F.coalesce("root", "id").alias("comp")), "crowded")
    tallies = _tallied(crowded)
    open_pairs = (F.col("n") * F.col("n") - F.col("within")) / 2
    tallies = keep(tallies.where(open_pairs > 0).select("key", (open_pairs > DIRECT * F.col("n")).alias("dense")), "open")
    few = keep(crowded.join(tallies.where("not dense"), "key", "left_semi"), "few")
    left = keep(_crossing(few).join(found, ["a", "b"], "left_anti"), "left")
    more = _scored(left, held).where(F.col("score") >= threshold).select("a", "b")
    dense = keep(crowded.join(tallies.where("dense"), "key", "left_semi"), "dense")
    if dense.limit(1).count():
        more = more.unionByName(keep(_crowd_links(dense, held, threshold), "crowds"))
    more = keep(more, "more")
    if more.limit(1).count():
        scratch += [links, roots]
        links = stage(links.unionByName(more).distinct(), "links")
        roots = components(links)
    unstage(*scratch)
    return links, roots


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Callable[[DataFrame | None], DataFrame]]:
    """One text an id and one id a text: (id, text_id, key, n) staged, and a reader of the texts.

    ``key`` is the text's hash, ``n`` how many rows have the id. The reader
    gives (id, text), once for each distinct text that is not null, of all or
    of the given ``id`` rows. Only ids and hashes move to find them.
    """
    texts = F.col(text_col)
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), texts.cast("string").alias("text"))
    key = F.when(F.col("text").isNull(), F.concat(F.lit("null"), F.col("id").cast("string"))).otherwise(F.md5(F.col("text").cast("binary")))
    hashed = stage(own.select("id", key.alias("key")).groupBy("id").agg(F.min("key").alias("key"), F.count("*").alias("n")), "hashed")
    firsts = hashed.groupBy("key").agg(F.min("id").alias("text_id"))
    same = stage(join_spread(hashed, firsts, "key").select("id", "text_id", "key", "n"), "texts")
    unstage(hashed)
    repeated = same.where((F.col("n") > 1) & (F.col("id") == F.col("text_id")) & ~F.startswith("key", F.lit("null"))).select("id", "key")
    some = repeated.limit(1).count() > 0
    filled = own.where("text is not null")

    def read(wanted: DataFrame | None = None) -> DataFrame:
        if wanted is None:
            single = filled.join(same.where((F.col("n") > 1) | (F.col("id") != F.col("text_id"))).select("id"), "id", "left_anti")
        else:
            ids = wanted.join(repeated, "id", "left_anti") if some else wanted
            single = filled.join(ids.hint("merge"), "id", "left_semi")  # texts move once, whatever the number of candidates
        if not some:
            return single
        often = repeated if wanted is None else repeated.join(wanted, "id", "left_semi")
        rows = filled.join(often, "id").where(F.md5(F.col("text").cast("binary")) == F.col("key"))
        return single.unionByName(rows.groupBy("id").agg(F.min("text").alias("text")))

    return same, read


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS
) -> DataFrame:
    """One row per id: its class of near-duplicates and its links.

    Returns ``id`` (cast to long), ``class_id`` (the least id of its class),
    ``text_id`` (the least id with an equal text) and ``n_links`` (the links of
    its text to other texts that joining its class took). Two texts are linked if their five-word
    shingles, compared as lower-cased multisets by 64-bit hashes, have a
    generalised Jaccard similarity of at least ``threshold``; classes are the
    connected components of links and equal texts. A null text or one without
    words is in a class with its equals only; a null text equals none but
    itself. An id with several rows counts once, with the text of the least
    hash; its other texts take no part. Null ids get no row, an empty table
    gives none. The result is staged; what led to it is deleted.
    """
    same, read = _chosen(docs, id_col, text_col)
    banded = stage(dealt(read()).mapInArrow(_banded, "id long, bands array<long>"), "bands")
    links, roots = _links(banded, read, threshold, rounds)
    degree = links.select(F.explode(F.array("a", "b")).alias("text_id")).groupBy("text_id").agg(F.count("*").alias("n_links"))
    found = roots.withColumnRenamed("id", "text_id").join(degree, "text_id")
    out = join_spread(same.select("id", "text_id"), found, "text_id", "left")
    out = stage(out.select("id", F.coalesce("root", "text_id").alias("class_id"), "text_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    unstage(same, links, roots)
    return out


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class left: one of the least id.

    Where that id has several rows, the one of the least text hash stays. Rows
    with a null id stay. Columns, of whatever name, are unchanged.
    """
    classes = near_duplicates(docs, threshold, id_col, text_col)
    own_id, own, rest = fresh(docs.columns, "kept_id", "row", "n")
    gone = classes.where(F.col("id") != F.col("class_id")).select(F.col("id").alias(own_id))
    left = docs.join(gone, docs[id_col].cast("long") == gone[own_id], "left_anti")
    often = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias(own_id)).agg(F.count("*").alias(rest)).where(F.col(rest) > 1)
    often = stage(often.select(own_id), "repeated")
    if not often.limit(1).count():
        unstage(often)
        return left
    once = left.join(often, left[id_col].cast("long") == often[own_id], "left_anti")
    several = left.join(often, left[id_col].cast("long") == often[own_id])
    best = several.groupBy(own_id).agg(F.min_by(F.struct(*[column(c) for c in docs.columns]), F.coalesce(F.md5(several[text_col].cast("binary")), F.lit("~"))).alias(own))
    return once.unionByName(best.select(f"{own}.*"))
