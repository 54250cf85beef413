"""Periodic runs of words, by the algorithm of Kolpakov and Kucherov.

A run is a maximal stretch in which words one period apart are identical. The
suffix automaton of a stretch of words gives its Lempel-Ziv factors. Runs that
touch or cross the border of two factors are found by Main's algorithm: for
each period, how far the words to the left and to the right of the border go
on repeating. Every other run lies inside one factor, so it is copied from the
factor's earlier occurrence.

Before that, a document is cut at the words that no run can hold: in a run of
exponent e each word occurs e times at least. What is left of plain prose is
little; stretches that do repeat go through the algorithm whole.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import column, dealt, prepare
from emberlake.llm.textkit import mix64, slices

MIN_LENGTH, MIN_EXPONENT = 6, 4
SLICE_BYTES = 1_000_000
PAIRS = 1 << 20  # borders and periods compared at a time
# Two primes under 2^31 and their bases: prefix sums of hashed words fit 64 bits.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_103_515_245, 1_664_525_011)


def automaton(s: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """The suffix automaton of ``s``: each state's transitions, and where its strings end first."""
    to, link, length, first = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(s):
        own = len(to)
        to.append({})
        link.append(0)
        length.append(i + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = own
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[own] = q
            else:
                copy = len(to)
                to.append(to[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[own] = copy
        last = own
    return to, first


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors (start, length, start of the first occurrence; -1 for a new word).

    Each is the longest stretch that also occurs from an earlier start; the
    two occurrences may overlap.
    """
    to, first = automaton(s)
    out, i, n = [], 0, len(s)
    while i < n:
        state, size = 0, 0
        while i + size < n:
            further = to[state][s[i + size]]
            if first[further] - size >= i:
                break
            state, size = further, size + 1
        out.append((i, max(size, 1), first[state] - size + 1 if size else -1))
        i += max(size, 1)
    return out


class _Stretch:
    """How far two places of a stretch agree, forward and backward, for many pairs at once."""

    def __init__(self, s: np.ndarray) -> None:
        self.s, self.n, self.sums, self.powers = s, len(s), [], []
        mixed = mix64(s.astype(np.uint64) + np.uint64(1))
        for prime, base in zip(PRIMES, BASES):
            m = np.uint64(prime)
            power = np.ones(1, np.uint64)
            while len(power) <= self.n:
                power = np.concatenate([power, power * (power[-1] * np.uint64(base) % m) % m])
            power = power[: self.n + 1]
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(mixed % m * power[:-1] % m, out=total[1:])
            self.sums.append(total)
            self.powers.append(power)

    def _equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from ``a`` and from ``b`` (a < b) have the same hashes."""
        same = np.ones(len(a), bool)
        for prime, total, power in zip(PRIMES, self.sums, self.powers):
            m = np.uint64(prime)
            same &= (total[a + size] - total[a]) % m * power[b - a] % m == (total[b + size] - total[b]) % m
        return same

    def _agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        got = np.zeros(len(a), np.int64)
        step = 1 << max(0, int(most.max(initial=1)).bit_length() - 1)
        while step:
            use = np.flatnonzero(got + step <= most)
            at_a, at_b = (a[use] + got[use], b[use] + got[use]) if forward else (a[use] - got[use] - step, b[use] - got[use] - step)
            got[use[self._equal(at_a, at_b, np.full(len(use), step))]] += step
            step >>= 1
        return got

    def run_over(self, at: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the stretch around place ``at`` in which words ``p`` apart agree: ``at`` against ``at + p``."""
        forward = self._agree(at, at + p, self.n - at - p, True)
        backward = self._agree(at, at + p, at, False)
        return at - backward, at + p + forward


def runs(words: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, end, least period) of word numbers with the least length and exponent (2 at least)."""
    s = words.tolist()
    parts = factors(s)
    # Main: a run that touches the border of two factors and ends in the second has a period of
    # at most their lengths over one less than its exponent. Its period fits right or left of the border.
    border = np.array([b for b, _, _ in parts[1:]] + [len(s)], np.int64)
    size = np.array([n for _, n, _ in parts] + [0], np.int64)
    most = (size[:-1] + size[1:]) // (min_exponent - 1)
    stretch, found = _Stretch(words), {}
    cuts = np.searchsorted(np.cumsum(most), np.arange(0, int(most.sum()) + PAIRS, PAIRS), side="right")
    for low, high in zip([0, *cuts[1:-1]], [*cuts[1:-1], len(most)]):
        if low >= high:
            continue
        at = np.repeat(border[low:high], most[low:high])
        p = np.arange(len(at)) - np.repeat(np.cumsum(most[low:high]) - most[low:high], most[low:high]) + 1
        for left in (at, at - p):
            fits = (left >= 0) & (left + p <= len(s))
            x, own = left[fits], p[fits]
            # a run needs agreement on one side of the border at least
            near = np.zeros(len(x), bool)
            inside = x + own < len(s)
            near[inside] = words[x[inside]] == words[x[inside] + own[inside]]
            behind = x > 0
            near[behind] |= words[x[behind] - 1] == words[x[behind] + own[behind] - 1]
            x, own = x[near], own[near]
            if not len(x):
                continue
            start, end = stretch.run_over(x, own)
            good = end - start >= np.maximum(min_length, min_exponent * own)
            for i, j, q in zip(start[good].tolist(), end[good].tolist(), own[good].tolist()):
                if q < found.get((i, j), len(s)):
                    found[i, j] = q
    # Hashes only propose: what is kept repeats, and no neighbour extends it.
    found = {
        (i, j): q for (i, j), q in found.items()
        if (words[i : j - q] == words[i + q : j]).all() and (i == 0 or s[i - 1] != s[i + q - 1]) and (j == len(s) or s[j] != s[j - q])
    }
    order = sorted(found)
    for begin, length, source in parts:
        if source < 0 or length < min_length:
            continue
        k = bisect_right(order, (source + 1,))
        while k < len(order) and order[k][0] < source + length:
            i, j = order[k]
            copy = (i + begin - source, j + begin - source)
            if j < source + length and copy not in found:
                found[copy] = found[i, j]
                insort(order, copy)
            k += 1
    return [(i, j, found[i, j]) for i, j in order]


def stretches(codes: np.ndarray, owner: np.ndarray, least: int, min_length: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the stretches that may hold a run: words of one owner, each ``least`` times in its stretch.

    Cutting at rarer words makes others rare; it is repeated while it removes an eighth.
    """
    place, group, span = np.arange(len(codes)), owner, int(codes.max(initial=0)) + 1
    while len(place):
        before = len(place)
        _, inverse, counts = np.unique(group * span + codes[place], return_inverse=True, return_counts=True)
        keep = counts[inverse] >= least
        place, group = place[keep], group[keep]
        if not len(place):
            return
        fresh = np.concatenate([[True], (np.diff(place) > 1) | (np.diff(group) != 0)])
        group = np.cumsum(fresh) - 1
        long = np.bincount(group)[group] >= min_length
        place, group = place[long], group[long]
        if len(place) >= before - before // 8:
            break
    if len(place):
        firsts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(firsts, np.append(firsts[1:], len(place))):
            yield int(place[a]), int(place[b - 1]) + 1


def _found(min_length: int, min_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            texts = [(t or b"").split() for t in part.column("text").cast(pa.binary()).to_pylist()]  # bytes split at ASCII white space
            number: dict[bytes, int] = {}
            codes = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64)
            sizes = np.array([len(words) for words in texts], np.int64)
            begins = np.concatenate([[0], np.cumsum(sizes)])
            gone = np.zeros(len(codes) + 1, np.int64)
            docs, made = [], []
            for low, high in stretches(codes, np.repeat(np.arange(len(texts)), sizes), min_exponent, min_length):
                doc = int(np.searchsorted(begins, low, side="right")) - 1
                for i, j, q in runs(codes[low:high], min_length, min_exponent):
                    docs.append(doc)
                    made.append((low + i - begins[doc], j - i, q))
                    gone[low + i + q] += 1
                    gone[low + j] -= 1
            held = np.cumsum(gone[:-1]) == 0
            collapsed = []
            for doc, words in enumerate(texts):
                own = held[begins[doc] : begins[doc + 1]]
                collapsed.append(b" ".join(words if own.all() else [words[k] for k in np.flatnonzero(own)]).decode())
            table = np.array(made, np.int64).reshape(-1, 3)
            order = np.lexsort((table[:, 2], table[:, 0], docs)) if made else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(np.array(docs, np.int64), minlength=len(texts)))]).astype(np.int32)
            kind = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
            listed = pa.StructArray.from_arrays([pa.array(table[order, k]) for k in range(3)], fields=list(kind))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), listed), pa.array(collapsed, pa.string())],
                names=["id", "n_words", "runs", "collapsed"],
            )

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row a row of ``docs``: ``id``, ``n_words``, ``runs`` and the ``collapsed`` text.

    Words are what ASCII white space separates, told apart by case. A run is a
    stretch of words with least period q, ``min_length`` words and
    ``min_exponent`` (two at least) periods long, that no neighbouring word
    extends; ``runs`` holds (start, length, period), counted from 0, by start
    and period. ``collapsed`` has the words that no run holds after its first
    period, joined by one space. A null or empty text has no words, no runs and
    an empty text; null ids and repeated rows keep their rows; an empty table
    gives none; other columns, of whatever name, do not matter. Documents are
    independent, so nothing is shuffled; a task holds one slice of texts, and
    about half a kilobyte for each word of the longest repeating stretch.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    prepare(docs.sparkSession)
    rows = dealt(docs).select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_found(min_length, min_exponent), f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
