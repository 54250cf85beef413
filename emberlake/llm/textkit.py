"""Vectorised hashing of words, shingles and byte n-grams for Arrow batches of text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[0]
    x = (x ^ (x >> np.uint64(27))) * _ODD[1]
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (runs without ASCII white space) of all texts, and offsets by text."""
    encoded = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    forward, backward = _power(len(data) + 1)
    summed = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[:-1], out=summed[1:])
    hashes = mix64((summed[ends] - summed[starts]) * backward[starts])
    begins = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])])
    return hashes, np.searchsorted(starts, begins)


def shingle_hashes(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, repeats kept, and offsets by text.

    A text of fewer words has one shingle of all its words; one without words has none.
    """
    words, at = word_hashes(texts)
    counts = np.diff(at)
    many = max(0, len(words) - size + 1)
    hashed = np.zeros(many, np.uint64)
    for k in range(size):
        hashed += words[k : k + many] * _ODD[k % len(_ODD)] + np.uint64(k)
    hashed = mix64(hashed)
    n_shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(n_shingles)])
    out = np.empty(offsets[-1], np.uint64)
    full = counts >= size
    source = np.repeat(at[:-1][full] - offsets[:-1][full], n_shingles[full])
    place = np.flatnonzero(np.repeat(full, n_shingles))
    out[place] = hashed[place + source]
    for i in np.flatnonzero(~full & (counts > 0)):
        own = words[at[i] : at[i + 1]]
        out[offsets[i]] = mix64(np.array([(own * _ODD[: len(own)]).sum() + np.uint64(counts[i])], np.uint64))[0]
    return out, offsets


def slices(batches: Iterable[pa.RecordBatch], text_col: str, chars: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``chars`` bytes of text (one row at least), to bound memory."""
    for batch in batches:
        column = batch.column(text_col)
        if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        else:
            sizes = np.ones(len(batch))
        group = np.cumsum(sizes + 64) // chars
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(batch)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
