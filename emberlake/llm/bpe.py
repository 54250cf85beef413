"""Byte-level BPE encoding and decoding by a public rank file.

Pre-tokenised pieces that a worker has not met are merged together: pieces of
like byte length form a padded matrix of token ids, and in every round each
row merges its leftmost pair of least rank. Pair ranks come from an open-
addressed hash table; a merge shortens its row by one, so every round drops a
column, and rows without mergeable pairs leave the matrix.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.llm.common import with_texts
from emberlake.llm.textkit import mix64

NO_RANK = np.int32(2**31 - 1)
LONG_ROW = 4096
MATRIX_CELLS = 4_000_000
CACHE_PIECES = 800_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (a base64 token and its rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class PairTable:
    """(left id, right id) -> rank of the joined bytes, with linear probing."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs.keys(), np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        bits = max(4, int(4 * len(pairs)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.values = np.full(1 << bits, NO_RANK, np.int32)
        slot = (mix64(keys) & self.mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.values[slot[left]] == NO_RANK]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & int(self.mask)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NO_RANK where the joined bytes are no token. Negative ids are padding."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = (mix64(key) & self.mask).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NO_RANK)
        open_ = np.flatnonzero((found != key) & (self.values[slot] != NO_RANK))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            at = slot[open_]
            hit = self.keys[at] == key[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.values[at] != NO_RANK)]
        return np.where((left < 0) | (right < 0), NO_RANK, out).astype(np.int32)


class BpeCodec:
    """Encoder and decoder of one rank file; pieces met before are kept, up to ``CACHE_PIECES``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.table = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_sizes = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _merge_matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """Merge the rows of a matrix padded with -1 until no pair has a rank."""
        rows = np.arange(len(ids))
        out: list[np.ndarray] = [None] * len(ids)
        shape = (len(ids), ids.shape[1] - 1)
        ranks = self.table.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(shape)
        while len(rows):
            if ids.shape[1] == 1:
                break
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            done = least == NO_RANK
            if done.any():
                for r, own in zip(rows[done], ids[done]):
                    out[r] = own[own >= 0]
                rows, ids, ranks, at, least = rows[~done], ids[~done], ranks[~done], at[~done], least[~done]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            columns = np.arange(ids.shape[1] - 1)
            ids[every, at] = least
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            right = np.flatnonzero(at < ranks.shape[1])
            ranks[right, at[right]] = self.table.ranks(least[right], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.table.ranks(ids[left, at[left] - 1], least[left])
        for r, own in zip(rows, ids):
            out[r] = own[own >= 0]
        return out

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One very long row: each round merges all places of its least rank, from the left.

        That is what one merge after the other gives as long as no merge makes a
        pair of a lesser rank; a round ends with the first merge that does. So
        the rounds are as many as ranks occur, not as many as merges.
        """
        ranks = self.table.ranks(ids[:-1], ids[1:])
        while len(ranks):
            least = ranks.min()
            if least == NO_RANK:
                break
            at = np.flatnonzero(ranks == least)
            run = np.cumsum(np.diff(at, prepend=at[0] - 2) > 1)  # of places that overlap, every other one
            at = at[(at - at[np.searchsorted(run, run)]) % 2 == 0]
            made = np.full(len(at), least, np.int32)
            before = np.where(at > 0, ids[at - 1], -1)
            before[1:][np.diff(at) == 2] = least
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            lesser = np.minimum(self.table.ranks(before, made), self.table.ranks(made, after)) < least
            if lesser.any():
                at = at[: int(lesser.argmax()) + 1]
            ids[at] = least
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            place = at - np.arange(len(at))  # where the merged tokens are in the compacted row
            ids = ids[keep]
            ranks = ranks[keep[1:]]
            near = np.unique(np.concatenate([place - 1, place]))
            near = near[(near >= 0) & (near < len(ids) - 1)]
            ranks[near] = self.table.ranks(ids[near], ids[near + 1])
        return ids

    def _merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
        for b in np.unique(bucket):
            width = int(lengths[bucket == b].max())
            members = np.flatnonzero(bucket == b)
            if width > LONG_ROW:
                for i in members:
                    out[i] = self._merge_long(self.byte_ids[np.frombuffer(pieces[i], np.uint8)])
                continue
            step = max(1, MATRIX_CELLS // (width * 8))
            for k in range(0, len(members), step):
                part = members[k : k + step]
                padded = b"".join(pieces[i].ljust(width, b"\0") for i in part)
                ids = self.byte_ids[np.frombuffer(padded, np.uint8).reshape(len(part), width)]
                ids[np.arange(width) >= lengths[part][:, None]] = -1
                for i, merged in zip(part, self._merge_matrix(ids)):
                    out[i] = merged
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not known, or take them over from the older generation."""
        again = pieces & self.older.keys()
        self.known.update((piece, self.older[piece]) for piece in again)
        todo = []
        for piece in pieces - again:
            whole = self.ranks.get(piece.encode())
            if whole is None:
                todo.append(piece)
            else:
                self.known[piece] = (whole,)
        for piece, ids in zip(todo, self._merge([p.encode() for p in todo])):
            self.known[piece] = tuple(ids.tolist())

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in one array, and where each text's begin (null: none), with the end."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > CACHE_PIECES // 2:  # two generations: pieces still in use move on
            self.older, self.known = self.known, {}
        pieces = list(chain.from_iterable(split))
        got = list(map(self.known.get, pieces))
        missing = {piece for piece, ids in zip(pieces, got) if ids is None}
        if missing:
            self._learn(missing)
            got = [self.known[piece] if ids is None else ids for piece, ids in zip(pieces, got)]
        ends = np.zeros(len(got) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, got), np.int64, len(got)), out=ends[1:])
        ids = np.fromiter(chain.from_iterable(got), np.int32, int(ends[-1]))
        return ids, ends[np.concatenate([[0], np.cumsum([len(own) for own in split])]).astype(np.int64)]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text (null: none), as many as the longest merges leave."""
        ids, at = self.encode_flat(texts)
        return [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])]

    def decode_flat(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens, joined, and where those of the id ranges ``at`` begin."""
        sizes = self.token_sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(ends[-1]) + np.repeat(self.token_starts[ids] - ends[:-1], sizes)
        return self.token_bytes[place], ends[at]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the tokens, joined."""
        own = np.array(ids, np.int64)
        return self.decode_flat(own, np.array([0, len(own)]))[0].tobytes()


_codecs: dict[tuple[int, str], BpeCodec] = {}


def _codec(ranks, pattern: str) -> BpeCodec:
    """One codec for each vocabulary in a Python worker, kept between tasks."""
    key = (ranks.id if hasattr(ranks, "id") else id(ranks), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = BpeCodec(ranks.value, pattern)
    return _codecs[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (array of int) and ``decoded`` (their bytes, decoded again).

    Every match of ``pattern`` is encoded on its own, without special tokens.
    A null text encodes as an empty one. All columns of ``docs`` stay; columns
    it may have under the two new names are replaced. The rank file is read
    where the query is built and travels as a broadcast of its fixed size.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make(texts: list[str | None]) -> list[pa.Array]:
        codec = _codec(ranks, pattern)
        ids, at = codec.encode_flat(texts)
        decoded, ends = codec.decode_flat(ids, at)
        buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(decoded)]
        return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.Array.from_buffers(pa.binary(), len(texts), buffers)]

    return with_texts(docs, text_col, make, token_ids=T.ArrayType(T.IntegerType()), decoded=T.BinaryType())


def ids_digest(ids: str = "token_ids"):
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)
