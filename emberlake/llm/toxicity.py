"""Toxicity by a subsequence string-kernel support vector machine.

The kernel of two words compares their gapped subsequences of two and three
characters, each weighted by a decay for every position it spans, so an insult
still matches with characters inserted, replaced or left out. Landmark words
give Nystroem features. A linear support vector machine on them is trained on whole
labelled sentences: first by the sum kernel of their words, then with a
sentence as bad as its worst word, where a toxic document has one bad sentence
at least and a clean one has none. A text scores as its worst sentence.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.llm.common import bounded_sample, with_texts

DIM = 512
DECAY = 0.6
SPAN = 5
POWER = 4
WORD_CHARS = 24
LANDMARKS = 192
ROUNDS = 12
CLEAN_SHARE = 0.999
SURE = 3.0
SAMPLE_TOXIC, SAMPLE_CLEAN = 1_500, 4_000
CACHE_WORDS = 400_000
VARIANTS = 6
# Digits and signs written for letters.
LOOKALIKES = str.maketrans("013457@$", "oieastas")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_SPACED = re.compile(r"(?:(?<!\S)\S[ .*_-]+){2,}\S(?!\S)")


def normalise(token: str) -> str:
    """The letters of a token, lower-cased; marks and signs inserted between them go."""
    if token.isalpha():
        return token.lower()
    if any(map(str.isalpha, token)):
        token = token.rstrip("$").translate(LOOKALIKES)
    return "".join(filter(str.isalpha, token.lower()))


def tokens_of(text: str) -> set[str]:
    """The distinct tokens of a text; runs of single spaced characters also give the word they spell."""
    found = set(text.split())
    if sum(len(t) == 1 for t in found) >= 3:
        found.update("".join(run.split()) for run in _SPACED.findall(text))
    return found


def _offsets() -> list[tuple[tuple[int, ...], float]]:
    """Position patterns of pairs and triples within ``SPAN``, with their decay."""
    out = []
    for size in (2, 3):
        for rest in combinations(range(1, SPAN), size - 1):
            out.append(((0, *rest), DECAY ** (rest[-1] + 1 - size)))
    return out


_PATTERNS = _offsets()


def subsequence_features(words: list[str]) -> np.ndarray:
    """Unit vectors of decayed gapped subsequences, hashed to ``DIM`` places.

    Words carry an edge mark at both ends. Longer words than ``WORD_CHARS`` are
    cut into overlapping pieces before they come here.
    """
    marked = [f"^{w[:WORD_CHARS]}$".encode("utf-32-le") for w in words]
    width = max(map(len, marked), default=0) // 4
    codes = np.frombuffer(b"".join(m.ljust(4 * (width + SPAN), b"\0") for m in marked), np.uint32)
    codes = codes.reshape(len(words), width + SPAN).astype(np.int64)
    base = np.arange(len(words))[:, None] * DIM
    places, weights = [], []
    for pattern, weight in _PATTERNS:
        key = len(pattern)
        for p in pattern:
            c = codes[:, p : p + width]
            key = key * 1_000_003 + c
        real = codes[:, pattern[-1] : pattern[-1] + width] > 0  # padding comes last
        places.append((base + ((key * 2_654_435_761) >> 15) % DIM)[real])
        weights.append(np.full(len(places[-1]), weight))
    out = np.bincount(np.concatenate(places), np.concatenate(weights), len(words) * DIM)
    out = np.sqrt(out.astype(np.float32).reshape(len(words), DIM))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), np.float32(1e-9))


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The normalised subsequence kernel, sharpened by a power (products of kernels are kernels)."""
    return np.maximum(a @ b.T, 0) ** POWER


class ToxicityModel:
    """Landmarks, the folded support vector weights, and a calibration."""

    def __init__(self, landmarks: np.ndarray, weights: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.landmarks, self.weights, self.bias, self.slope, self.shift = landmarks, weights, bias, slope, shift

    def margins(self, words: list[str]) -> np.ndarray:
        """The margin of each normalised word; long words take the largest over their pieces."""
        pieces, owner = _split(words)
        out = np.full(len(words), -np.inf)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))  # like lengths make narrow matrices
        for i in range(0, len(order), 512):
            part = order[i : i + 512]
            k = kernel(subsequence_features([pieces[j] for j in part]), self.landmarks)
            np.maximum.at(out, owner[part], k @ self.weights + self.bias)
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on the violating rows.

    ``y`` holds the margin each row has to reach, with its side as the sign.
    """
    w, bias, active = np.zeros(x.shape[1]), 0.0, None
    keep = np.eye(x.shape[1] + 1) * ridge
    keep[-1, -1] = 1e-6
    for _ in range(steps):
        violating = np.sign(y) * (x @ w.astype(x.dtype) + bias) < np.abs(y)
        if active is not None and (violating == active).all():
            break
        active, left, right = violating, keep.copy(), np.zeros(len(keep))
        use = np.flatnonzero(active)
        for i in range(0, len(use), 4_096):  # few rows at a time in double precision
            rows = use[i : i + 4_096]
            own = np.hstack([x[rows].astype(np.float64), np.ones((len(rows), 1))])
            weighted = own * cost[rows, None]
            left += weighted.T @ own
            right += weighted.T @ y[rows]
        solved = np.linalg.solve(left, right)
        w, bias = solved[:-1], float(solved[-1])
    return w, bias


def variants(word: str, draw: np.random.Generator) -> list[str]:
    """The word with a character inserted, replaced or left out at drawn inner places."""
    out = []
    for i in range(VARIANTS if len(word) >= 4 else 0):
        at = int(draw.integers(1, len(word)))
        extra = chr(int(draw.integers(97, 123)))
        out.append(word[:at] + (extra if i % 3 else "") + word[at + (i % 3 != 1) :])
    return out


def _split(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Words as pieces of at most ``WORD_CHARS``, and the index of each piece's word."""
    pieces, owner = [], []
    for i, w in enumerate(words):
        for k in range(0, max(1, len(w) - 8), WORD_CHARS - 8):
            pieces.append(w[k : k + WORD_CHARS])
            owner.append(i)
    return pieces, np.array(owner, np.int64)


def _least_sentence(sentences: list[list[str]]) -> int:
    """The least hash of a text's sentences: copies, even near ones, mostly share it, and hardly any others."""
    return min((crc32(" ".join(sorted(set(s))).encode()) for s in sentences if s), default=0)


class _Sentences:
    """Labelled sentences as rows of word numbers; one that near copies share counts once."""

    def __init__(self, bags: list[tuple[int, list[list[str]]]], number: dict[str, int]) -> None:
        seen, rows, labels, docs = set(), [], [], []
        for doc, (label, sentences) in enumerate(bags):
            group = _least_sentence(sentences)
            for words in sentences:
                row = tuple(sorted({number[w] for w in words}))
                if row and (label, group, row) not in seen:
                    seen.add((label, group, row))
                    rows.append(row)
                    labels.append(label)
                    docs.append(doc)
        self.words = np.fromiter((w for r in rows for w in r), np.int64)
        self.begins = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.labels, self.docs = np.array(labels, np.int64), np.array(docs, np.int64)
        self.owner = np.repeat(np.arange(len(rows)), np.diff(self.begins))

    def worst(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest margin in each sentence, and the word that has it."""
        own = margin[self.words]
        order = np.lexsort((-self.words, own, self.owner))[self.begins[1:] - 1]
        return own[order], self.words[order]

    def holding(self, label: int, size: int) -> np.ndarray:
        """In how many sentences of a label each word is."""
        return np.bincount(self.words[(self.labels == label)[self.owner]], minlength=size)


def fit(bags: list[tuple[int, list[str]]], seed: int = 0) -> ToxicityModel | None:
    """Learn from (label, sentences) of documents; None where a label is missing.

    The machine is trained on sentences. It starts from the sum kernel of
    sentences (the mean of their words' features, each sentence with its
    document's label). Then, round by round, a sentence's margin is that of its
    worst word: each toxic document has one sentence over 1 (the one the last
    round holds worst), every sentence of clean documents lies under -1. The
    words that decide sentences are the rows of the next machine; a word that
    decided a clean sentence once stays a row.
    """
    plain: dict[str, str] = {}  # one string a word
    for token in (t for _, sentences in bags for s in sentences for t in tokens_of(s)):
        if token not in plain:
            plain[token] = sys.intern(normalise(token))
    parsed = [(label, [list({n for t in tokens_of(s) if (n := plain[t])}) for s in sentences]) for label, sentences in bags]
    held = [_least_sentence(own) % 6 == 0 for _, own in parsed]  # a sixth, for calibration; copies fall together
    train = [b for b, h in zip(parsed, held) if not h]
    if {label for label, _ in train} != {0, 1}:
        train = parsed
    if {label for label, _ in train} != {0, 1} or not any(w for label, own in train if label for s in own for w in s):
        return None
    vocabulary = sorted({w for _, own in train for s in own for w in s})
    rows = _Sentences(train, {w: i for i, w in enumerate(vocabulary)})
    toxic, clean = rows.holding(1, len(vocabulary)), rows.holding(0, len(vocabulary))
    n_toxic, n_clean = max(1, int((rows.labels == 1).sum())), max(1, int((rows.labels == 0).sum()))
    share = (toxic + clean + 1) / (n_toxic + n_clean + 2)
    contrast = (toxic / n_toxic - clean / n_clean) / np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))
    # Landmarks: half are the words of the strongest contrast between the labels' sentences, half drawn from all sentences.
    draw = np.random.default_rng(seed)
    half = LANDMARKS // 2
    telling = np.argsort(-contrast, kind="stable")[:half]
    drawn = draw.choice(rows.words, min(8 * half, len(rows.words)), replace=False)
    chosen = list(dict.fromkeys([*telling.tolist(), *drawn.tolist()]))[:LANDMARKS]
    landmarks = subsequence_features([vocabulary[i] for i in chosen])
    value, vector = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    solid = value > 1e-4 * value[-1]
    nystroem = vector[:, solid] / np.sqrt(value[solid])

    def features(words: list[str]) -> np.ndarray:
        out = np.empty((len(words), int(solid.sum())), np.float32)
        for i in range(0, len(words), 512):
            out[i : i + 512] = kernel(subsequence_features(words[i : i + 512]), landmarks) @ nystroem
        return out

    pieces, owner = _split(vocabulary)
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))  # like lengths make narrow matrices
    z = np.empty((len(pieces), int(solid.sum())), np.float32)
    for i in range(0, len(order), 4_096):
        z[order[i : i + 4_096]] = features([pieces[j] for j in order[i : i + 4_096]])
    first = np.searchsorted(owner, np.arange(len(vocabulary)))

    def margins(weights: np.ndarray, bias: float) -> np.ndarray:
        return np.maximum.reduceat(z @ weights.astype(np.float32), first) + bias

    mean = np.empty((len(rows.labels), z.shape[1]), np.float32)
    for j in range(z.shape[1]):
        mean[:, j] = np.bincount(rows.owner, z[first, j][rows.words], len(rows.labels)) / np.diff(rows.begins)
    weights, bias = _svm(mean, np.where(rows.labels == 1, 1.0, -1.0), np.where(rows.labels == 1, n_clean / n_toxic, 1.0))
    del mean
    decided, accused = np.zeros(len(vocabulary), dtype=bool), np.zeros(len(vocabulary), dtype=bool)
    for turn in range(ROUNDS):
        margin = margins(weights, bias)
        worst, word = rows.worst(margin)
        lively = word[(rows.labels == 0) & (worst > (-1.0 if turn else -np.inf))]  # at first, the worst word of every clean sentence
        if turn and decided[lively].all():
            break
        decided[lively] = True
        by_doc = np.lexsort((worst, rows.docs))
        tops = by_doc[np.append(np.flatnonzero(np.diff(rows.docs[by_doc])), len(by_doc) - 1)]  # each document's worst sentence
        accused[word[tops[rows.labels[tops] == 1]]] = True
        accused[(margin > np.quantile(worst[rows.labels == 0], CLEAN_SHARE)) & (toxic > 0)] = True
        witness = np.flatnonzero(accused)
        times = toxic[witness]
        kept = clean[witness] <= 0.02 * times  # a word of clean sentences decides nothing
        if kept.any():
            witness, times = witness[kept], times[kept]
        bent = [(v, n) for w, n in zip(witness, times) for v in variants(vocabulary[w][:WORD_CHARS], draw)]
        negative = np.flatnonzero(decided)
        x = np.vstack([z[first[witness]], features([v for v, _ in bent]), z[first[negative]]])
        y = np.concatenate([np.full(len(witness) + len(bent), SURE), -np.ones(len(negative))])
        cost = np.concatenate([4.0 * times, [n / VARIANTS for _, n in bent], np.ones(len(negative))])
        weights, bias = _svm(x, y, cost)
    model = ToxicityModel(landmarks, (nystroem @ weights).astype(np.float32), bias, 1.0, 0.0)
    # Calibrated on documents held back, whose sentences the machine has not seen.
    kept_back = [(label, {w for s in own for w in s}) for (label, own), h in zip(parsed, held) if h]
    if {0, 1} <= {label for label, _ in kept_back}:
        known = sorted(set().union(*(own for _, own in kept_back)))
        margin = dict(zip(known, model.margins(known)))
        worst = np.array([max((margin[w] for w in own), default=-2.0) for _, own in kept_back])
        model.slope, model.shift = _calibrate(worst, np.array([label for label, _ in kept_back]))
    return model


def _calibrate(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic score of documents.

    One half lies where one errs least on them (a cost of one for either
    kind): a third into the span around the widest such gap in which at most
    one more is wrong. The slope is fitted by gradient steps with that place held.
    """
    order = np.argsort(margin, kind="stable")
    m, y = margin[order], labels[order]
    errors = np.concatenate([[(y == 0).sum()], (y == 0).sum() - np.cumsum(y == 0) + np.cumsum(y == 1)])
    edges = np.concatenate([[m[0] - 2], m, [m[-1] + 2]])
    gap = np.where(errors == errors.min(), np.diff(edges), -1.0)
    low = high = int(gap.argmax())
    near = errors <= errors.min() + 1
    while low > 0 and near[low - 1]:
        low -= 1
    while high < len(near) - 1 and near[high + 1]:
        high += 1
    middle = edges[low] + (edges[high + 1] - edges[low]) / 3
    slope = 3.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(slope * (margin - middle), -60, 60)))
        slope = float(np.clip(slope - 4 * ((p - labels) * (margin - middle)).mean(), 1.0, 12.0))
    return slope, -slope * middle


def training_bags(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", seed: int = 0) -> list[tuple[int, list[str]]]:
    """(label, sentences) of at most ``SAMPLE_TOXIC`` toxic and ``SAMPLE_CLEAN`` clean documents of the labelled ids.

    They are chosen by the hash of their ids; texts are whole. Null ids, null
    texts and labels other than 0 and 1 take no part; an id labelled twice has
    its larger label, an id with several rows gives them all. Other columns of
    either table, of whatever name, do not matter.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    parts = [bounded_sample(known.where(F.col("label") == y), n, seed, "id") for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # The sample has at most SAMPLE_TOXIC + SAMPLE_CLEAN ids, so it is broadcast.
    got = rows.join(F.broadcast(parts[0].unionByName(parts[1])), "id").collect()
    return [(r["label"], _SENTENCE.split(r["text"])) for r in sorted(got, key=lambda r: (r["id"], r["text"]))]


def score(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` in [0, 1] of the whole text.

    The score is the calibrated margin of the worst word. Texts that are null
    or have no letters score as an empty text does, near 0; without a model all
    score 0. A column called ``toxicity`` is replaced; all others stay.
    """
    known: dict[str, float] = defaultdict(lambda: -2.0)

    def make(texts: list[str | None]) -> list[pa.Array]:
        if model is None:
            return [pa.array(np.zeros(len(texts)))]
        if len(known) > CACHE_WORDS:
            known.clear()
        owned = [tokens_of(t) if t else () for t in texts]
        new = set().union(*owned) - known.keys()
        by_word: dict[str, list[str]] = {}
        for t in new:
            by_word.setdefault(normalise(t), []).append(t)
        by_word.pop("", None)
        known.update(dict.fromkeys(new, -2.0))
        words = list(by_word)
        for w, m in zip(words, model.margins(words)):
            for t in by_word[w]:
                known[t] = m
        worst = np.array([max(map(known.__getitem__, own), default=-2.0) for own in owned])
        return [pa.array(model.probability(worst))]

    return with_texts(docs, text_col, make, toxicity=T.DoubleType())
