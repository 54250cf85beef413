"""Language identification with averaged hashed subword embeddings.

A text's subwords are the byte three- and four-grams of its lower-cased words
with their edges. Their hashed embeddings are averaged and a linear softmax
gives language probabilities; embeddings and weights are learned by stochastic
gradient descent in numpy. A temperature calibrates the probabilities, and a
limit under which a prediction is rejected is set on rows held back.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from emberlake.llm.common import unit_hash, with_texts

BUCKETS = 1 << 15
DIM = 16
SAMPLE_ROWS = 1_000  # labelled rows a language
EPOCHS = 8
SLICE_CHARS = 400_000  # of texts whose subwords are held at once
UNKNOWN = "und"
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, and where each text's begin.

    Bytes that are no ASCII letters and under 128 are word edges.
    """
    encoded = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b" " + b" ".join(encoded) + b"   ", np.uint8)
    letter = _LETTERS[data]
    code = np.where(letter, data, 32).astype(np.uint32)
    begins = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])])
    n = len(code) - 3
    three = (code[:n] << 16) | (code[1 : n + 1] << 8) | code[2 : n + 2]
    four = (three << 8) | code[3 : n + 3]
    inner = letter[1 : n + 1]  # the second byte is a letter: an edge can only come first or last
    three_ok, four_ok = inner, inner & letter[2 : n + 2]
    at = np.concatenate([np.flatnonzero(three_ok), np.flatnonzero(four_ok)])
    keys = np.concatenate([three[three_ok], four[four_ok] ^ np.uint32(0x5BD1E995)])
    order = np.argsort(at, kind="stable")
    buckets = ((keys * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)[order]
    return buckets, np.searchsorted(at[order], begins)


def _averages(table: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Mean of the table's rows over each text's subwords; zeros where there are none.

    Texts are taken in slices: their subwords need many times their own memory.
    """
    out = np.zeros((len(texts), table.shape[1]))
    start = 0
    while start < len(texts):
        stop, chars = start, 0
        while stop < len(texts) and (stop == start or chars + len(texts[stop] or "") <= SLICE_CHARS):
            chars += len(texts[stop] or "")
            stop += 1
        buckets, at = subwords(texts[start:stop])
        filled = np.flatnonzero(np.diff(at) > 0)
        if len(filled):
            sums = np.add.reduceat(table[buckets], at[:-1][filled], axis=0, dtype=np.float64)
            out[start + filled] = sums / np.diff(at)[filled][:, None]
        start = stop
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class LanguageModel:
    """Embeddings folded with the softmax weights into one (bucket, language) table."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, limit: float = 0.0) -> None:
        self.languages, self.table, self.bias = languages, table.astype(np.float32), bias
        self.temperature, self.limit = temperature, limit

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        return _softmax((_averages(self.table, texts) + self.bias) / self.temperature)


def fit(texts: list[str], labels: list[str], seed: int = 0) -> LanguageModel:
    """Learn from labelled texts; a fifth is held back for temperature and rejection limit."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    draw = np.random.default_rng(seed)
    embed = draw.normal(0, 0.1, (BUCKETS, DIM))
    weight, bias = draw.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    order = draw.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    if not len(held):
        held = train
    made = [(ids, counts.astype(np.int32)) for ids, counts in (np.unique(subwords([t])[0], return_counts=True) for t in texts)]
    for epoch in range(EPOCHS):
        rate = 0.5 * (1 - epoch / EPOCHS)
        for i in draw.permutation(train):
            ids, counts = made[i]
            if not len(ids):
                continue
            share = counts / counts.sum()
            mean = share @ embed[ids]
            grad = _softmax((mean @ weight + bias)[None])[0]
            grad[y[i]] -= 1
            back = weight @ grad
            weight -= rate * np.outer(mean, grad)
            bias -= 0.1 * rate * grad
            embed[ids] -= (20 * rate) * np.outer(share, back)
    model = LanguageModel(languages, embed @ weight, bias)
    scores = _averages(model.table, [texts[i] for i in held]) + bias
    losses = {t: -np.log(np.maximum(_softmax(scores / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in 2.0 ** np.arange(-3, 4, 0.5)}
    model.temperature = min(losses, key=losses.get)
    best = model.probabilities([texts[i] for i in held]).max(axis=1)
    model.limit = float(min(np.quantile(best, 0.001), 0.5)) * 0.8  # rejects less than a thousandth of labelled text
    return model


def training_sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = SAMPLE_ROWS, seed: int = 0) -> tuple[list[str], list[str]]:
    """Whole texts and labels of at most ``rows`` labelled documents of each language, by the hash of id and text.

    Null texts and null languages take no part.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    draw = unit_hash(seed, "id", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return [], []
    share = known.sparkSession.createDataFrame([(lang, min(1.0, (1.2 * rows + 20) / n)) for lang, n in counts.items()], "lang string, share double")
    thin = known.join(F.broadcast(share), "lang").withColumn("draw", draw).where("draw < share")  # about 1.2 times the bound
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", "text"))
    got = thin.withColumn("turn", turn).where(F.col("turn") <= rows).orderBy("draw", "id", "text").select("text", "lang").collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", reject: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` from the whole text.

    A text that is null or has no letter is ``und`` with score 0; with
    ``reject`` so is one whose best probability lies under the model's limit
    (it keeps its score). A model without languages calls everything ``und``.
    Columns of ``docs`` under the two names are replaced; all others stay.
    """

    def make(texts: list[str | None]) -> list[pa.Array]:
        letters = np.array([_has_letter(t) for t in texts], dtype=bool)
        if not model.languages:
            return [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array(np.zeros(len(texts)))]
        p = model.probabilities(texts)
        best, score = p.argmax(axis=1), np.where(letters, p.max(axis=1), 0.0)
        known = letters & ((score >= model.limit) | (not reject))
        pred = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)]
        return [pa.array(pred, pa.string()), pa.array(score)]

    return with_texts(docs, text_col, make, lang_pred=T.StringType(), lang_score=T.DoubleType())


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Fit on a bounded sample of ``docs``; without labelled rows the model has no languages."""
    texts, labels = training_sample(docs, text_col, lang_col, id_col)
    if not texts:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    return fit(texts, labels)
