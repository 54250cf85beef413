"""A training corpus from ``documents``: the stages in order, each a table of its own.

Each function takes (spark, docs, sf_dir) and returns the rows its stage leaves;
``run`` writes every stage as Parquet in the shared folder and reads it again for
the next, so a lost executor costs a stage's tasks and not the pipeline.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm import bpe, langid, line_dedup, mixing, near_dedup
from emberlake.llm.common import column, fresh, stage, table, unstage

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without letters and rejected ones go.

    Repeated rows are judged alike; without labelled rows every document goes,
    an empty table stays one. All columns stay, of whatever name.
    """
    model = langid.train(docs)
    own, score = fresh(docs.columns, "doc_lang", "doc_lang_score")
    seen = docs.select(*[column(c) for c in docs.columns if c not in ("lang_pred", "lang_score")], *[F.col(c).alias(n) for c, n in (("lang_pred", own), ("lang_score", score)) if c in docs.columns])
    kept = langid.identify(seen, model).where(F.col("lang_pred") != langid.UNKNOWN)
    back = {"lang_pred": own, "lang_score": score}
    return kept.select(*[column(back.get(c, c)).alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document holds; a text that loses every line goes.

    Null and empty texts stay as they are, as do rows with a null id; rows of
    one id are one document. All columns stay, of whatever name; ``n_chars``,
    if there, is counted anew.
    """
    held, gone = fresh(docs.columns, "n_lines", "n_dropped")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), counts=(held, gone)).where(F.col(gone) < F.col(held))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[column(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the least id, as one row.

    Null texts are near nothing; rows with a null id stay. All columns stay.
    """
    return near_dedup.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, three times at most.

    Documents without words (null texts too) go; a null source is one of its
    own; repeated rows share their copies evenly. All columns stay.
    """
    return mixing.apply_mix(docs, mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text again.

    A null text has no tokens. This last stage returns ``doc_id``, ``lang``,
    ``source``, ``n_tokens``, ``token_ids`` and ``round_trip`` alone: text and
    all further columns end here.
    """
    plain = docs.select("doc_id", "lang", "source", "text")
    coded = bpe.encode(plain, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [("language", language), ("lines", lines), ("near", near), ("mix", mixed), ("tokens", tokens)]

# Language models, near-duplicate classes and token merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is deleted when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
        unstage(*before)
        before = [docs]
    return docs
