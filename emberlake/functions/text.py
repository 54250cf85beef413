"""Column functions for query text: cleaning, canonical form, tokens, keys and scopes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values. White space is the set that Unicode-aware regular expressions collapse.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"
FOREIGN_DIGITS = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "01234567890123456789"
APOSTROPHES = "'`’‘"
PUNCTUATION = ".,;:!?\"()[]{}<>«»“”—–-/\\|"
STOP_WORDS = (
    "a an the is are am was were be been being do does did "
    "what whats which who whom whose when where why how "
    "of for to in on at by with about as into from and or so "
    "i me my we our us you your it its this that these those "
    "can could would should may might will shall "
    "tell explain describe give want know please help"
).split()


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for; ASCII passes through."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def clean(text: Column) -> Column:
    """White space collapsed and stripped; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "))


def query_record(text: Column, normalise=clean, **metadata: Column) -> Column:
    """A query with what it carries along: (text, metadata), the text normalised, the metadata a struct or, without any, null."""
    carried = F.struct(*[c.alias(n) for n, c in metadata.items()]) if metadata else F.lit(None).cast("struct<>")
    return F.struct(normalise(text).alias("text"), carried.alias("metadata"))


def canonical(text: Column, compose: bool = True) -> Column:
    """The aggressive form: composed, digits folded, lower-cased, apostrophes deleted,
    punctuation spaced, stop words dropped unless nothing else is left."""
    t = nfkc(clean(text)) if compose else clean(text)
    t = F.lower(F.translate(t, FOREIGN_DIGITS, ASCII_DIGITS))
    t = F.translate(t, APOSTROPHES, "")
    t = F.translate(t, PUNCTUATION, " " * len(PUNCTUATION))
    words = F.filter(F.split(t, SPACE + "+"), lambda w: w != "")
    content = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    return F.array_join(F.when(F.size(content) > 0, content).otherwise(words), " ")


def tokens(text: Column) -> Column:
    """Words: runs of letters, numbers and underscores in any script."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def fulltext_value(text: Column) -> Column:
    """The tokens joined by spaces, or the text itself where it has none."""
    found = tokens(text)
    return F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(text)


def scope_tag(scope: Column) -> Column:
    """A scope as a tag: lower-cased, other characters run to ``_``; empty is ``_default``."""
    tag = F.regexp_replace(F.lower(clean_edges(scope)), "[^0-9a-z_]+", "_")
    return F.when(F.coalesce(scope, F.lit("")) == "", F.lit("_default")).otherwise(
        F.when(tag == "", F.lit("_default")).otherwise(tag)
    )


def clean_edges(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def entry_key(scope: Column, text: Column, prefix: str = "cache:") -> Column:
    """The key of an entry: prefix and SHA-256 of scope tag, NUL and clean text."""
    return F.concat(F.lit(prefix), F.sha2(F.concat(scope_tag(scope), F.lit("\0"), text).cast("binary"), 256))


def entity_signature(identifiers: Column) -> Column:
    """SHA-256 of the sorted distinct identifiers joined by pipes; ``none`` without any."""
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(identifiers, lambda x: F.lower(clean_edges(x))), lambda x: x != "")))
    return F.when(F.coalesce(F.size(ids), F.lit(0)) <= 0, F.lit("none")).otherwise(F.sha2(F.array_join(ids, "|").cast("binary"), 256))


def entities_overlap(a: Column, b: Column) -> Column:
    """Both empty, or at least one in common. Null counts as empty."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    return ((F.size(a) == 0) & (F.size(b) == 0)) | F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def gateway_scope(project: Column, key: Column) -> Column:
    """The project, or ``k_`` and 32 hex digits of the key's hash."""
    return F.coalesce(F.nullif(project, F.lit("")), F.concat(F.lit("k_"), F.substring(F.sha2(key.cast("binary"), 256), 1, 32)))


def guarded_scope(scope: Column, policy_hash: Column) -> Column:
    return F.concat(scope, F.lit("#g"), F.substring(policy_hash, 1, 12))


def tenant_scope(tenant: Column, cache: Column) -> Column:
    return F.concat(F.lit("t"), tenant, F.lit("__c"), cache)


def model_slug(model: Column) -> Column:
    return F.regexp_replace(model, "[^A-Za-z0-9_-]", "_")


def key_prefix(key: Column, shown: int = 11) -> Column:
    return F.substring(key, 1, shown)


def hmac_sha256(pepper: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex, from two plain hashes: the padded key is known when the plan is built."""
    import hashlib

    key = hashlib.sha256(pepper).digest() if len(pepper) > 64 else pepper
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def sanitize_for_judging(text: Column) -> Column:
    """Control characters spaced, triple quotes made typographic."""
    return F.replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " "), F.lit('"""'), F.lit("“”“"))
