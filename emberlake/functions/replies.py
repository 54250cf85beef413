"""Tolerant parsing of model replies: judge verdicts and extracted entities.

A reply is a list of candidate spans, tried in turn: the text without its code
fence, then what a brace opens in it. Fields are read by a table of accepted
keys and coercions, each of which gives a value or the name of a problem.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted keys and the slack at the ends of the range.
CONFIDENCE_KEYS = ("confidence", "score", "probability")
RATIONALE_KEYS = ("rationale", "reason", "explanation")
CATEGORY_KEYS = ("category", "category_id", "matched_category")
SLACK = 1e-3
FENCED = re.compile(r"```[a-zA-Z0-9_-]*\s*(.*?)\s*(?:```)?", re.DOTALL)


class Problem(str):
    """Why a reply or a field gives nothing."""


def _strict(span: str) -> object:
    return json.loads(span)


def _leading(span: str) -> object:
    """The value a span begins with; what follows it does not matter."""
    return json.JSONDecoder().raw_decode(span)[0]


def _candidates(body: str, to_last_brace: bool) -> Iterator[tuple[str, Callable[[str], object]]]:
    yield body, _strict
    opened, closed = body.find("{"), body.rfind("}")
    if opened >= 0 and not to_last_brace:
        yield body[opened:], _leading
    elif 0 <= opened <= closed:
        yield body[opened : closed + 1], _strict


def _object(reply: str | None, to_last_brace: bool) -> dict | Problem:
    body = (reply or "").strip()
    if fenced := FENCED.fullmatch(body):
        body = fenced[1]
    if not body:
        return Problem("empty")
    tried = 0
    for span, parse in _candidates(body, to_last_brace):
        tried += 1
        try:
            value = parse(span)
        except ValueError:
            continue
        return value if isinstance(value, dict) else Problem("not_an_object")
    return Problem("invalid_json" if tried > 1 else "no_object")


def _share(value: object) -> float | Problem:
    """A number from 0 to 1, or its text; a little over the ends counts as the end."""
    try:
        number = float(value) if isinstance(value, (int, float, str)) and not isinstance(value, bool) else float("nan")
    except ValueError:
        number = float("nan")
    if number != number:
        return Problem("no_confidence")
    return min(1.0, max(0.0, number)) if abs(number - 0.5) <= 0.5 + SLACK else Problem("out_of_range")


def _said(value: object) -> str:
    return "" if value is None else str(value).strip()


def _named(value: object) -> str | None:
    return value.strip() if isinstance(value, str) and value else None


FIELDS = {"confidence": (CONFIDENCE_KEYS, _share), "rationale": (RATIONALE_KEYS, _said), "category": (CATEGORY_KEYS, _named)}


def _verdict(reply: str | None) -> dict:
    found = _object(reply, to_last_brace=False)
    if isinstance(found, Problem):
        return {"error": str(found)}
    read = {name: coerce(next((found[k] for k in keys if k in found), None)) for name, (keys, coerce) in FIELDS.items()}
    return next(({"error": str(v)} for v in read.values() if isinstance(v, Problem)), read)


def _entity(item: object) -> dict | None:
    if not isinstance(item, dict):
        return None
    known = {"identifier": item.get("identifier") or item.get("text"), "type": item.get("type")}
    return {"text": str(item.get("text", known["identifier"]))} | {k: str(v) for k, v in known.items()} if all(known.values()) else None


def _entities(reply: str | None) -> list[dict] | None:
    found = _object(reply, to_last_brace=True)
    items = None if isinstance(found, Problem) else found.get("entities", [])
    return [e for e in map(_entity, items) if e] if isinstance(items, list) else None


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


@F.pandas_udf(T.StructType([T.StructField("confidence", T.DoubleType()), *_strings("rationale", "category", "error")]))
def _verdicts(replies: pd.Series) -> pd.DataFrame:
    empty = dict.fromkeys([*FIELDS, "error"])
    return pd.DataFrame([empty | _verdict(r) for r in replies], columns=list(empty))


@F.pandas_udf(T.ArrayType(T.StructType(_strings("text", "type", "identifier"))))
def _entity_lists(replies: pd.Series) -> pd.Series:
    return pd.Series([_entities(r) for r in replies], dtype=object)


def judge_verdict(reply: Column) -> Column:
    """(confidence, rationale, category, error) of a judge's reply; exactly one of confidence and error is set."""
    return _verdicts(reply)


def extracted_entities(reply: Column) -> Column:
    """Entities of an extractor's reply; null where it failed (which is not the same as none)."""
    return _entity_lists(reply)
