"""Guard policies and parameters, checked against a table of shapes.

What a policy document or a parameter block may hold is data (``POLICY``,
``PARAMETERS``): one walk over a value and its shape lists every problem, and a
table of conditions covers what fields say about each other. Policies of many
tenants are rows: ``policy_tables`` checks and explodes them in Spark.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, make_dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # JSON is a subset of YAML
    yaml = None

# Limits, roles, accepted keys.
MAX_POLICY_BYTES = 262_144
MAX_EXEMPLARS = 5_000
ROLES = ("user", "system", "assistant", "tool")
BOOKKEEPING = ("tenant_id", "policy_version", "source_ref", "last_reviewed_by", "language")


class PolicyError(ValueError):
    """A policy or parameter block that must not be used."""


@dataclass(frozen=True)
class Shape:
    """What a value may be: ``kinds`` of Python, a range, a choice, the shape of list items or of a mapping's fields.

    ``need``: it must be there; ``filled``: texts and lists may not be empty.
    """

    kinds: tuple[type, ...]
    default: object = None
    need: bool = False
    filled: bool = False
    among: tuple = ()
    within: tuple[float, float] | None = None
    item: Shape | None = None
    fields: dict[str, Shape] = field(default_factory=dict)

    def problems(self, value: object, where: str) -> Iterator[str]:
        if value is None:
            if self.need:
                yield f"{where} is missing"
            return
        if not isinstance(value, self.kinds) or (isinstance(value, bool) and bool not in self.kinds):
            yield f"{where} must be of {' or '.join(k.__name__ for k in self.kinds)}"
            return
        if self.filled and not (value.strip() if isinstance(value, str) else value):
            yield f"{where} is empty"
        if self.among and not set(value if isinstance(value, (list, tuple)) else [value]) <= set(self.among):
            yield f"{where} must be among {', '.join(map(str, self.among))}"
        if self.within and not self.within[0] <= value <= self.within[1]:
            yield f"{where} must be from {self.within[0]} to {self.within[1]}"
        for i, one in enumerate(value if self.item else ()):
            yield from self.item.problems(one, f"{where}[{i}]")
        if self.fields:
            yield from (f"{where} has no field {name}" for name in sorted(map(str, set(value) - set(self.fields))))
            for name, shape in self.fields.items():
                yield from shape.problems(value.get(name), f"{where}.{name}")


_TEXT = Shape((str,))
_SHARE = lambda default: Shape((int, float), default, within=(0, 1))
_COUNT = lambda default, most: Shape((int,), default, within=(1, most))
_EXEMPLARS = Shape((list,), item=Shape((str,), need=True, filled=True))
CATEGORY = Shape((dict,), need=True, fields={
    "category_id": Shape((str,), need=True, filled=True), "description": _TEXT, "refusal": _TEXT, "action": Shape((str,), "block", among=("block", "flag")),
    "disallowed_exemplars": _EXEMPLARS, "allowed_exemplars": _EXEMPLARS,
})
POLICY = Shape((dict,), need=True, fields={"categories": Shape((list,), need=True, filled=True, item=CATEGORY), "default_refusal": _TEXT} | dict.fromkeys(BOOKKEEPING, Shape((object,))))
PARAMETERS = Shape((dict,), need=True, fields={
    "enabled": Shape((bool,)), "policy": _TEXT, "mode": Shape((str,), "embedding-only", among=("embedding-only", "cascade", "judge-only", "max")),
    "top_k": _COUNT(8, 100), "min_similarity": _SHARE(0.6), "block_threshold": _SHARE(0.85), "allow_threshold": _SHARE(0.40),
    "judge_block_threshold": _SHARE(0.60), "judge_allow_threshold": _SHARE(0.40), "embed_model": _TEXT, "embed_api_key": _TEXT, "judge_model": _TEXT,
    "judge_api_key": _TEXT, "judge_task_description": Shape((str,), "a customer support assistant"), "judge_max_concurrency": _COUNT(4, 64),
    "check_roles": Shape((list, tuple), ("user", "system", "tool"), filled=True, among=ROLES), "max_segments": _COUNT(32, 500),
    "max_input_chars": _COUNT(16_000, 1_000_000), "default_refusal": _TEXT, "unavailable_refusal": _TEXT, "log_turn_text": Shape((bool,), False),
    "embed_prefix_style": Shape((str,), "none", among=("none", "e5")), "unavailable_response": Shape((str,), "error", among=("error", "refusal")),
    "degrade_to_unguarded": Shape((bool,), False),
})
GuardParams = make_dataclass("GuardParams", [(name, object, field(default=shape.default)) for name, shape in PARAMETERS.fields.items()])


def _judged(p: GuardParams) -> bool:
    return bool(p.judge_model and p.judge_api_key)


# What fields say about each other: the problem, and when there is none.
COHERENT: dict[str, Callable[[GuardParams], bool]] = {
    "thresholds cross": lambda p: p.allow_threshold <= p.block_threshold,
    "thresholds of the judge cross": lambda p: p.judge_allow_threshold <= p.judge_block_threshold,
    "the mode needs a judge's model and key": lambda p: p.mode == "embedding-only" or _judged(p),
    "a policy needs enabled to be given": lambda p: not p.policy or p.enabled is not None,
    "enabled needs a policy": lambda p: not p.enabled or bool((p.policy or "").strip()),
}


@dataclass
class Policy:
    """A checked policy: its texts by category, and its exemplars as (ord, category, label, text)."""

    categories: dict[str, dict]
    exemplars: list[tuple[int, str, str, str]]
    default_refusal: str | None = None

    @property
    def actions(self) -> dict[str, str]:
        return {name: c.get("action") or "block" for name, c in self.categories.items()}

    def _texts(self, kind: str) -> dict[str, str]:
        return {name: c[kind] for name, c in self.categories.items() if c.get(kind) is not None}

    @property
    def refusals(self) -> dict[str, str]:
        return self._texts("refusal")

    @property
    def descriptions(self) -> dict[str, str]:
        return self._texts("description")

    def problems(self, max_exemplars: int) -> Iterator[str]:
        labels = [label for _, _, label, _ in self.exemplars]
        yield from (f"no {label} exemplars" for label in ("allowed", "disallowed") if label not in labels)
        if "block" not in self.actions.values():
            yield "no category blocks"
        if len(labels) > max_exemplars:
            yield f"over {max_exemplars} exemplars"

    def frame(self, spark: SparkSession) -> DataFrame:
        """(ord, category_id, label, text, action), in document order, disallowed first in each category."""
        rows = [(*e, self.actions[e[1]]) for e in self.exemplars]
        return spark.createDataFrame(rows, "ord int, category_id string, label string, text string, action string")


def _refuse(problems: Iterator[str]) -> None:
    if found := list(problems):
        raise PolicyError("; ".join(found))


def _load(text: str) -> object:
    """The document's value; anchors are refused, as they could make a small text large."""
    try:
        if yaml is None:
            return json.loads(text)
        if any(isinstance(e, yaml.AliasEvent) or getattr(e, "anchor", None) for e in yaml.parse(text, Loader=yaml.SafeLoader)):
            raise PolicyError("anchors and aliases are not allowed")
        return yaml.safe_load(text)
    except (ValueError, *((yaml.YAMLError,) if yaml else ())) as e:
        raise PolicyError(f"not a document: {e}") from e


def parse_policy(text: str, max_bytes: int = MAX_POLICY_BYTES, max_exemplars: int = MAX_EXEMPLARS) -> Policy:
    """A policy document (YAML or JSON) with its exemplars numbered; raises with all problems where there are any."""
    if not isinstance(text, str) or len(text.encode()) > max_bytes:  # before any parser sees it
        raise PolicyError(f"a policy is a text of at most {max_bytes} bytes")
    doc = _load(text)
    _refuse(POLICY.problems(doc, "policy"))
    names = [c["category_id"].strip() for c in doc["categories"]]
    _refuse(f"category {n!r} is given twice" for n in sorted(set(names)) if names.count(n) > 1)
    listed = [(name, label, t.strip()) for name, c in zip(names, doc["categories"]) for label in ("disallowed", "allowed") for t in c.get(f"{label}_exemplars") or []]
    made = Policy(dict(zip(names, doc["categories"])), [(i, *e) for i, e in enumerate(listed)], doc.get("default_refusal"))
    _refuse(made.problems(max_exemplars))
    return made


def policy_tables(policies: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Policies of many tenants, one document a row: (id, ord, category_id, label, text, action, problem).

    A policy that must not be used gives one row with its ``problem`` and no
    exemplar; the others give their exemplars. A null document is a problem too.
    """
    schema = "ord int, category_id string, label string, text string, action string, problem string"

    @F.pandas_udf(f"array<struct<{schema.replace(' ', ': ').replace(',: ', ', ')}>>")
    def parsed(documents: pd.Series) -> pd.Series:
        def one(document: str | None) -> list[tuple]:
            try:
                policy = parse_policy(document)
            except PolicyError as e:
                return [(None, None, None, None, None, str(e))]
            return [(*e, policy.actions[e[1]], None) for e in policy.exemplars]

        return pd.Series([one(d) for d in documents], dtype=object)

    return policies.select(F.col(id_col).alias("id"), F.explode(parsed(F.col(text_col))).alias("e")).select("id", "e.*")


def guard_params(block: dict) -> GuardParams:
    """Parameters of a block: ``x_`` keys are dropped, unknown ones refused, an omitted mode follows the judge."""
    if "fail_open" in block:
        raise PolicyError("fail_open is no guard field; degrade_to_unguarded is")
    given = {k: v for k, v in block.items() if not str(k).startswith("x_")}
    _refuse(PARAMETERS.problems(given, "guard"))
    made = GuardParams(**given)
    if "mode" not in given and _judged(made):
        made.mode = "cascade"
    _refuse(problem for problem, fine in COHERENT.items() if not fine(made))
    return made


def _digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def index_key(policy_text: str, model: str, base_url: str, api_key: str, prefix_style: str = "none") -> str:
    """Identity of what changes the exemplars' vectors."""
    print_ = hashlib.sha256(api_key.encode()).hexdigest()
    policy = hashlib.sha256(policy_text.encode()).hexdigest()
    return _digest({"embed_model": model, "embed_base_url": base_url, "embed_key_fp": print_, "policy_hash": policy, "prefix_style": prefix_style})


def params_hash(p: GuardParams) -> str:
    """Identity of what changes a decision on given vectors; refusal texts and switches are no part of it."""
    names = (
        "mode top_k min_similarity block_threshold allow_threshold judge_block_threshold judge_allow_threshold "
        "judge_model judge_task_description max_segments max_input_chars"
    ).split()
    own = {n: getattr(p, n) for n in names}
    own["judge_key_fp"] = hashlib.sha256((p.judge_api_key or "").encode()).hexdigest()
    own["check_roles"] = sorted(p.check_roles)
    return _digest(own)
