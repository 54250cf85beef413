"""Token claims, retry rules and time budgets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares and floors of a check's deadline.
EMBED_SHARE, MARGIN, EMBED_FLOOR, JUDGE_FLOOR = 1.0 / 3.0, 0.9, 1.5, 3.0


def claims_valid(claims: Column, now: Column, leeway: float = 0.0, issuer: str | None = None, audience: str | None = None) -> Column:
    """Whether already decoded claims (JSON) hold: an expiry is required; not-before, issuer and audience where given."""
    number = lambda name: F.regexp_like(F.get_json_object(claims, f"$.{name}"), F.lit(r"^-?[0-9]+(\.[0-9]+)?$"))
    value = lambda name: F.get_json_object(claims, f"$.{name}").cast("double")
    good = number("exp") & (now <= value("exp") + leeway)
    good = good & ~(F.coalesce(number("nbf"), F.lit(False)) & (now < value("nbf") - leeway))
    if issuer is not None:
        good = good & (F.get_json_object(claims, "$.iss") == issuer)
    if audience is not None:
        listed = F.from_json(F.get_json_object(claims, "$.aud"), "array<string>")
        good = good & ((F.get_json_object(claims, "$.aud") == audience) | F.coalesce(F.array_contains(listed, audience), F.lit(False)))
    return F.coalesce(good, F.lit(False))


def external_identity(claims: Column, org_names: list[str], user_names: list[str]) -> Column:
    """``org|user`` from the first claims that are not blank; null where either is missing."""
    first = lambda names: F.coalesce(*[F.nullif(F.trim(F.get_json_object(claims, f"$.{n}")), F.lit("")) for n in names])
    org, user = first(org_names), first(user_names)
    return F.when(org.isNotNull() & user.isNotNull(), F.concat(org, F.lit("|"), user))


def tenant_id(identity: Column) -> Column:
    return F.sha2(identity.cast("binary"), 256)


def retryable(error: Column, status: Column) -> Column:
    """Timeouts and connection errors, or status 429 and 5xx."""
    named = F.lower(error).contains("timeout") | F.lower(error).contains("connect")
    return F.coalesce(named, F.lit(False)) | F.coalesce((status == 429) | (status >= 500), F.lit(False))


def backoff_schedule(retries: Column, base: Column) -> Column:
    """The waits before each retry: base, doubled every time; none without retries."""
    waits = F.transform(F.sequence(F.lit(0), F.greatest(retries - 1, F.lit(0))), lambda i: base * F.pow(F.lit(2.0), i))
    return F.when(retries > 0, waits).otherwise(F.array().cast("array<double>"))


def embed_timeout(deadline: Column, mode: Column) -> Column:
    """The embedding's part of a deadline: a third where a judge may follow, with a floor."""
    share = F.when(mode == "embedding-only", deadline).otherwise(deadline * EMBED_SHARE)
    return F.greatest(F.lit(EMBED_FLOOR), share * MARGIN)


def judge_timeout(deadline: Column) -> Column:
    return F.greatest(F.lit(JUDGE_FLOOR), deadline * (1.0 - EMBED_SHARE) * MARGIN)


def effective(block: Column, flat: Column, default: object) -> Column:
    """A method's parameter: its own block, then the flat setting, then the default."""
    return F.coalesce(block, flat, F.lit(default))
