"""Masking of credentials in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mask, the field names whose value is secret, and the ordered
# patterns: headers, JSON fields, name=value pairs, DSNs, web tokens, provider keys
# (a name in capitals and underscores is no key).
MASK = "[REDACTED]"
SECRET_NAMES = (
    "api[_-]?key|apikey|access[_-]?token|refresh[_-]?token|id[_-]?token"
    "|token|secret|password|passwd|pwd|authorization|auth|credential"
    "|client[_-]?secret|private[_-]?key|dsn|shared[_-]?secret"
    "|x[_-]?service[_-]?key|service[_-]?key|pepper"
)
CREDENTIALS = [
    (r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._\-+/=]{8,}", "$1 " + MASK),
    (rf'(?i)("(?:{SECRET_NAMES})"\s*:\s*)"[^"]*"', f'$1"{MASK}"'),
    (rf"(?i)(?<![A-Za-z0-9])({SECRET_NAMES})\s*[=:]\s*[^\s,;&'\"}}\]]+", "$1=" + MASK),
    (r"(?i)\b([a-z][a-z0-9+.\-]*://)[^:/@\s]+:[^@\s]+@", "$1" + MASK + "@"),
    (r"\beyJ[A-Za-z0-9._\-]{10,}\.[A-Za-z0-9._\-]+\.[A-Za-z0-9._\-]*", MASK),
    (r"(?i)\b(sk|sc|pk|rk|ghp|gho|xox[abps])[-_](?-i:(?![A-Z_]+\b))[A-Za-z0-9._\-]{8,}", MASK),
]


def redact(text: Column, patterns: list[tuple[str, str]] = CREDENTIALS) -> Column:
    """Apply (pattern, replacement) pairs in order."""
    for pattern, replacement in patterns:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def redact_body(text: Column, limit: int = 500) -> Column:
    """Masked, then cut at ``limit`` characters with a note of the masked length."""
    masked = redact(text)
    note = F.concat(F.substring(masked, 1, limit), F.lit("... [truncated, "), F.length(masked).cast("string"), F.lit(" chars]"))
    return F.when(F.length(masked) > limit, note).otherwise(masked)
