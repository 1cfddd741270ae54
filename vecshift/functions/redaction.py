"""Removal of secrets from text, maps and nested values."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = "***REDACTED***"
# What a secret's key is called, and how secrets look in text.
# ``tokenizer`` metadata is no secret.
KEY = r"(?i)(api[_-]?key|secret|token(?!iz)|password|passwd|credential|authorization|bearer)"
TEXT_RULES = (
    (r"sk-[A-Za-z0-9]{10,}", HIDDEN),
    (r"(?i)(Bearer\s+)[A-Za-z0-9._-]{10,}", "$1" + HIDDEN),
    (r"(?i)((?:api[_-]?key)\s*[:=]\s*)[\"']?[A-Za-z0-9._-]{6,}[\"']?", "$1" + HIDDEN),
)


def redact_text(column: Column) -> Column:
    for pattern, replacement in TEXT_RULES:
        column = F.regexp_replace(column, pattern, replacement)
    return column


def redact_map(column: Column) -> Column:
    """Values of a map of text: hidden whole where the key names a secret, else redacted as text."""
    return F.transform_values(column, lambda k, v: F.when(k.rlike(KEY), HIDDEN).otherwise(redact_text(v)))


def redact(value: Any) -> Any:
    """A nested value of dicts, lists and scalars without its secrets."""
    if isinstance(value, dict):
        return {k: HIDDEN if isinstance(k, str) and re.search(KEY, k) else redact(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [redact(v) for v in value]
    if isinstance(value, str):
        for pattern, replacement in TEXT_RULES:
            value = re.sub(pattern, replacement.replace("$1", r"\1"), value)
    return value
