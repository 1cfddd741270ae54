"""Identifiers of records and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of derived identifiers (fixed value).
ID_NAMESPACE = "6f0c2f1e-2e35-5f1a-8b1b-7a1f6e8c9d2a"
UUID_FORM = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def is_native_id(column: Column) -> Column:
    """Whether a point store takes the id as it is: digits only, or a UUID."""
    return F.coalesce(column.rlike("^[0-9]+$") | column.rlike(UUID_FORM), F.lit(False))


def uuid5(column: Column, namespace: str = ID_NAMESPACE) -> Column:
    """The version-5 UUID of a text, byte for byte as RFC 9562 defines it."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(column, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def point_id(column: Column) -> Column:
    """The id under which a point store keeps a record: native ids as they are, else a derived UUID."""
    return F.when(is_native_id(column), column).otherwise(uuid5(column))


def file_safe(column: Column) -> Column:
    """Letters, digits, ``-`` and ``_`` stay; everything else becomes ``_``."""
    return F.regexp_replace(column, r"[^\p{L}\p{N}_-]", "_")
