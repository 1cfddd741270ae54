"""Hashes whose values do not depend on engine, row order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of md5 that make the unit-interval value: 52 bits, exact in a double.
UNIT_HEX = 13
#: Separates the parts of a hashed key, so that no two lists of parts give the same string.
SEPARATOR = "\x1f"


def unit_hash(*parts: Column) -> Column:
    """A value in [0, 1) from the md5 of the parts as text. Null parts count as empty text.

    The same parts give the same value in any engine that has md5."""
    text = F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, UNIT_HEX), 16, 10).cast("double") / F.lit(float(2 ** (4 * UNIT_HEX)))
