"""Column expressions for untidy short labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms of the ASCII letters, digits and signs, and the ASCII they stand for.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def compact(c: Column) -> Column:
    """Letters only, lower case, full-width forms narrowed: 'Sound Effect', 'sound_effect' -> 'soundeffect'."""
    return F.regexp_replace(F.lower(F.translate(c, WIDE, NARROW)), r"[^\p{L}]", "")


def to_ms(seconds: Column) -> Column:
    """Seconds to whole milliseconds; NULL for NULL, NaN and infinite values."""
    finite = F.abs(seconds) < F.lit(9e12)
    return F.when(finite, F.round(seconds * 1000).cast("long"))
