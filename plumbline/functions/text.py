"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def half_width(c: Column) -> Column:
    """Full-width letters, digits, punctuation and blank as ASCII."""
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def key(c: Column) -> Column:
    """An id for comparison: without regard to case, width and blanks at the ends; null where nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(half_width(c), r"^[\s\p{Z}\x{200B}\x{FEFF}]+|[\s\p{Z}\x{200B}\x{FEFF}]+$", "")), F.lit(""))
