"""String predicates and folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The full-width forms of printable ASCII and the ideographic space, and what they stand for.
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
_NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "


def filled(col: str | Column) -> Column:
    """True where the string is neither null nor empty after trimming (Unicode white space)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.rlike(r"(?U)\S"), F.lit(False))


def folded(col: str | Column) -> Column:
    """Lower case, full-width forms narrowed, every run of other than letters and digits one space."""
    col = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.lower(F.translate(col, _WIDE, _NARROW)), r"[^\p{L}\p{M}\p{N}]+", " "))
