"""Column expressions on text. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the library understands it: Unicode spaces and the information separators.
SPACE = r"[\s\x1c-\x1f]"


def strip(value: Column) -> Column:
    """Remove surrounding Unicode white space (``trim`` removes only U+0020)."""
    return F.regexp_replace(value, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def fold(value: Column) -> Column:
    """Text without case, white space (visible or not), control characters and punctuation.

    Case is folded over upper and back to lower case, so that ``ß`` equals ``SS``; the replacement
    between keeps the optimizer from dropping the first of the two. Symbols and marks stay. NULL stays NULL; a text of nothing but such characters becomes ''.
    """
    # Categories are Unicode ones as they stand, and hold all white space.
    bare = F.regexp_replace(value, r"[\p{P}\p{Z}\p{Cc}\p{Cf}]+", "")
    return F.lower(F.replace(F.upper(bare), F.lit("ẞ"), F.lit("SS")))
