"""Name rules (X1-X6): one function, with the kind of the rule as an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each rule removes from the lower-cased name.
DROPPED = {
    "unicode": r"[^\p{L}\p{N}]",
    "ascii": r"[^a-z0-9]",
    "separators": r"[_\s\-]",
    "lower": r"(?!)",
}


def name_key(col: Column | str, kind: str = "ascii") -> Column:
    """The comparison key of a name; null when the name is null or nothing is left of it.

    ``dotted`` takes what follows the last dot before the ASCII rule is applied.
    """
    c = F.col(col) if isinstance(col, str) else col
    if kind == "dotted":
        return name_key(F.element_at(F.split(c, r"\."), -1), "ascii")
    if kind not in DROPPED:
        raise ValueError(f"unknown name rule {kind!r}")
    return F.nullif(F.regexp_replace(F.lower(c), DROPPED[kind], ""), F.lit(""))


def padded_id(col: Column | str, width: int = 5) -> Column:
    """Left-pad an id with zeros (X6); unlike ``lpad`` alone, a longer id is never cut."""
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))
