"""All matches of a pattern in a text, with the lines where they begin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\x00"


def matches(text: Column, pattern: str, groups: int = 1) -> Column:
    """Array of (line, g1, g2, ...): each match's first line with other than white space, and its groups.

    A mark goes before each match and past its leading white space; marks are then counted
    line by line, so the cost is linear in the text.
    """
    clean = F.translate(text, _MARK, "")
    marked = F.regexp_replace(F.regexp_replace(clean, pattern, _MARK + "$0"), _MARK + r"(\s*)", "$1" + _MARK)
    per_line = F.transform(F.split(marked, "\n", -1), lambda x, k: F.array_repeat(k + 1, (F.length(x) - F.length(F.translate(x, _MARK, ""))).cast("int")))
    found = [F.regexp_extract_all(clean, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(1, groups + 1)]
    return F.arrays_zip(F.flatten(per_line).alias("line"), *found)
