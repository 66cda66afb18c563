"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends of a text: beside \\n and \\r\\n also the vertical and Unicode separators.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def stripped(c: Column) -> Column:
    """c without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def non_blank(c: Column) -> Column:
    """The stripped text, or null if nothing is left."""
    return F.nullif(stripped(c), F.lit(""))


def matched(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def text_lines(c: Column) -> Column:
    """The lines of a text; a line end at its end opens no further line."""
    parts = F.split(c, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def choices(c: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first rule whose pattern c matches."""
    out = F.lit(None).cast("string")
    first = None
    for pattern, value in rules:
        first = F.when(c.rlike(pattern), value) if first is None else first.when(c.rlike(pattern), value)
    return out if first is None else first.otherwise(F.lit(default))


def union_all(frames: list):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
