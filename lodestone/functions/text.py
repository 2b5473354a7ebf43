"""Column functions on text: lines, comments, tokens and pattern captures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One block comment, its inside captured.
BLOCK_COMMENT = r"(?s)/\*(.*?)\*/"


def strip(c: Column) -> Column:
    """Trims every kind of white space, not spaces alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def all_of(c: Column, pattern: str, group: int = 1) -> Column:
    """Every capture of ``group`` in order."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def listed(c: Column, sep: str = ",") -> Column:
    """Splits, trims and drops empty parts."""
    return F.filter(F.transform(F.split(c, sep), strip), lambda x: x != "")


def or_null(c: Column) -> Column:
    """Null for the empty string that an optional group gives when it is absent."""
    return F.nullif(c, F.lit(""))


def utf8(content: Column) -> Column:
    """Binary as text; invalid bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def query_terms(query: str) -> list[str]:
    """White-space separated terms of two characters or more; repeats count."""
    return [t for t in query.split() if len(t) >= 2]
