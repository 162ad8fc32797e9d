"""Small text expressions shared by every rule."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point str.isspace() accepts; Spark's one-argument trim strips only U+0020.
UNICODE_SPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())

# Line ends recognised by str.splitlines().
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def strip(col: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.trim(col, F.lit(UNICODE_SPACE))


def split_lines(col: Column) -> Column:
    """Lines of a text, on every Unicode line boundary."""
    return F.split(col, LINE_BREAK)


def find_all(col: Column, pattern: str) -> Column:
    """All whole matches of a Java regular expression, in order."""
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def matches(col: Column, pattern: str) -> Column:
    return col.rlike(pattern)


def str_array(values) -> Column:
    """Literal ARRAY<STRING> of plain words, also when empty (one call to the JVM)."""
    return F.expr("cast(array(" + ", ".join(f"'{v}'" for v in values) + ") as array<string>)")


def after_first(arr: Column) -> Column:
    """All elements but the first (arrays cannot reach the length named here)."""
    return F.slice(arr, F.lit(2), F.lit(1 << 30))


def present(flagged: list[tuple[Column, str]]) -> Column:
    """Names whose flag is true, in the given order."""
    return F.array_compact(F.array(*[F.when(flag, F.lit(name)) for flag, name in flagged]))


def latin1_clean(col: Column) -> Column:
    """Map typographic punctuation to ASCII and anything outside Latin-1 to '?'."""
    plain = F.translate(col, "–—‘’“”", "--''\"\"")
    plain = F.replace(plain, F.lit("…"), F.lit("..."))
    return F.regexp_replace(plain, "[^\\x{00}-\\x{FF}]", "?")
