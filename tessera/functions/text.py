"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(c: Column, left: bool = True, right: bool = True) -> Column:
    """Without Unicode white space at either end."""
    if left:
        c = F.regexp_replace(c, r"(?U)^\s+", "")
    return F.regexp_replace(c, r"(?U)\s+$", "") if right else c


def tokens(c: Column) -> Column:
    """Lower-cased alphanumeric runs, also split where a lower-case letter or digit meets an upper-case one; null: none."""
    humps = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " ")
    return F.filter(F.split(F.lower(F.regexp_replace(humps, r"[^\p{L}\p{N}]+", " ")), " "), lambda t: t != "")


def occurrences(text: Column, needle: Column) -> Column:
    """How often needle stands in text without overlap."""
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")


def directory(path: Column) -> Column:
    """The path up to its last slash; without one: empty."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading path segments a and b share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    return F.coalesce(F.array_position(same, F.lit(False)) - 1, F.lit(0)) + F.when(F.array_position(same, F.lit(False)) == 0, F.size(same) + 1).otherwise(0)
