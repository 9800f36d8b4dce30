"""String columns: cleanup and token-set similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(s: Column) -> Column:
    """Lower case, runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def tokens(s: Column) -> Column:
    """Distinct tokens of the cleaned string; none for an empty one."""
    return F.array_distinct(F.filter(F.split(clean(s), " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Token-set Jaccard similarity; 0 if either side has no token."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def stable_number(key: Column) -> Column:
    """A number below 2**32 from a string (eight hex digits of its MD5), the same on every run and in every engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
