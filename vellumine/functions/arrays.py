"""Arrays, grids and JSON scalars as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(values: Column) -> Column:
    """Index of the first largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def pad_row(row: Column, width: Column) -> Column:
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0))))


def normalize_grid(rows: Column) -> Column:
    """Ragged rows padded to the widest."""
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: pad_row(r, width))


def split_header(rows: Column) -> Column:
    return F.struct(F.try_element_at(rows, F.lit(1)).alias("headers"), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))).alias("rows"))


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams as strings; empty for fewer tokens."""
    last = F.size(tokens) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), "\x1f")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    joint = F.size(F.array_union(a, b))
    return F.when(joint == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(joint, F.lit(1)))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Sum over distinct items of the smaller count. For short arrays; long ones are grouped and joined."""
    distinct = F.array_intersect(a, b)
    count = lambda v, x: F.size(F.filter(v, lambda y: y == x))
    return F.aggregate(distinct, F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))


def first_present(variant: Column, *paths: str, kind: str = "string") -> Column:
    """The first of several JSON paths that is there."""
    return F.coalesce(*[F.try_variant_get(variant, p, kind) for p in paths])
