"""Ragged arrays: flat values with lengths, and array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def begins(lengths: Column, *order: str, by: tuple[str, ...] = ()) -> Column:
    """The first (1-based) place of each part in the flat values: lengths of the parts before it plus 1."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(lengths).over(w), F.lit(0)) + 1


def parts(flat: Column, lengths: Column) -> Column:
    """Array of arrays from flat values and the lengths of the parts."""
    ends = F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, 1, i + 1), F.lit(0), lambda a, x: a + x))
    return F.transform(F.arrays_zip(ends.alias("e"), lengths.alias("n")), lambda p: F.slice(flat, p["e"] - p["n"] + 1, p["n"]))


def flat(nested: Column) -> Column:
    return F.flatten(nested)


def lengths(nested: Column) -> Column:
    return F.transform(nested, lambda x: F.size(x))


def union_sorted(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def matches(a: Column, b: Column) -> Column:
    """The place in b of each element of a; 0 if it isn't there."""
    return F.transform(a, lambda x: F.array_position(b, x))


def without(a: Column, places: Column) -> Column:
    """a without the elements at some (1-based) places."""
    return F.filter(a, lambda _, i: ~F.array_contains(places, i + 1))


def inserted(a: Column, place: Column | int, b: Column) -> Column:
    """a with the elements of b from a (1-based) place on; one past the end appends. Null outside of that."""
    place = place if isinstance(place, Column) else F.lit(place)
    inside = (place >= 1) & (place <= F.size(a) + 1)
    return F.when(inside, F.concat(F.slice(a, 1, F.greatest(place - 1, F.lit(0))), b, F.slice(a, F.greatest(place, F.lit(1)), F.size(a))))


def reordered(a: Column, places: Column) -> Column:
    """The elements of a at some (1-based) places, in their order; a place that isn't there gives null."""
    return F.transform(places, lambda i: F.when((i >= 1) & (i <= F.size(a)), F.get(a, i - 1)))


def cumulative(a: Column) -> Column:
    return F.transform(a, lambda _, i: F.aggregate(F.slice(a, 1, i + 1), F.lit(0.0), lambda s, x: s + x))


def matrix(rows: Column, cols: Column, data: Column) -> Column:
    """Array of rows from row-major data."""
    return F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.slice(data, r * cols + 1, cols))


def heaviside(x: Column) -> Column:
    return F.when(x > 0, 1.0).when(x < 0, 0.0).otherwise(0.5)


def explode_parts(df: DataFrame, column: str, to: str = "value") -> DataFrame:
    """A row for each element: part and place (from 0)."""
    return df.select("*", F.posexplode(column).alias("part", "_p")).select("*", F.posexplode("_p").alias("place", to)).drop("_p")
