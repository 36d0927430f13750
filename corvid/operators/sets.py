"""Set operations on id tables and on sorted arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, tables).distinct()


def intersect(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.intersect, tables)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def concat(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, tables)


def array_union(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def array_union_multi(arrays: Column) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(arrays)))


def array_intersect(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def array_intersect_multi(arrays: Column) -> Column:
    return F.sort_array(F.reduce(arrays, F.element_at(arrays, 1), F.array_intersect))


def array_difference(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_except(a, b))


def array_concat(arrays: Column) -> Column:
    return F.flatten(arrays)


def positions(array: Column, values: Column) -> Column:
    """The place of each value in a sorted array, from 0."""
    return F.transform(values, lambda v: (F.array_position(array, v) - 1).cast("int"))


def array_top_k(scores: Column, k: int) -> Column:
    """Indices of the k greatest entries, best first; ties go to the smaller index."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(pairs), 1, k), lambda p: p["i"])
