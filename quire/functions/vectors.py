"""Vectors as array columns: dot products, norms, cosines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is worked out once a row, however often ``fn`` names it, also inside of a lambda."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Of length 1; a zero vector stays."""
    return once(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 if one of them is zero."""
    return once(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): the mean vector of each group. Sums are partial by place, so a hot group is no hot task."""
    places = rows.select(group, F.posexplode(vector).alias("pos", "x"))
    means = places.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))
