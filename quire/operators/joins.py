"""Joins on time: the last row before each row, and rows whose intervals meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.plans.storage import discard, durable


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: Sequence[str], most: str | None = None) -> DataFrame:
    """Every row of ``left`` with ``columns`` of the last row of ``right`` of its key at or before its time; nulls where there is none.

    Both sides are put in one order of (key, time), written in ranges, and the last right row is carried
    along each range; what a range begins with comes from the ranges before it, of which one row each is
    kept. So a key that fills many ranges is many tasks, and no pairs are made. Of right rows of equal
    key and time the one with the greatest ``columns`` counts. Rows of ``left`` without key or time find
    nothing and stay; ``most`` bounds the age of what is found, as an interval.
    """
    here = F.struct(*left.columns)
    there = F.struct(F.col(right_time).cast("timestamp_ntz").alias("_at"), *columns)
    time = lambda c: F.col(c).cast("timestamp_ntz")
    known = (F.col(key).isNotNull() & F.col(left_time).isNotNull())
    lone = F.lit(None).cast(dict(right.select(there.alias("r")).dtypes)["r"])
    rows = left.where(known).select(F.col(key).alias("_k"), time(left_time).alias("_t"), F.lit(1).alias("_side"), here.alias("_left"), lone.alias("_right"))
    facts = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(key).alias("_k"), time(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(dict(rows.dtypes)["_left"]).alias("_left"), there.alias("_right")
    )
    order = ["_k", "_t", "_side", "_right"]
    # the left row takes part in the order, so that equal times of a hot key are split as well
    spread = F.xxhash64(F.to_json("_left"))
    ranged = rows.unionByName(facts).withColumn("_spread", spread).repartitionByRange(*order, "_spread").withColumn("_range", F.spark_partition_id())
    ranged = durable(ranged, "as-of-ranges")
    # a range begins with some key and ends with the last right row that it has seen, of whatever key
    seen = F.when(F.col("_side") == 0, F.struct("_k", "_t", "_right"))
    ends = ranged.groupBy("_range").agg(F.max(seen).alias("last"))
    carried = durable(ends.select("_range", F.last("last", ignorenulls=True).over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_before")), "as-of-carried")
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    told = ranged.withColumn("_seen", F.last(seen, ignorenulls=True).over(within)).where("_side = 1").join(carried, "_range")
    found = F.coalesce("_seen", "_before")
    # what was seen last belongs to an earlier key where this key has had no right row yet
    fits = found["_k"] == F.col("_k")
    if most is not None:
        fits = fits & (F.col("_t") - found["_t"] <= F.expr(f"interval {most}"))
    value = F.when(fits, found["_right"])
    joined = told.select("_left.*", *[value[c].alias(c) for c in columns])
    empty = left.where(~known).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns])
    return joined.unionByName(empty)


def bins_of(begin: Column, end: Column, seconds: int) -> Column:
    """The numbers of all bins of time that an interval touches; none for one that ends before it begins."""
    number = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")
    return F.when(begin <= end, F.sequence(number(begin), number(end))).otherwise(F.array().cast("array<long>"))


def typical_seconds(rows: DataFrame, begin: str, end: str) -> int:
    """The mean length of intervals, at least a second: with bins that long, an interval is in about two."""
    micros = F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(begin).cast("timestamp"))
    mean = rows.where(F.col(begin) <= F.col(end)).agg(F.avg(micros).alias("m")).first()["m"]
    return max(1, round((mean or 0) / 1e6))


def intervals_meet(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], seconds: int | None = None) -> DataFrame:
    """All pairs of rows of equal key whose closed intervals share a moment; a moment is an interval that ends as it begins.

    Time is cut into bins, an interval stands once in every bin it touches, and bins of a key are joined:
    an equi-join, whose hot keys are as many groups as they have bins. A pair that shares several
    bins is kept in the first of them alone. Columns of both sides must have different names but for the key.
    Rows without key, begin or end meet nothing.
    """
    seconds = seconds or max(typical_seconds(left, *left_span), typical_seconds(right, *right_span))
    binned = lambda rows, span: rows.where(F.col(key).isNotNull()).withColumn("_bin", F.explode(bins_of(F.col(span[0]), F.col(span[1]), seconds)))
    (a, b), (c, d) = left_span, right_span
    pairs = binned(left, left_span).join(binned(right, right_span), [key, "_bin"])
    first = F.floor(F.unix_micros(F.greatest(F.col(a), F.col(c)).cast("timestamp")) / F.lit(seconds * 1_000_000))
    return pairs.where((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("_bin") == first)).drop("_bin")
