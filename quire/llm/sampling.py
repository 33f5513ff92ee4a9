"""Bounded, repeatable samples of rows by the hash of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def least_hashed(rows: DataFrame, n: int, *ids: str) -> DataFrame:
    """The n rows of least hash of ``ids``, or all if there are no more.

    Only rows under a hash bound that about 2n of all rows pass are sorted, so what meets in one task is
    a few times n however many rows and tasks there are. ``rows`` is read twice.
    """
    h = F.xxhash64(*ids)
    total = rows.count()
    if total > 2 * n + 100:
        rows = rows.where(F.shiftrightunsigned(h, 1) / F.lit(2.0**63) <= (2.0 * n + 100) / total)
    # the bound is on the upper 63 bits, so these are what is sorted by
    return rows.orderBy(F.shiftrightunsigned(h, 1), *ids).limit(n)
