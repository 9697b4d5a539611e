"""Keys that several rows have, found without moving the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import stored

MARK = "_mark"


def mark_of(keys: list[str]) -> Column:
    """64-bit hash of a key; null is a value like any other."""
    return F.xxhash64(*keys)


def repeated_marks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hashes of the keys that several rows have, stored as column ``_mark``; two keys of one hash are named too.

    Only the hashes move, and they are dealt before they are counted, as nearly all of them differ."""
    marks = df.select(mark_of(keys).alias(MARK)).repartition(MARK)
    return stored(marks.groupBy(MARK).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(MARK), "repeated")
