"""Running totals inside groups without one task per group.

A window partitioned by the group alone puts a whole group, however large, into
one task. Here the rows are range-partitioned on (group, order), so a large
group spans many partitions; each partition is summed on its own, and the
totals of the partitions before it come from a table with one row per partition
and group in it. The ranged rows are stored because range bounds are
sampled and would differ between two evaluations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.session import stored


def running_total(df: DataFrame, keys: list[str], order: str, amount: str, name: str) -> DataFrame:
    """Append ``name`` = sum of ``amount`` over the group's rows up to and including this one.

    ``order`` must be unique inside a group. Runs one job eagerly.
    """
    return running_totals(df, keys, order, {name: amount})


def running_totals(df: DataFrame, keys: list[str], order: str, amounts: dict[str, str]) -> DataFrame:
    """``running_total`` of several amounts (name -> column) over one layout of the rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *keys, order).withColumn("_part", F.spark_partition_id()), "ranged")
    places = list(enumerate(amounts.items()))
    totals = ranged.groupBy(*keys, "_part").agg(*[F.sum(a).alias(f"_sum{i}") for i, (_, a) in places])
    # At most one row per partition and group that it touches.
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_sum{i}").over(earlier), F.lit(0)).alias(f"_before{i}") for i, _ in places])
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumns({f"_inside{i}": F.sum(a).over(inside) for i, (_, a) in places})
    return summed.join(offsets, [*keys, "_part"]).withColumns({name: F.col(f"_before{i}") + F.col(f"_inside{i}") for i, (name, _) in places}).drop(
        "_part", *[f"{c}{i}" for c in ("_before", "_inside") for i, _ in places])
