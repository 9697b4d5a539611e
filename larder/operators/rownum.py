"""Dense global row numbers without a single-partition window.

``row_number() over (order by k)`` with no partition clause pulls every row into
one task. Here the rows are range-partitioned on the sort key, sorted inside
each partition, and numbered as ``offset(partition) + position``. The offsets
come from a per-partition count table whose size is bounded by the number of
partitions, so broadcasting it is safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import stored

_POS_BITS = 33  # monotonically_increasing_id = partition_id << 33 | position


def global_row_number(df: DataFrame, order_cols: list[str | Column], name: str = "row_number",
                      start: int = 1, num_partitions: int | None = None) -> DataFrame:
    """Append ``name`` = 1-based rank of each row in ``order_cols`` order (+ start - 1).

    The order key should be unique; ties get distinct but arbitrary numbers.
    Runs one job eagerly (the write).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    rid = F.monotonically_increasing_id()
    # Range bounds come from sampling whose seed depends on the RDD id, so two
    # evaluations of the same plan may cut differently. Checkpoint the tagged
    # rows (a table in the shared checkpoint folder) so positions and partition sizes come
    # from one materialisation; it also survives executor loss.
    # The rows are written as columns, which later readers of few columns need not read whole.
    tagged = stored(ranged.withColumn("_rn_id", rid)
                    .withColumn("_rn_part", F.shiftright(F.col("_rn_id"), _POS_BITS))
                    .withColumn("_rn_pos", F.col("_rn_id").bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
                    .drop("_rn_id"), "numbered")
    sizes = tagged.groupBy("_rn_part").agg(F.count(F.lit(1)).alias("_rn_size"))
    # At most `n` rows: a single-partition window here is bounded by design.
    before = Window.orderBy("_rn_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_rn_part", F.coalesce(F.sum("_rn_size").over(before), F.lit(0)).alias("_rn_off"))
    return (tagged.join(F.broadcast(offsets), "_rn_part")
            .withColumn(name, (F.col("_rn_off") + F.col("_rn_pos") + F.lit(start)).cast("bigint"))
            .drop("_rn_part", "_rn_pos", "_rn_off"))


def row_number_within(df: DataFrame, group_cols: list[str], order_cols: list[str | Column],
                      name: str = "row_number", start: int = 1) -> DataFrame:
    """Row number inside each group (e.g. within one source file)."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(name, (F.row_number().over(w) + F.lit(start - 1)).cast("bigint"))
