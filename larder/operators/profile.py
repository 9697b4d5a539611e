"""Profiling of raw (all-string) uploads and of numeric frames.

Uploads have a dynamic schema, so they are turned into a long "cells" table
``(dataset_id, dataset_type, source_row_number, column_position,
source_column, value)`` with one JVM-side generator pass. Every per-column
statistic is then a ``groupBy`` on the column key: partial aggregation keeps
the shuffle proportional to distinct values, never to rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.names import normalize_name
from larder.functions.parsing import BOOLEAN_TOKENS, parse_date, to_number

CELL_KEY = ["dataset_id", "source_column"]


def to_cells(df: DataFrame, dataset_id: str, dataset_type: str,
             row_col: str = "source_row_number", names: list[str] | None = None,
             defaults: dict[str, str | None] | None = None) -> DataFrame:
    """Wide string upload -> long cells (nulls kept: they are missing values).

    ``names`` adds the mapped name of every column as ``column``; ``defaults``
    adds one cell per constant target. One generator pass, no shuffle.
    """
    cols = [c for c in df.columns if c != row_col]
    cells = [(i, c, F.col(f"`{c}`").cast("string")) for i, c in enumerate(cols)]
    cells += [(len(cols) + i, f"(default) {t}", F.lit(v).cast("string")) for i, (t, v) in enumerate((defaults or {}).items())]
    mapped = [*names, *(defaults or {})] if names else None
    entries = F.array(*[F.struct(F.lit(i).alias("column_position"), F.lit(c).alias("source_column"), v.alias("value"),
                                 *([F.lit(mapped[k]).alias("column")] if mapped else []))
                        for k, (i, c, v) in enumerate(cells)])
    return df.select(F.lit(dataset_id).alias("dataset_id"), F.lit(dataset_type).alias("dataset_type"),
                     F.col(row_col).alias("source_row_number"), F.inline(entries))


def column_stats(cells: DataFrame) -> DataFrame:
    """Per column: counts, type evidence and parsed-date range (one aggregation)."""
    v = F.col("value")
    nonnull = v.isNotNull()
    is_bool = F.lower(F.trim(v)).isin(BOOLEAN_TOKENS)
    is_num = to_number(v).isNotNull()
    pdate = parse_date(v)
    per_col = cells.groupBy("dataset_id", "dataset_type", "source_column", "column_position").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(v).alias("n_nonnull"),
        F.count_if(nonnull & ~is_bool).alias("n_not_bool"),
        F.count_if(nonnull & ~is_num).alias("n_not_num"),
        F.count_if(pdate.isNotNull()).alias("n_date"),
        F.min(pdate).alias("date_min"),
        F.max(pdate).alias("date_max"))
    uniques = (cells.where(nonnull).groupBy(*CELL_KEY, "value").agg(F.lit(1).alias("_one"))
               .groupBy(*CELL_KEY).agg(F.count(F.lit(1)).alias("unique_count")))
    return per_col.join(uniques, CELL_KEY, "left").fillna(0, ["unique_count"])


def detect_type(stats: DataFrame) -> DataFrame:
    """unknown / boolean / numeric / date (>= 90 % parse) / categorical (<= 0.5 unique) / text."""
    n = F.col("n_nonnull")
    t = (F.when(n == 0, "unknown")
         .when(F.col("n_not_bool") == 0, "boolean")
         .when(F.col("n_not_num") == 0, "numeric")
         .when(F.col("n_date") / n >= 0.9, "date")
         .when(F.col("unique_count") / F.greatest(F.lit(1), n) <= 0.5, "categorical")
         .otherwise("text"))
    return stats.withColumn("detected_type", t)


def sample_values(cells: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` distinct non-null values per column, in file order.

    ``row_number() <= k`` becomes a WindowGroupLimit, applied map-side before
    the shuffle, so a column with huge numbers of values ships only k per task.
    """
    first_seen = cells.where(F.col("value").isNotNull()).groupBy(*CELL_KEY, "value").agg(
        F.min("source_row_number").alias("first_row"))
    w = Window.partitionBy(*CELL_KEY).orderBy("first_row", "value")
    top = first_seen.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
    return top.groupBy(*CELL_KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first_row", "value"))),
                    lambda s: s["value"]).alias("sample_values"))


def column_profile(cells: DataFrame) -> DataFrame:
    stats = detect_type(column_stats(cells))
    samples = sample_values(cells)
    return stats.join(samples, CELL_KEY, "left").select(
        "dataset_id", "dataset_type", "source_column", "column_position",
        normalize_name(F.col("source_column")).alias("normalized_column"),
        "detected_type",
        F.coalesce(F.col("sample_values"), F.array().cast("array<string>")).alias("sample_values"),
        (F.col("n_rows") - F.col("n_nonnull")).alias("missing_count"),
        F.col("unique_count").cast("bigint").alias("unique_count"),
        "date_min", "date_max")


def duplicate_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows repeating an earlier row (nulls equal): count - count(distinct row)."""
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    return df.agg(F.count(F.lit(1)).alias("row_count"),
                  (F.count(F.lit(1)) - F.count_distinct(row)).alias("duplicate_row_count"))


def table_profile(df: DataFrame, dataset_id: str, dataset_type: str, profile: DataFrame) -> DataFrame:
    """row/column counts, duplicate rows, date range of the first date column."""
    cols = [c for c in df.columns if c != "source_row_number"]
    dups = duplicate_rows(df, cols).withColumn("dataset_id", F.lit(dataset_id))
    first_date = (profile.where((F.col("dataset_id") == dataset_id) & (F.col("detected_type") == "date"))
                  .groupBy("dataset_id")
                  .agg(F.min_by(F.struct("date_min", "date_max"), F.col("column_position")).alias("d")))
    return dups.join(first_date, "dataset_id", "left").select(
        "dataset_id", F.lit(dataset_type).alias("dataset_type"),
        "row_count", F.lit(len(cols)).cast("bigint").alias("column_count"), "duplicate_row_count",
        F.col("d.date_min").alias("date_min"), F.col("d.date_max").alias("date_max"))
