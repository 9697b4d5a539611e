"""Validation rules over mapped upload cells, in a fixed number of passes.

* cell rules (invalid number, negative, discount range, invalid date, empty
  identifier) are evaluated in ONE scan: each cell yields an array of
  candidate issues, ``inline`` keeps the non-null ones;
* reference rules are one ``left_anti`` join against the known-id table;
* the row rule (expiry before snapshot) pivots two cells per row;
* count rules (missing values, duplicate rows, mapping problems) are
  aggregations.

``validate`` returns every issue. ``listed`` is the display form: the first 5
rows per (dataset, code, column), planned as a WindowGroupLimit that cuts
map-side before the shuffle. Counts are taken over all issues.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.parsing import parse_date, to_number
from larder.operators.mapping import targets_df

# ---------------------------------------------------------------------------
# Fixed values (must equal the source application's rules).
NUMERIC_NON_NEGATIVE = ["units_sold", "selling_price", "base_price", "cost_price", "current_inventory",
                        "reserved_inventory", "incoming_inventory", "storage_capacity"]
DATE_FIELDS = ["transaction_date", "snapshot_date", "expiration_date"]
IDENTIFIER_FIELDS = ["product_id", "supplier_id", "warehouse_id", "store_id"]
# Reference fields checked per dataset type.
REFERENCE_FIELDS = {
    "products": ["supplier_id"],
    "sales": ["product_id", "supplier_id", "warehouse_id", "store_id"],
    "inventory": ["product_id", "warehouse_id"],
}
ISSUE_LIMIT_PER_RULE = 5
# ---------------------------------------------------------------------------

ISSUE_COLS = ["dataset_id", "severity", "code", "column", "row_number", "value"]


def _issue(cond, severity: str, code, column=None, value=None):
    return F.when(cond, F.struct(F.lit(severity).alias("severity"),
                                 (code if not isinstance(code, str) else F.lit(code)).alias("code"),
                                 (F.col("column") if column is None else column).alias("issue_column"),
                                 (F.col("value") if value is None else value).cast("string").alias("issue_value")))


def cell_issues(mapped: DataFrame) -> DataFrame:
    """All single-cell rules in one pass over the mapped cells.

    Cells of columns without a rule are left out first, and a cell is parsed once, not once a rule."""
    v = F.col("value")
    col = F.col("column")
    numeric_col = col.isin(NUMERIC_NON_NEGATIVE)
    mapped = (mapped.where(col.isin(*NUMERIC_NON_NEGATIVE, "discount_pct", *DATE_FIELDS, *IDENTIFIER_FIELDS))
              .withColumn("_num", F.when(numeric_col | (col == "discount_pct"), to_number(v))))
    num = F.col("_num")
    rules = F.array(
        _issue(numeric_col & v.isNotNull() & num.isNull(), "error", "INVALID_NUMERIC"),
        _issue(numeric_col & (num < 0), "error", "NEGATIVE_VALUE"),
        _issue((col == "discount_pct") & num.isNotNull() & ((num < 0) | (num > 1)), "error",
               "DISCOUNT_OUT_OF_RANGE"),
        _issue(col.isin(DATE_FIELDS) & v.isNotNull() & parse_date(v).isNull(), "error", "INVALID_DATE"),
        _issue(col.isin(IDENTIFIER_FIELDS) & (F.trim(F.coalesce(v, F.lit(""))) == ""), "error",
               "EMPTY_IDENTIFIER", value=F.lit(None)),
    )
    return mapped.select("dataset_id", "source_row_number", F.inline(rules)).where("code is not null")


def reference_issues(mapped: DataFrame, known: DataFrame) -> DataFrame:
    """UNKNOWN_<FIELD>: non-empty id not in ``known(column, value)``.

    The fixed reference fields are a condition on the cells: a join would move every cell of
    every upload by the few (type, column) pairs."""
    field = F.lit(False)
    for dataset_type, names in REFERENCE_FIELDS.items():
        field = field | ((F.col("dataset_type") == dataset_type) & F.col("column").isin(names))
    ids = (mapped.where(field)
           .withColumn("value", F.trim(F.col("value")))
           .where(F.coalesce(F.col("value"), F.lit("")) != ""))
    unknown = ids.join(known.select("column", "value"), ["column", "value"], "left_anti")
    return unknown.select("dataset_id", "source_row_number", F.lit("error").alias("severity"),
                          F.concat(F.lit("UNKNOWN_"), F.upper(F.col("column"))).alias("code"),
                          F.col("column").alias("issue_column"), F.col("value").alias("issue_value"))


def expiry_issues_wide(frame: DataFrame, dataset_id: str) -> DataFrame:
    """EXPIRATION_BEFORE_SNAPSHOT on a mapped wide frame: both dates parse and expiry < snapshot."""
    bad = frame.where(parse_date("expiration_date") < parse_date("snapshot_date"))
    return bad.select(F.lit(dataset_id).alias("dataset_id"), "source_row_number", F.lit("error").alias("severity"),
                      F.lit("EXPIRATION_BEFORE_SNAPSHOT").alias("code"), F.lit("expiration_date").alias("issue_column"),
                      F.lit(None).cast("string").alias("issue_value"))


def expiry_issues(mapped: DataFrame) -> DataFrame:
    """EXPIRATION_BEFORE_SNAPSHOT: both dates parse and expiry < snapshot."""
    two = mapped.where(F.col("column").isin("expiration_date", "snapshot_date"))
    per_row = two.groupBy("dataset_id", "source_row_number").agg(
        F.max(F.when(F.col("column") == "expiration_date", parse_date(F.col("value")))).alias("exp"),
        F.max(F.when(F.col("column") == "snapshot_date", parse_date(F.col("value")))).alias("snap"))
    bad = per_row.where(F.col("exp") < F.col("snap"))
    return bad.select("dataset_id", "source_row_number", F.lit("error").alias("severity"),
                      F.lit("EXPIRATION_BEFORE_SNAPSHOT").alias("code"),
                      F.lit("expiration_date").alias("issue_column"),
                      F.lit(None).cast("string").alias("issue_value"))


def listed(issues: DataFrame, k: int = ISSUE_LIMIT_PER_RULE) -> DataFrame:
    """Display form: the first k rows per (dataset, code, column) and every issue without a row."""
    w = Window.partitionBy("dataset_id", "code", "column").orderBy("row_number")
    top = issues.where("row_number is not null").withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
    return issues.where("row_number is null").unionByName(top.drop("_rk"))


def missing_value_issues(mapped: DataFrame) -> DataFrame:
    """MISSING_VALUES per column: error when the column is a required target."""
    spark = mapped.sparkSession
    req = targets_df(spark).where("is_required").select("dataset_type", F.col("target_field").alias("column"), "is_required")
    counts = (mapped.groupBy("dataset_id", "dataset_type", "column")
              .agg(F.count_if(F.col("value").isNull()).alias("n_missing"))
              .where(F.col("n_missing") > 0))
    j = counts.join(req, ["dataset_type", "column"], "left")
    return j.select("dataset_id",
                    F.when(F.col("is_required"), "error").otherwise("warning").alias("severity"),
                    F.lit("MISSING_VALUES").alias("code"), "column",
                    F.lit(None).cast("bigint").alias("row_number"),
                    F.col("n_missing").cast("string").alias("value"))


def duplicate_row_issues(mapped: DataFrame) -> DataFrame:
    """DUPLICATE_ROWS: count of rows equal to an earlier row of the mapped frame."""
    rows = mapped.groupBy("dataset_id", "source_row_number").agg(
        F.array_sort(F.collect_list(F.struct("column_position", "column", "value"))).alias("cells"))
    per_ds = rows.groupBy("dataset_id").agg(
        (F.count(F.lit(1)) - F.count_distinct("cells")).alias("n_dup"))
    return per_ds.where(F.col("n_dup") > 0).select(
        "dataset_id", F.lit("warning").alias("severity"), F.lit("DUPLICATE_ROWS").alias("code"),
        F.lit(None).cast("string").alias("column"), F.lit(None).cast("bigint").alias("row_number"),
        F.col("n_dup").cast("string").alias("value"))


def mapping_issues(mappings: DataFrame, missing: DataFrame) -> DataFrame:
    """MISSING_REQUIRED_MAPPING and DUPLICATE_TARGET_MAPPING."""
    miss = missing.select("dataset_id", F.lit("error").alias("severity"),
                          F.lit("MISSING_REQUIRED_MAPPING").alias("code"),
                          F.col("target_field").alias("column"),
                          F.lit(None).cast("bigint").alias("row_number"), F.lit(None).cast("string").alias("value"))
    dup = (mappings.where(F.col("is_confirmed") & F.col("target_field").isNotNull())
           .groupBy("dataset_id", "target_field").agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") > 1)
           .select("dataset_id", F.lit("error").alias("severity"), F.lit("DUPLICATE_TARGET_MAPPING").alias("code"),
                   F.col("target_field").alias("column"), F.lit(None).cast("bigint").alias("row_number"),
                   F.col("n").cast("string").alias("value")))
    return miss.unionByName(dup)


def duplicate_counts_from_wide(frames: list[tuple[str, DataFrame]], row_col: str = "source_row_number") -> DataFrame:
    """DUPLICATE_ROWS from the wide uploads: renaming columns cannot change which
    rows repeat, so count - count(distinct row) on each upload (one aggregation,
    no per-row reassembly of cells) gives the same count. A row stands there as a
    128-bit hash of its values and of which of them are null, so that tasks hold
    and move 16 bytes a row, however wide it is."""
    parts = []
    for ds, df in frames:
        cols = [c for c in df.columns if c != row_col]
        values = [F.col(f"`{c}`") for c in cols]
        gaps = F.concat(F.lit(""), *[F.when(v.isNull(), "1").otherwise("0") for v in values])
        row = (F.xxhash64(gaps, *values), F.xxhash64(F.lit(7), *reversed(values), gaps))
        parts.append(df.agg((F.count(F.lit(1)) - F.count_distinct(*row)).alias("n_dup"))
                     .withColumn("dataset_id", F.lit(ds)))
    per_ds = parts[0]
    for p in parts[1:]:
        per_ds = per_ds.unionByName(p)
    return per_ds.where(F.col("n_dup") > 0).select(
        "dataset_id", F.lit("warning").alias("severity"), F.lit("DUPLICATE_ROWS").alias("code"),
        F.lit(None).cast("string").alias("column"), F.lit(None).cast("bigint").alias("row_number"),
        F.col("n_dup").cast("string").alias("value"))


def validate(mapped: DataFrame, mappings: DataFrame, missing: DataFrame, known: DataFrame,
             duplicates: DataFrame | None = None, expiry: DataFrame | None = None) -> DataFrame:
    """All issues of all datasets as one DataFrame (``ISSUE_COLS``), uncut.

    ``duplicates`` and ``expiry`` may carry issues found on the wide frames
    (``duplicate_counts_from_wide``, ``expiry_issues_wide``); otherwise they are
    derived from the cells."""
    row_issues = cell_issues(mapped).unionByName(reference_issues(mapped, known)) \
                                    .unionByName(expiry if expiry is not None else expiry_issues(mapped)).select(
        "dataset_id", "severity", "code", F.col("issue_column").alias("column"),
        F.col("source_row_number").alias("row_number"), F.col("issue_value").alias("value"))
    dups = duplicates if duplicates is not None else duplicate_row_issues(mapped)
    return (mapping_issues(mappings, missing)
            .unionByName(dups)
            .unionByName(missing_value_issues(mapped))
            .unionByName(row_issues))


def issue_summary(issues: DataFrame, datasets: DataFrame) -> DataFrame:
    """v14: counts of all errors and warnings, how many issues the display lists,
    valid flag and next dataset status. Two partial aggregations."""
    per_rule = issues.groupBy("dataset_id", "severity", "code", "column", F.col("row_number").isNull().alias("_whole")).agg(
        F.count(F.lit(1)).alias("n"))
    shown = F.when(F.col("_whole"), F.col("n")).otherwise(F.least(F.col("n"), F.lit(ISSUE_LIMIT_PER_RULE)))
    counts = per_rule.groupBy("dataset_id").agg(
        F.sum(F.when(F.col("severity") == "error", F.col("n")).otherwise(0)).alias("error_count"),
        F.sum(F.when(F.col("severity") == "warning", F.col("n")).otherwise(0)).alias("warning_count"),
        F.sum(shown).alias("listed_count"))
    j = datasets.select("dataset_id").join(counts, "dataset_id", "left").fillna(
        0, ["error_count", "warning_count", "listed_count"])
    valid = F.col("error_count") == 0
    return j.select("dataset_id", F.col("error_count").cast("bigint").alias("error_count"),
                    F.col("warning_count").cast("bigint").alias("warning_count"),
                    F.col("listed_count").cast("bigint").alias("listed_count"),
                    valid.alias("valid"),
                    F.when(valid, "validated").otherwise("mapping_required").alias("status"))
