"""Literal reference cases: mapping suggestions, missing targets, validation codes."""

from pyspark.sql import functions as F

from larder.operators import mapping as mp
from larder.operators import profile as pf
from larder.operators import validate as vd


def test_alias_and_ignored_suggestions(spark):
    cols = spark.createDataFrame([("d", "sales", c) for c in ["qty_sold", "Sale Date", "receipt_note"]],
                                 "dataset_id string, dataset_type string, source_column string")
    got = {r["source_column"]: (r["suggested_target"], r["mapping_type"], r["confidence"])
           for r in mp.mapping_suggest(cols).collect()}
    assert got == {"qty_sold": ("units_sold", "alias", 0.9), "Sale Date": ("transaction_date", "alias", 0.9),
                   "receipt_note": (None, "ignored", 0.0)}


def test_missing_required_for_partial_mapping(spark):
    maps = spark.createDataFrame([("d", "sales", "Sale Date", "transaction_date", "alias", True, 1.0)],
                                 "dataset_id string, dataset_type string, source_column string, target_field string, "
                                 "mapping_type string, is_confirmed boolean, confidence double")
    ds = spark.createDataFrame([("d", "sales")], "dataset_id string, dataset_type string")
    got = sorted(r["target_field"] for r in mp.missing_required(maps, ds).collect())
    assert got == ["product_id", "units_sold"]


def test_bad_sales_issue_codes(spark):
    raw = spark.createDataFrame([(2, "invalid", "", "-1", "1.2"), (3, "2026-01-02", "SKU-1", "4", "0.1")],
                                "source_row_number long, date string, sku string, qty string, discount string")
    cells = pf.to_cells(raw, "d", "sales")
    maps = spark.createDataFrame(
        [("d", "sales", s, t, "manual", True, 1.0) for s, t in
         [("date", "transaction_date"), ("sku", "product_id"), ("qty", "units_sold"), ("discount", "discount_pct")]],
        "dataset_id string, dataset_type string, source_column string, target_field string, mapping_type string, "
        "is_confirmed boolean, confidence double")
    mapped = mp.apply_mapping(cells, maps)
    known = spark.createDataFrame([("product_id", "SKU-1")], "column string, value string")
    missing = mp.missing_required(maps, spark.createDataFrame([("d", "sales")], "dataset_id string, dataset_type string"))
    issues = vd.validate(mapped, maps, missing, known)
    codes = {r["code"] for r in issues.collect()}
    assert {"INVALID_DATE", "EMPTY_IDENTIFIER", "NEGATIVE_VALUE", "DISCOUNT_OUT_OF_RANGE"} <= codes
    summary = vd.issue_summary(issues, spark.createDataFrame([("d",)], "dataset_id string")).first()
    assert summary["valid"] is False


def test_detect_type_small_csv(spark):
    raw = spark.createDataFrame([
        (2, "2026-01-01", "10", "true", "Dairy", "first"),
        (3, "2026-01-02", "12", "false", "Dairy", "second"),
        (4, "2026-01-03", "14", "true", "Produce", "third")],
        "source_row_number long, `Sale Date` string, `Units Sold` string, Promotion string, Category string, Notes string")
    prof = pf.column_profile(pf.to_cells(raw, "d", "custom"))
    got = {r["source_column"]: r["detected_type"] for r in prof.collect()}
    assert got["Sale Date"] == "date" and got["Units Sold"] == "numeric" and got["Promotion"] == "boolean"
    tp = pf.table_profile(raw, "d", "custom", prof).first()
    assert tp["row_count"] == 3 and tp["column_count"] == 5 and str(tp["date_min"]) == "2026-01-01"
