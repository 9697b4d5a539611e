"""Wide mapping, number parsing, constraint rejects, jobs and prefix sums: literal cases."""
import pytest
from pyspark.sql import functions as F

from larder.functions.parsing import to_number
from larder.operators import ingest as ig
from larder.operators import mapping as mp
from larder.operators.prefix import running_total
from larder.plans.training import split_chronological


def mapping(source, target, kind="manual", confirmed=True, default=None):
    return {"source_column": source, "target_field": target, "mapping_type": kind, "is_confirmed": confirmed, "default_value": default}


def test_numbers_are_whole_texts(spark):
    values = ["12", " 1.5 ", "-.5", "3.", "1e3", "12d", "5f", "0x1p3", "Infinity", "NaN", "", None, "1,5"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(to_number("v")).collect()] == [12.0, 1.5, -0.5, 3.0, 1000.0] + [None] * 8


def test_map_columns_renames_defaults_and_refuses_duplicates(spark):
    df = spark.createDataFrame([(2, "a", "b", "c")], "source_row_number long, sku string, note string, day string")
    out = mp.map_columns(df, [mapping("sku", "product_id"), mapping("note", None, "ignored"), mapping("day", "transaction_date", confirmed=False),
                              mapping("(default) units_sold", "units_sold", "default", default="7")])
    assert out.columns == ["source_row_number", "product_id", "note", "day", "units_sold"] and out.first()["units_sold"] == "7"
    with pytest.raises(mp.MappingError):
        mp.map_columns(df, [mapping("sku", "product_id"), mapping("note", "product_id")])


def _tables(spark):
    products = spark.createDataFrame([(1,), (2,)], "product_id long")
    warehouses = spark.createDataFrame([(7, "W7"), (8, "W8")], "warehouse_id int, warehouse_code string")
    stores = spark.createDataFrame([(100,)], "store_id int")
    return products, warehouses, stores


def test_sales_rejects_and_default_warehouse(spark):
    rows = [(2, "1", "W8", "2024-01-02", "3", "0.1"), (3, "1", None, "2024-01-02", "3", "0.1"), (4, "1", "W8", "2024-01-02", "-3", "0.1"),
            (5, "1", "W8", "2024-01-02", None, "0.1"), (6, "1", "W8", "2024-01-02", "3", "1.5"), (7, "1", "W8", "2024-01-02", "12d", "0.1"),
            (8, "9", "W8", "2024-01-02", "3", "0.1"), (9, "1", "X", "2024-01-02", "3", "0.1"), (10, " ", "W8", "2024-01-02", "3", "0.1")]
    frame = spark.createDataFrame(rows, "source_row_number long, product_id string, warehouse_id string, transaction_date string, "
                                        "units_sold string, discount_pct string").withColumn("note", F.lit("n"))
    products, warehouses, stores = _tables(spark)
    got = {r["source_row_number"]: r for r in ig.ingest_sales(ig.conform(frame, "d", "sales"), products, warehouses, stores, "7").collect()}
    assert got[2]["reject_reason"] is None and got[2]["extras"] == '{"note":"n"}' and got[3]["warehouse_id"] == 7
    assert {k: r["reject_reason"] for k, r in got.items() if k > 3} == {
        4: "units_sold must not be negative.", 5: "units_sold is required.", 6: ig.BAD_DISCOUNT, 7: "units_sold is not numeric.",
        8: "Unknown product_id.", 9: "Unknown warehouse_id.", 10: "product_id is required."}
    bad = ig.ingest_sales(ig.conform(frame, "d", "sales"), products, warehouses, stores, "99").where("source_row_number = 3").first()
    assert bad["reject_reason"] == ig.NO_DEFAULT_WAREHOUSE


def test_inventory_and_warehouse_rules(spark):
    products, warehouses, _ = _tables(spark)
    frame = spark.createDataFrame([(2, "1", "W7", "2024-01-05", "5", "2024-01-04"), (3, "1", " ", "2024-01-05", "5", None),
                                   (4, "1", "W7", "2024-01-05", "5", "2024-02-01")],
                                  "source_row_number long, product_id string, warehouse_id string, snapshot_date string, "
                                  "current_inventory string, expiration_date string")
    got = [r["reject_reason"] for r in ig.ingest_inventory(ig.conform(frame, "d", "inventory"), products, warehouses).orderBy("source_row_number").collect()]
    assert got == [ig.BAD_EXPIRY, "warehouse_id is required.", None]
    wh = spark.createDataFrame([(2, "C", "N", "chilled", "10", None), (3, "C", "N", "hot", "10", "Europe/Paris"), (4, "C", "N", "mixed", "-1", None)],
                               "source_row_number long, warehouse_code string, warehouse_name string, warehouse_type string, "
                               "storage_capacity string, timezone string")
    got = ig.ingest_warehouses(ig.conform(wh, "d", "warehouse")).orderBy("source_row_number").collect()
    assert [r["reject_reason"] for r in got] == [None, ig.BAD_TYPE, "storage_capacity must not be negative."]
    assert [r["timezone"] for r in got] == ["UTC", "Europe/Paris", "UTC"]


def test_running_total_of_a_large_group(spark):
    df = spark.range(0, 3000).select(F.when(F.col("id") % 10 < 9, "a").otherwise("b").alias("k"), F.col("id").alias("v"), F.lit(2).alias("c"))
    got = running_total(df, ["k"], "v", "c", "t").collect()
    for k in "ab":
        rows = sorted((r["v"], r["t"]) for r in got if r["k"] == k)
        assert [t for _, t in rows] == [2 * (i + 1) for i in range(len(rows))]


def test_chronological_split_ranks_only_inside_boundary_dates(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("row_id"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 4).cast("int")).alias("transaction_date"))
    got = split_chronological(df).collect()
    order = sorted(got, key=lambda r: (r["transaction_date"], r["row_id"]))
    assert [r["split"] for r in order] == ["train"] * 700 + ["validation"] * 150 + ["test"] * 150
