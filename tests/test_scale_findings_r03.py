"""Steps of this round's findings: what they move and what they write, with the same results as plain versions."""
import pyarrow as pa
from pyspark.sql import functions as F

from larder.operators import ingest as ig
from larder.operators import kendall
from larder.operators import validate as vd
from larder.sources import csv as cs
from larder.streaming import ingest as si


def _plan(df, phase="executedPlan"):
    return getattr(df._jdf.queryExecution(), phase)().toString()


def test_kendall_points_are_counted_without_a_row_a_pair(spark, monkeypatch):
    rows = [(None, 1.0, 2.0), (0.0, 1.0, 2.0), (0.0, 1.0, None), (0.0, 1.0, 2.0), (float("inf"), 3.0, 2.0), (None, None, None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows)], names=["v0", "v1", "v2"])
    want = {(0, 0.0, 1.0): 3, (0, float("inf"), 3.0): 1, (1, 0.0, 2.0): 2, (1, float("inf"), 2.0): 1, (2, 1.0, 2.0): 3, (2, 3.0, 2.0): 1}
    for most in (1, 4, 100):
        got = {}
        for out in kendall._points_of([(0, 1), (0, 2), (1, 2)], most)(iter([batch.slice(0, 3), batch.slice(3, 0), batch.slice(3)])):
            for pair, x, y, c in zip(*(col.to_pylist() for col in out.columns)):
                got[pair, x, y] = got.get((pair, x, y), 0) + c
        assert got == want
    plans, keep = [], kendall.stored
    monkeypatch.setattr(kendall, "stored", lambda df, name: plans.append((name, _plan(df))) or keep(df, name))
    df = spark.createDataFrame([(float(i % 7), float(i % 5), -0.0 if i % 2 else 0.0) for i in range(50)], "a double, b double, c double")
    assert kendall.corr_kendall(df, ["a", "b", "c"]).count() == 3
    plan = dict(plans)["kendall-points"]
    assert "Generate" not in plan and "MapInArrow" in plan


def test_reference_rule_moves_ids_only(spark):
    cells = spark.createDataFrame([("d", "sales", 2, "product_id", " 9 "), ("d", "sales", 3, "product_id", "1"), ("d", "sales", 4, "note", "9"),
                                   ("d", "sales", 5, "product_id", None), ("d", "products", 6, "product_id", "9"), ("d", None, 7, "product_id", "9"),
                                   ("d", "sales", 8, None, "9")], "dataset_id string, dataset_type string, source_row_number long, column string, value string")
    known = spark.createDataFrame([("product_id", "1")], "column string, value string")
    out = vd.reference_issues(cells, known)
    assert _plan(out, "optimizedPlan").count("Join") == 1  # the look-up of the ids
    assert [(r["source_row_number"], r["code"], r["issue_value"]) for r in out.collect()] == [(2, "UNKNOWN_PRODUCT_ID", "9")]


def test_cells_without_a_rule_are_not_parsed(spark):
    rows = [(2, "units_sold", "-1"), (3, "units_sold", "x"), (4, "note", "x"), (5, "discount_pct", "2"), (6, "discount_pct", "x"),
            (7, "transaction_date", "x"), (8, "store_id", " "), (9, "store_id", None), (10, None, "x"), (11, "units_sold", None)]
    df = spark.createDataFrame([("d", *r) for r in rows], "dataset_id string, source_row_number long, column string, value string")
    out = vd.cell_issues(df)
    assert _plan(out, "optimizedPlan").lower().count("rlike") <= 2  # one number and one date
    assert sorted((r["source_row_number"], r["code"]) for r in out.collect()) == [
        (2, "NEGATIVE_VALUE"), (3, "INVALID_NUMERIC"), (5, "DISCOUNT_OUT_OF_RANGE"), (7, "INVALID_DATE"), (8, "EMPTY_IDENTIFIER"), (9, "EMPTY_IDENTIFIER")]


def test_ingestion_parses_a_cell_once(spark):
    frame = spark.createDataFrame([(2, "1", "2024-01-02", "3", "x")], "source_row_number long, product_id string, transaction_date string, units_sold string, discount_pct string")
    products = spark.createDataFrame([(1,)], "product_id long")
    warehouses = spark.createDataFrame([(7, "W7")], "warehouse_id int, warehouse_code string")
    stores = spark.createDataFrame([(100,)], "store_id int")
    out = ig.ingest_sales(ig.conform(frame.withColumn("selling_price", F.lit("1")).withColumn("spoilage_risk", F.lit("0")), "d", "sales"), products, warehouses, stores, "7")
    assert out.first()["reject_reason"] == "discount_pct is not numeric."
    assert _plan(out, "optimizedPlan").lower().count("rlike") <= 5  # four numbers and a date


def test_rows_are_numbered_without_being_dealt_by_split(spark, tmp_path):
    cs.write_csv(spark.range(40).select(F.col("id").cast("string").alias("k")).repartition(3), str(tmp_path / "in"))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = cs.scan_csv(spark, str(tmp_path / "in"))
        plan = _plan(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    per_file = {}
    for r in out.collect():
        per_file.setdefault(r["source_file"], []).append(r["source_row_number"])
    assert sorted(n for v in per_file.values() for n in v) == sorted(n for v in per_file.values() for n in range(2, 2 + len(v)))


def test_stream_writes_few_files_a_landed_file_also_by_shuffled_look_ups(spark, tmp_path):
    header = ["product_id", "units_sold", "transaction_date"]
    rows = spark.range(300).select((F.col("id") % 90).cast("string").alias("product_id"), F.lit("2").alias("units_sold"), F.lit("2024-01-02").alias("transaction_date"))
    cs.write_csv(rows.repartition(3), str(tmp_path / "in"))
    mappings = [{"source_column": c, "target_field": c, "mapping_type": "exact", "is_confirmed": True, "default_value": None} for c in header]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        si.stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"), header, mappings, spark.range(100).withColumnRenamed("id", "product_id"),
                         spark.createDataFrame([(7, "W7")], "warehouse_id int, warehouse_code string"), spark.createDataFrame([(100,)], "store_id int"))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    files = list((tmp_path / "out" / "data").rglob("part-*.parquet"))
    assert len(files) == 3
    assert si.good(si.ingested(spark, str(tmp_path / "out"))).count() == 300
