"""Source, sink and streaming queries (round trips through the shared scratch folder)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larder.plans import training as tr
from larder.plans import uploads as up
from larder.plans.catalog import register
from larder.plans.oracle_views import UPLOAD_COLUMNS
from larder.session import scratch_path
from larder.sources import csv as cs
from larder.sources.tables import Tables
from larder.operators import ingest as ig
from larder.plans import linear_oracle as lo
from larder.plans.queries_models import loss_table, sweep
from larder.streaming.ingest import good, ingested, rejects
from larder.streaming.ingest import stream_ingest as run_stream

SALES_COLS = UPLOAD_COLUMNS["sales_upload"][1]


def land_sales_upload(t: Tables) -> str:
    """Write the whole sales upload as header CSV files into a fresh landing folder."""
    path = scratch_path(t.spark, f"landing/{uuid.uuid4().hex}")
    cs.write_csv(t.sales_upload().select(*[F.col(f"`{c}`") for c in SALES_COLS]), path)
    return path


@register("scan_csv", "select " + ", ".join(f'"{c}"' for c in SALES_COLS) + ", cast(null as varchar) as reject_reason from sales_upload")
def scan_csv(t: Tables):
    """Landed upload read back: all strings, NA tokens as null, original names; none of its records is broken."""
    df = cs.scan_csv(t.spark, land_sales_upload(t))
    return df.select(*[F.col(f"`{c}`") for c in SALES_COLS], "reject_reason")


@register("csv_surplus_fields", f"""
select source_row_number as k, sku, case when source_row_number % 53 = 0 then '{cs.SURPLUS_FIELDS}' end as reject_reason
from sales_upload where sku is null or trim(sku) <> ''""")
def csv_surplus_fields(t: Tables):
    """Lines with one field too many keep their row and carry a reason."""
    r = F.col("source_row_number")
    lines = t.sales_upload().where("sku is null or trim(sku) <> ''").select(F.concat(
        r.cast("string"), F.lit(","), F.coalesce("sku", F.lit("")), F.when(r % 53 == 0, F.lit(",surplus")).otherwise(F.lit(""))))
    path = scratch_path(t.spark, f"lines/{uuid.uuid4().hex}")
    lines.write.mode("overwrite").text(path)
    back = cs.read_checked_csv(t.spark, path, ["k", "sku"])
    return back.select(F.col("k").cast("bigint").alias("k"), "sku", "reject_reason")


@register("source_row_number", """
select row_number() over (partition by file_key order by source_row_number) + 1 as row_in_file, file_key, source_row_number as content
from (select source_row_number, source_row_number % 3 as file_key from sales_upload)""")
def source_row_number(t: Tables):
    """File-position numbers: rows land sorted in one folder per key, and every row's number
    must be its place in the file (folders are read as one file each)."""
    path = scratch_path(t.spark, f"landing/{uuid.uuid4().hex}")
    rows = t.sales_upload().select((F.col("source_row_number") % 3).alias("file_key"), F.col("source_row_number").alias("content"))
    (rows.repartition(3, "file_key").sortWithinPartitions("file_key", "content")
     .write.mode("overwrite").option("header", True).partitionBy("file_key").csv(path))
    df = cs.with_file_position(t.spark.read.option("header", True).csv(path).select("*", "_metadata"))
    return df.select(F.col("source_row_number").alias("row_in_file"), F.col("file_key").cast("bigint").alias("file_key"),
                     F.col("content").cast("bigint").alias("content"))


@register("landing_audit", f"""
select * from (values (null, true), ('{cs.NOT_CSV}', false)) v(reject_reason, accepted)""")
def landing_audit(t: Tables):
    """Accept / reject the files of a landing folder (CSV parts and a text file): the outcomes seen."""
    path = land_sales_upload(t)
    t.spark.createDataFrame([("not a csv",)], "v string").write.mode("overwrite").text(f"{path}/notes")
    return cs.landing_audit(t.spark, path).select("reject_reason", "accepted").distinct()


@register("write_csv", "select * from training_frame")
def write_csv(t: Tables):
    """Training frame written as header CSV and read back under its types."""
    path = scratch_path(t.spark, f"csv/{uuid.uuid4().hex}")
    frame = tr.training_frame(t)
    cs.write_csv(frame, path)
    return t.spark.read.schema(frame.schema).option("header", True).csv(path)


@register("write_split_files", "select split, count(*) as n from split_random group by split")
def write_split_files(t: Tables):
    """One folder per split written in one pass; row counts read back per split."""
    path = scratch_path(t.spark, f"splits/{uuid.uuid4().hex}")
    cs.write_split_files(tr.split_random(tr.training_frame(t)), path)
    back = t.spark.read.option("header", True).csv(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("save_experiments", lo.SWEEP + """
select experiment_id, model_name, feature_count, selected_features, training_samples, validation_samples, r2_score, mae, rmse, status, true as timed from results""")
def save_experiments(t: Tables):
    """The sweep's result table written as CSV and read back; its measured seconds are only checked to be there."""
    path = scratch_path(t.spark, f"experiments/{uuid.uuid4().hex}")
    results = sweep(t)
    cs.write_csv(results, path)
    back = t.spark.read.schema(results.schema).option("header", True).csv(path)
    return back.select("experiment_id", "model_name", "feature_count", "selected_features", "training_samples", "validation_samples",
                       "r2_score", "mae", "rmse", "status", (F.col("training_seconds") > 0).alias("timed"))


@register("save_experiment_loss", f"""
select 'ridge_all' as experiment_id, iteration + 1 as evaluation_number, loss as objective_value, true as timed from ({lo.DESCENT})""")
def save_experiment_loss(t: Tables):
    """The loss table (experiment, evaluation, objective, measured seconds) written and read back."""
    path = scratch_path(t.spark, f"experiments/{uuid.uuid4().hex}")
    loss = loss_table(t)
    cs.write_csv(loss, path)
    back = t.spark.read.schema(loss.schema).option("header", True).csv(path)
    return back.select("experiment_id", "evaluation_number", F.round("objective_value", 9).alias("objective_value"),
                       (F.col("elapsed_seconds") >= 0).alias("timed"))


_STREAM_COLS = ["product_id", "store_id", "store_created", "warehouse_id", "transaction_date", "units_sold", "selling_price",
                "discount_pct", "is_promoted", "spoilage_risk", "extras"]


def _stream(t: Tables, landing: str, target: str) -> None:
    run_stream(t.spark, landing, target, scratch_path(t.spark, f"stream-ckpt/{uuid.uuid4().hex}"), SALES_COLS,
               up.mapping_rows(t, "sales_upload"), t.products(), t.warehouses(), t.stores(),
               up.DATASET_WAREHOUSE.get("sales_upload"))


def _streamed(t: Tables):
    """The ingested table of a run over the landed sales upload, stored once."""
    def build():
        target = scratch_path(t.spark, f"stream-target/{uuid.uuid4().hex}")
        _stream(t, land_sales_upload(t), target)
        return ingested(t.spark, target)
    return t._stored("streamed_sales", build)


@register("stream_ingest", f"select {', '.join(_STREAM_COLS)} from sales_ingest where reject_reason is null")
def stream_ingest(t: Tables):
    """Landing folder -> file stream (available-now trigger) -> good sales rows: the same as the batch ingestion's."""
    return good(_streamed(t)).select(*_STREAM_COLS)


@register("stream_rejects", "select reject_reason, count(*) as n from sales_ingest where reject_reason is not null group by reject_reason")
def stream_rejects(t: Tables):
    """Rejected rows of the stream stay in its table, by reason."""
    return rejects(_streamed(t)).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@register("stream_new_stores", """
select store_id as external_store_id, min(warehouse_id) as warehouse_id, store_id as store_name, true as generated
from sales_ingest where store_created and reject_reason is null group by store_id""")
def stream_new_stores(t: Tables):
    """Stores that accepted stream rows name for the first time become store rows."""
    return ig.new_stores(good(_streamed(t)))


@register("stream_dedupe", """
select count(*) as rows_first_run, count(*) as rows_after_replay, count(*) as distinct_keys from sales_ingest""")
def stream_dedupe(t: Tables):
    """Exactly-once effect: the same files replayed under a fresh checkpoint
    rewrite their own partitions, so the table keeps one row per key."""
    landing = land_sales_upload(t)
    target = scratch_path(t.spark, f"stream-target/{uuid.uuid4().hex}")
    _stream(t, landing, target)
    first = ingested(t.spark, target).count()
    _stream(t, landing, target)  # replay everything
    df = ingested(t.spark, target)
    return df.agg(F.lit(first).cast("bigint").alias("rows_first_run"), F.count(F.lit(1)).alias("rows_after_replay"),
                  F.count_distinct("dataset_id", "source_row_number").alias("distinct_keys"))
