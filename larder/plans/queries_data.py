"""Upload profiling, mapping and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import names as nm
from larder.functions import parsing as ps
from larder.operators import profile as pf
from larder.plans import uploads as up
from larder.plans.catalog import register
from larder.plans.oracle_views import _normalize_sql, _parse_date_sql, _q
from larder.sources.tables import Tables


@register("column_profile", "select * exclude (date_min, date_max) from column_profile")
def column_profile(t: Tables):
    return up.column_profile(t).drop("date_min", "date_max")


@register("detect_type", "select dataset_id, source_column, detected_type from column_profile")
def detect_type(t: Tables):
    return up.column_profile(t).select("dataset_id", "source_column", "detected_type")


@register("table_profile", """
select d.dataset_id, d.dataset_type, r.row_count, r.column_count, r.duplicate_row_count, f.date_min, f.date_max
from upload_datasets d
join (select dataset_id, count(*) as row_count, max(ncol) as column_count,
             count(*) - count(distinct cells) as duplicate_row_count
      from (select dataset_id, source_row_number, count(*) as ncol, list(value order by column_position) as cells
            from upload_cells group by all) x group by all) r on r.dataset_id = d.dataset_id
left join (select dataset_id, first(date_min order by column_position) as date_min,
                  first(date_max order by column_position) as date_max
           from column_profile where detected_type = 'date' group by all) f on f.dataset_id = d.dataset_id""")
def table_profile(t: Tables):
    prof = up.column_profile(t)
    parts = [pf.table_profile(df, ds, dt, prof) for ds, dt, df in up.upload_frames(t)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("mapping_suggest", "select * from mapping_suggestions")
def mapping_suggest(t: Tables):
    return up.suggestions(t)


@register("confirmed_mappings", """
select dataset_id, source_column, target_field, confidence from column_mappings where is_confirmed""")
def confirmed_mappings(t: Tables):
    return up.mappings(t).where("is_confirmed").select("dataset_id", "source_column", "target_field", "confidence")


@register("replace_mappings", "select * from column_mappings")
def replace_mappings(t: Tables):
    """Stored mappings replaced dataset by dataset: an older set (with a stale column) is landed
    first, then each dataset's partition is overwritten as a whole; other partitions stay."""
    import uuid
    from larder.session import scratch_path
    path = scratch_path(t.spark, f"mappings/{uuid.uuid4().hex}")
    fresh = up.mappings(t)
    stale = fresh.limit(0).unionByName(t.spark.createDataFrame(
        [(ds, dt, "old_column", None, "ignored", False, 0.0, None) for ds, dt, _ in up.UPLOADS], fresh.schema))

    def replace(rows):
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path))

    replace(stale)
    replace(fresh)
    return t.spark.read.schema(fresh.schema).parquet(path).select(*fresh.columns)


@register("missing_required", "select dataset_id, target_field from missing_required")
def missing_required(t: Tables):
    return up.missing_required(t).select("dataset_id", "target_field")


@register("apply_mapping", """
select dataset_id, source_row_number, "column", value from mapped_cells""")
def apply_mapping(t: Tables):
    return up.mapped_cells(t).select("dataset_id", "source_row_number", "column", "value")


# --- scalar functions over data values ---------------------------------------

@register("normalize_name", f"""
select p_partkey, {_normalize_sql("p_name || ' / ' || p_type")} as normalized from part""")
def normalize_name(t: Tables):
    p = t.raw("part")
    return p.select("p_partkey", nm.normalize_name(F.concat_ws(" / ", "p_name", "p_type")).alias("normalized"))


@register("feature_token", """
select c_custkey, lower(regexp_replace(regexp_replace(c_mktsegment || '-' || c_name, '[^a-zA-Z0-9]+', '_', 'g'),
       '^_+|_+$', '', 'g')) as token from customer""")
def feature_token(t: Tables):
    c = t.raw("customer")
    return c.select("c_custkey", nm.feature_token(F.concat_ws("-", "c_mktsegment", "c_name")).alias("token"))


@register("category_token", """
select p_partkey, case when trim(p_name) = '' then 'EMPTY' else
       regexp_replace(regexp_replace(regexp_replace(trim(p_name), '[^\\p{L}\\p{N}]+', '_', 'g'), '_+', '_', 'g'),
                      '^_+|_+$', '', 'g') end as token from part""")
def category_token(t: Tables):
    return t.raw("part").select("p_partkey", nm.category_token("p_name").alias("token"))


@register("safe_object_path", """
select p_partkey, 'org-' || cast(p_size as varchar) || '/' || p_brand || '/' || substr(sha256(p_name), 1, 32) || '_' ||
       case when substr(regexp_replace(regexp_replace(p_name || ' (' || p_type || ')', '[^a-zA-Z0-9._-]+', '_', 'g'),
                                       '^[._]+|[._]+$', '', 'g'), 1, 120) = '' then 'dataset'
            else substr(regexp_replace(regexp_replace(p_name || ' (' || p_type || ')', '[^a-zA-Z0-9._-]+', '_', 'g'),
                                       '^[._]+|[._]+$', '', 'g'), 1, 120) end || '.csv' as object_path
from part""")
def safe_object_path(t: Tables):
    """org/dataset/<id>_<sanitised stem>.csv for a file named after each part."""
    p = t.raw("part")
    stem = nm.safe_stem(F.concat(F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")")))
    file_id = F.substring(F.sha2(F.col("p_name"), 256), 1, 32)
    return p.select("p_partkey", F.concat(F.lit("org-"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_brand"),
                                          F.lit("/"), file_id, F.lit("_"), stem, F.lit(".csv")).alias("object_path"))


@register("parse_date", f"""
select dataset_id, source_row_number, value, {_parse_date_sql('value')} as parsed_date
from mapped_cells where "column" in ('transaction_date', 'snapshot_date', 'expiration_date')""")
def parse_date(t: Tables):
    m = up.mapped_cells(t).where(F.col("column").isin("transaction_date", "snapshot_date", "expiration_date"))
    return m.select("dataset_id", "source_row_number", "value", ps.parse_date("value").alias("parsed_date"))


@register("parse_boolean", """
select dataset_id, source_row_number, value,
       case when lower(trim(value)) in ('true', '1', 'yes', 'y') then true
            when lower(trim(value)) in ('false', '0', 'no', 'n') then false end as parsed,
       case when value is not null and not lower(trim(value)) in ('true', '1', 'yes', 'y', 'false', '0', 'no', 'n')
            then 'is_promoted: Boolean value is invalid.' end as reject_reason
from mapped_cells where "column" = 'is_promoted'""")
def parse_boolean(t: Tables):
    m = up.mapped_cells(t).where(F.col("column") == "is_promoted")
    return m.select("dataset_id", "source_row_number", "value", ps.parse_boolean("value").alias("parsed"),
                    ps.boolean_reject("value", "is_promoted").alias("reject_reason"))


@register("required_text", """
select dataset_id, source_row_number, case when length(trim(value)) > 0 then trim(value) end as text_value,
       case when value is null or length(trim(value)) = 0 then "column" || ' is required.' end as reject_reason
from mapped_cells where "column" in ('product_name', 'product_id')""")
def required_text(t: Tables):
    m = up.mapped_cells(t).where(F.col("column").isin("product_name", "product_id"))
    txt = ps.required_text("value")
    return m.select("dataset_id", "source_row_number", txt.alias("text_value"),
                    F.when(txt.isNull(), F.concat(F.col("column"), F.lit(" is required."))).alias("reject_reason"))


@register("parse_array", """
select user_id, dt, hours_stock_status_text,
       list_transform(list_filter(string_split_regex(trim(regexp_replace(hours_stock_status_text, '[\\[\\]]', '', 'g')),
                                                     '[,\\s]+'), lambda p: p <> ''), lambda p: try_cast(p as double)) as parsed
from (select user_id, dt, '[' || array_to_string(hours_stock_status, ' ') || ']' as hours_stock_status_text
      from hourly_arrays)""")
def parse_array(t: Tables):
    h = t.hourly_arrays()
    text = F.concat(F.lit("["), F.array_join(F.col("hours_stock_status").cast("array<string>"), " "), F.lit("]"))
    return h.select("user_id", "dt", text.alias("hours_stock_status_text")).withColumn(
        "parsed", ps.parse_array("hours_stock_status_text"))


@register("json_safe", """
select o_orderkey, strftime(cast(o_orderdate as date), '%Y-%m-%d') as order_date,
       case when o_orderstatus = 'F' then null else o_totalprice end as total_price
from orders""")
def json_safe(t: Tables):
    """NaN -> null and dates -> ISO text before JSON export (finished orders carry NaN)."""
    o = t.raw("orders")
    raw = F.when(F.col("o_orderstatus") == "F", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return o.select("o_orderkey", ps.iso_date(F.col("o_orderdate").cast("date")).alias("order_date"),
                    ps.json_safe_double(raw).alias("total_price"))


PREVIEW_ROWS = 20


@register("preview", f"""
select m.dataset_id, m.source_row_number, m."column", m.value from mapped_cells m
join (select dataset_id, source_row_number from (select distinct dataset_id, source_row_number from upload_cells)
      qualify row_number() over (partition by dataset_id order by source_row_number) <= {PREVIEW_ROWS}) f
  on f.dataset_id = m.dataset_id and f.source_row_number = m.source_row_number""")
def preview(t: Tables):
    """First rows of each upload in file order (the limit is the feature), cut on the wide frame."""
    from larder.operators import mapping as mp
    parts = []
    for ds, dt, df in up.upload_frames(t):
        names, defaults = mp.column_names([c for c in df.columns if c != "source_row_number"], up.mapping_rows(t, ds))
        parts.append(pf.to_cells(df.orderBy("source_row_number").limit(PREVIEW_ROWS), ds, dt, names=names, defaults=defaults))
    return up._union(parts).select("dataset_id", "source_row_number", "column", "value")


@register("extras_json", """
select dataset_id, source_row_number,
       to_json(map_from_entries(list({'k': "column", 'v': value} order by column_position))) as extras
from mapped_cells where not "column" in (select target_field from mapping_targets) and dataset_id <> 'orders_upload'
group by dataset_id, source_row_number""")
def extras_json(t: Tables):
    """Non-canonical columns of each row packed into one JSON object (a select on the wide frame);
    orders_upload has contradicting mappings and is refused before this step."""
    from larder.operators import ingest as ig
    return up._union([ig.conform(up.mapped_frame(t, ds), ds, dt).select("dataset_id", "source_row_number", "extras")
                      for ds, dt, _ in up.UPLOADS if ds != "orders_upload"])
