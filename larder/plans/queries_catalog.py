"""Catalogue, tenancy, upsert, lifecycle and readiness queries.

An organisation is a sales region (the region of the warehouse a record
belongs to); the dataset catalogue lists the two canonical datasets (already
ingested) and the three uploads with the status they reach after validation
and ingestion.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larder.operators import ingest as ig
from larder.operators import validate as vd
from larder.operators.asof import max_by_key
from larder.operators.keyed_store import KeyedTable, delete_everywhere
from larder.plans import forecast as fc
from larder.plans import queries_quality as qq
from larder.plans import uploads as up
from larder.plans.catalog import register
from larder.plans.oracle_views import view
from larder.session import scratch_path
from larder.sources.tables import Tables

ORG = "AMERICA"
MASTER_PARTS = 16     # parts of the stored product table
RANGE_ROWS = 100_000  # source rows a part
# Owner organisation of each dataset (catalogue metadata).
DATASET_ORG = {"sales": "AMERICA", "inventory": "AMERICA", "sales_upload": "AMERICA",
               "inventory_upload": "EUROPE", "products_upload": "AMERICA", "suppliers_upload": "AMERICA",
               "warehouse_upload": "EUROPE", "orders_upload": "AMERICA"}


def lifecycle(t: Tables):
    """uploaded -> validated | mapping_required -> ingested | failed (validated only); stored with the catalogue."""
    def build():
        summary = vd.issue_summary(up.issues(t), up.datasets(t))
        fails = ig.row_failures(qq.ingested_rows(t)).select("dataset_id", F.col("status").alias("ingest_status"))
        j = summary.join(fails, "dataset_id", "left")
        after = F.when(F.col("status") == "validated", F.col("ingest_status")).otherwise(F.col("status"))
        return j.select("dataset_id", F.lit("uploaded").alias("initial_status"),
                        F.col("status").alias("after_validation"), after.alias("after_ingestion"))
    return t._stored("dataset_lifecycle", build)


def catalogue(t: Tables):
    """dataset_id, dataset_type, status, row_count, organization_id; stored, one row per dataset."""
    def build():
        org = F.create_map(*[x for k, v in DATASET_ORG.items() for x in (F.lit(k), F.lit(v))])
        canon = [(ds, ds, df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("status", F.lit("ingested")))
                 for ds, df in (("sales", t.sales_records()), ("inventory", t.inventory_snapshots()))]
        status = lifecycle(t).select("dataset_id", F.col("after_ingestion").alias("status"))
        rows = up._union([df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(ds).alias("dataset_id"), F.lit(dt).alias("dataset_type"), "row_count")
                          for ds, dt, df in up.upload_frames(t)])
        cols = ["dataset_id", "dataset_type", "status", "row_count"]
        parts = [df.select(F.lit(ds).alias("dataset_id"), F.lit(dt).alias("dataset_type"), "status", "row_count") for ds, dt, df in canon]
        return up._union([*parts, rows.join(status, "dataset_id").select(*cols)]).withColumn("organization_id", org[F.col("dataset_id")])
    return t._stored("dataset_catalogue", build)


_ORG_SQL = "case dataset_id " + " ".join(f"when '{k}' then '{v}'" for k, v in DATASET_ORG.items()) + " end"

view("dataset_lifecycle", """
with s as (select d.dataset_id, count(*) filter (where i.severity = 'error') = 0 as valid
           from upload_datasets d left join validation_issues i on i.dataset_id = d.dataset_id group by d.dataset_id),
f as (select dataset_id, case when count(*) filter (where reject_reason is not null) = 0 then 'ingested' else 'failed' end
             as ingest_status
      from (select dataset_id, reject_reason from sales_ingest union all select dataset_id, reject_reason from inventory_ingest
            union all select dataset_id, reject_reason from products_ingest
            union all select dataset_id, reject_reason from suppliers_ingest
            union all select dataset_id, reject_reason from warehouses_ingest) x group by all)
select s.dataset_id, 'uploaded' as initial_status,
       case when valid then 'validated' else 'mapping_required' end as after_validation,
       case when valid then f.ingest_status else 'mapping_required' end as after_ingestion
from s left join f on f.dataset_id = s.dataset_id""",
     ["upload_datasets", "validation_issues", "sales_ingest", "inventory_ingest", "products_ingest", "suppliers_ingest",
      "warehouses_ingest"])

view("dataset_catalogue", f"""
select *, {_ORG_SQL} as organization_id from (
  select 'sales' as dataset_id, 'sales' as dataset_type, 'ingested' as status, count(*) as row_count from sales_records
  union all select 'inventory', 'inventory', 'ingested', count(*) from inventory_snapshots
  union all select c.dataset_id, c.dataset_type, l.after_ingestion, count(distinct c.source_row_number)
  from upload_cells c join dataset_lifecycle l on l.dataset_id = c.dataset_id group by all) x""",
     ["sales_records", "inventory_snapshots", "upload_cells", "dataset_lifecycle"])


@register("dataset_lifecycle", "select * from dataset_lifecycle")
def dataset_lifecycle(t: Tables):
    return lifecycle(t)


@register("ingested_types", """
select distinct dataset_type from dataset_catalogue where status = 'ingested'""")
def ingested_types(t: Tables):
    return catalogue(t).where(F.col("status") == "ingested").select("dataset_type").distinct()


@register("skip_ingested", """
select dataset_id, case when status = 'ingested' then 'skipped' else 'ingest' end as action,
       case when status = 'ingested' then row_count else 0 end as skipped_count from dataset_catalogue""")
def skip_ingested(t: Tables):
    c = catalogue(t)
    done = F.col("status") == "ingested"
    return c.select("dataset_id", F.when(done, "skipped").otherwise("ingest").alias("action"),
                    F.when(done, F.col("row_count")).otherwise(F.lit(0)).cast("bigint").alias("skipped_count"))


@register("readiness", f"""
with org as (select organization_id,
                    bool_or(dataset_type = 'products' and status = 'ingested') as products_ready,
                    bool_or(dataset_type = 'suppliers' and status = 'ingested') as suppliers_ready,
                    bool_or(dataset_type = 'sales' and status = 'ingested') as sales_ready,
                    bool_or(dataset_type = 'inventory' and status = 'ingested') as inventory_ready
             from dataset_catalogue group by all),
m as (select dataset_id, count(*) > 0 and bool_and(is_confirmed) as mappings_ready from column_mappings group by all),
w as (select distinct region as organization_id from warehouses),
x as (select d.dataset_id, w.organization_id is not null as warehouse_ready, o.products_ready, o.suppliers_ready,
             o.sales_ready, o.inventory_ready, coalesce(m.mappings_ready, false) as mappings_ready,
             d.status in ('validated', 'ready', 'ingesting', 'ingested') as validation_ready,
             d.status = 'ingested' as ingestion_ready, false as model_ready
      from dataset_catalogue d join org o on o.organization_id = d.organization_id
      left join m on m.dataset_id = d.dataset_id left join w on w.organization_id = d.organization_id)
select *, warehouse_ready and products_ready and suppliers_ready and sales_ready and inventory_ready and mappings_ready
          and validation_ready and ingestion_ready and model_ready as forecast_ready,
       list_filter(['The prediction model artifacts are still unavailable.',
                    case when not mappings_ready then 'Column mappings are not fully confirmed.' end,
                    case when not ingestion_ready then 'The selected dataset has not completed ingestion.' end],
                   lambda s: s is not null) as warnings
from x""")
def readiness(t: Tables):
    """Per dataset: prerequisite flags of its organisation, forecast_ready, warnings."""
    c = catalogue(t)
    org = c.groupBy("organization_id").agg(
        *[F.bool_or((F.col("dataset_type") == k) & (F.col("status") == "ingested")).alias(f"{k}_ready")
          for k in ("products", "suppliers", "sales", "inventory")])
    m = up.mappings(t).groupBy("dataset_id").agg(
        ((F.count(F.lit(1)) > 0) & F.bool_and("is_confirmed")).alias("mappings_ready"))
    w = t.warehouses().select(F.col("region").alias("organization_id")).distinct() \
                      .withColumn("warehouse_ready", F.lit(True))
    x = (c.join(org, "organization_id").join(m, "dataset_id", "left").join(w, "organization_id", "left")
         .select("dataset_id", F.coalesce("warehouse_ready", F.lit(False)).alias("warehouse_ready"),
                 "products_ready", "suppliers_ready", "sales_ready", "inventory_ready",
                 F.coalesce("mappings_ready", F.lit(False)).alias("mappings_ready"),
                 F.col("status").isin("validated", "ready", "ingesting", "ingested").alias("validation_ready"),
                 (F.col("status") == "ingested").alias("ingestion_ready"), F.lit(False).alias("model_ready")))
    flags = ["warehouse_ready", "products_ready", "suppliers_ready", "sales_ready", "inventory_ready",
             "mappings_ready", "validation_ready", "ingestion_ready", "model_ready"]
    ready = F.lit(True)
    for f in flags:
        ready = ready & F.col(f)
    warnings = F.array_compact(F.array(
        F.when(~F.col("model_ready"), F.lit("The prediction model artifacts are still unavailable.")),
        F.when(~F.col("mappings_ready"), F.lit("Column mappings are not fully confirmed.")),
        F.when(~F.col("ingestion_ready"), F.lit("The selected dataset has not completed ingestion."))))
    return x.withColumn("forecast_ready", ready).withColumn("warnings", warnings)


@register("org_scan", f"""
select s.* from sales_records s join warehouses w on w.warehouse_id = s.warehouse_id where w.region = '{ORG}'""")
def org_scan(t: Tables):
    """Tenant filter: sales of one organisation (region of the warehouse)."""
    w = t.warehouses().where(F.col("region") == ORG).select("warehouse_id")
    return t.sales_records().join(w, "warehouse_id", "left_semi")


@register("lookup_by_id", """
select r.request_id, r.product_id, r.warehouse_id, w.warehouse_code, w.region as organization_id
from forecast_requests r join warehouses w on w.warehouse_id = r.warehouse_id""")
def lookup_by_id(t: Tables):
    """(id, organisation) equality lookup of each request's warehouse (one row per id)."""
    w = t.warehouses().select("warehouse_id", "warehouse_code", F.col("region").alias("organization_id"))
    return t.forecast_requests().select("request_id", "product_id", "warehouse_id").join(w, "warehouse_id")


@register("get_many_products", """
select r.request_id, count(*) as n_requested, count(p.product_id) as n_found, count(*) = count(p.product_id) as all_found
from (select distinct request_id, product_id from forecast_requests) r
left join products p on p.product_id = r.product_id group by r.request_id""")
def get_many_products(t: Tables):
    """Requested product ids found among the catalogue's products; all must exist."""
    r = t.forecast_requests().select("request_id", "product_id").distinct()
    found = r.join(t.products().select("product_id"), "product_id", "left_semi").groupBy("request_id") \
             .agg(F.count(F.lit(1)).alias("n_found"))
    req = r.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_requested"))
    j = req.join(found, "request_id", "left").fillna(0, ["n_found"])
    return j.withColumn("all_found", F.col("n_requested") == F.col("n_found"))


@register("results_for_job", f"""
select p.request_id, p.product_id, p.warehouse_id, p.forecast_date, p.predicted_units_sold
from forecast_points p join warehouses w on w.warehouse_id = p.warehouse_id where w.region = '{ORG}'""")
def results_for_job(t: Tables):
    """Results of the jobs that belong to the organisation, ordered by date."""
    w = t.warehouses().where(F.col("region") == ORG).select("warehouse_id")
    mine = fc.score_context(fc.forecast_context(t)).join(w, "warehouse_id", "left_semi").select(
        *fc.SERIES, "forecast_start_date", "horizon_days", "predicted_units_sold")
    # Series are dealt by ranges of request and get their days there: sorting the parts orders the whole.
    dealt = mine.repartitionByRange(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "request_id")
    return fc.horizon_rows(dealt).select(*fc.SERIES, "forecast_date", "predicted_units_sold").sortWithinPartitions("request_id", "forecast_date")


@register("columns_visible_to_org", f"""
select c.dataset_id, c.source_column from column_profile c
where exists (select 1 from dataset_catalogue d where d.dataset_id = c.dataset_id and d.organization_id = '{ORG}')""")
def columns_visible_to_org(t: Tables):
    """Child rows (dataset columns) visible when the parent dataset is in the organisation."""
    d = catalogue(t).where(F.col("organization_id") == ORG).select("dataset_id")
    return up.column_profile(t).join(d, "dataset_id", "left_semi").select("dataset_id", "source_column")


@register("upsert_master", """
with new as (select external_product_id, product_name, category, supplier_id from products_ingest
             where reject_reason is null
             qualify row_number() over (partition by external_product_id order by source_row_number desc) = 1),
old as (select cast(product_id as varchar) as external_product_id, product_name, category, supplier_id from products)
select *, false as replaced from old where external_product_id not in (select external_product_id from new)
union all select *, true from new""")
def upsert_master(t: Tables):
    """Products: catalogue rows replaced by the last good upload row of the same external id."""
    new = qq._products_rows(t).where(F.col("reject_reason").isNull()).select(
        "external_product_id", "product_name", "category", "supplier_id", "source_row_number")
    old = t.products().select(F.col("product_id").cast("string").alias("external_product_id"), "product_name",
                              "category", "supplier_id", F.lit(0).cast("bigint").alias("source_row_number"))
    table = KeyedTable(t.spark, scratch_path(t.spark, f"keyed/products-{uuid.uuid4().hex}"))
    part = F.pmod(F.xxhash64("external_product_id"), F.lit(MASTER_PARTS))
    table.replace(old.drop("source_row_number").withColumn("replaced", F.lit(False)), part)
    table.merge(new, ["external_product_id"], "source_row_number", part, "replaced")
    return table.read()


@register("upsert_source_rows", """
with new as (select dataset_id, source_row_number, product_id, transaction_date, units_sold from sales_ingest
             where reject_reason is null),
old as (select 'sales_upload' as dataset_id, source_row_number, product_id, transaction_date, units_sold
        from sales_records)
select *, false as replaced from old o
where not exists (select 1 from new n where n.dataset_id = o.dataset_id and n.source_row_number = o.source_row_number)
union all select *, true from new""")
def upsert_source_rows(t: Tables):
    """Idempotent (dataset_id, source_row_number) upsert of ingested sales over a previous load."""
    new = qq._sales_rows(t).where(F.col("reject_reason").isNull()).select(
        "dataset_id", "source_row_number", "product_id", "transaction_date", "units_sold")
    old = t.sales_records().select(F.lit("sales_upload").alias("dataset_id"), "source_row_number", "product_id",
                                   "transaction_date", "units_sold")
    table = KeyedTable(t.spark, scratch_path(t.spark, f"keyed/sales-{uuid.uuid4().hex}"))
    part = F.concat_ws(":", "dataset_id", F.floor(F.col("source_row_number") / RANGE_ROWS))
    table.replace(old.withColumn("replaced", F.lit(False)), part)
    table.merge(new.withColumn("_order", F.col("source_row_number")), ["dataset_id", "source_row_number"], "_order", part, "replaced")
    return table.read()


# What a dataset owns beside its rows; each is stored with one part an organisation and dataset.
_CHILDREN_SQL = """children as (
  select 'source_rows' as child, dataset_id from sales_records union all select 'source_rows', dataset_id from inventory_snapshots
  union all select 'source_rows', dataset_id from (select distinct dataset_id, source_row_number from upload_cells)
  union all select 'columns', dataset_id from column_profile
  union all select 'mappings', dataset_id from column_mappings
  union all select 'issues', dataset_id from validation_issues
  union all select 'catalogue', dataset_id from dataset_catalogue)"""


def dataset_tables(t: Tables) -> dict[str, KeyedTable]:
    """Stored child tables of all datasets, the catalogue last; parts are named organisation/dataset."""
    org = F.create_map(*[x for k, v in DATASET_ORG.items() for x in (F.lit(k), F.lit(v))])
    part = F.concat_ws("/", org[F.col("dataset_id")], "dataset_id")
    rows = up._union([t.sales_records().select("dataset_id", "source_row_number"), t.inventory_snapshots().select("dataset_id", "source_row_number"),
                      *[df.select(F.lit(ds).alias("dataset_id"), "source_row_number") for ds, _, df in up.upload_frames(t)]])
    contents = {"source_rows": rows, "columns": up.column_profile(t).select("dataset_id", "source_column"),
                "mappings": up.mappings(t).select("dataset_id", "source_column", "target_field"),
                "issues": up.issues(t).select("dataset_id", "code", "row_number"), "catalogue": catalogue(t).select("dataset_id", "organization_id")}
    path, out = scratch_path(t.spark, f"keyed/datasets-{uuid.uuid4().hex}"), {}
    for name, df in contents.items():
        out[name] = KeyedTable(t.spark, f"{path}/{name}")
        out[name].replace(df, part)
    return out


@register("delete_dataset", """
select dataset_id, source_row_number from (
  select dataset_id, source_row_number from sales_records union all
  select dataset_id, source_row_number from inventory_snapshots) x
where dataset_id not in (select dataset_id from dataset_catalogue where dataset_id = 'inventory' and organization_id = 'AMERICA')""")
def delete_dataset(t: Tables):
    """Rows left after dataset 'inventory' of organisation AMERICA was deleted from the stored tables."""
    tables = dataset_tables(t)
    delete_everywhere(tables, [f"{ORG}/inventory"])
    return tables["source_rows"].read().where(F.col("dataset_id").isin("sales", "inventory"))


@register("delete_dataset_children", f"""with {_CHILDREN_SQL}
select child, dataset_id, count(*) as n from children where not (dataset_id = 'inventory_upload') group by child, dataset_id""")
def delete_dataset_children(t: Tables):
    """What every child table holds after EUROPE deleted 'inventory_upload' and AMERICA tried to: its rows, columns,
    mappings, issues and catalogue entry are gone, those of other datasets are whole."""
    tables = dataset_tables(t)
    delete_everywhere(tables, [f"{ORG}/inventory_upload"])  # not this organisation's: nothing happens
    delete_everywhere(tables, ["EUROPE/inventory_upload"])
    left = [table.read().select(F.lit(name).alias("child"), "dataset_id") for name, table in tables.items()]
    return up._union(left).groupBy("child", "dataset_id").agg(F.count(F.lit(1)).alias("n"))


@register("product_search", """
select product_id, product_name, category from products
where contains(lower(concat_ws(' ', product_name, category)), lower('Small G'))""")
def product_search(t: Tables):
    q = "Small G"
    p = t.products()
    return p.where(F.lower(F.concat_ws(" ", "product_name", "category")).contains(q.lower())) \
            .select("product_id", "product_name", "category")


@register("active_model", """
with last as (select region, max(transaction_date) as last_day from training_frame group by region),
reg as (select region as organization_id, k as version, cast(last_day + k as date) as created_at, k % 4 = 0 as is_active
        from (select region, last_day, unnest([4, 6, 8, 10, 12, 14]) as k from last) x)
select organization_id, last(version order by created_at) as version, max(created_at) as created_at
from reg where is_active group by organization_id""")
def active_model(t: Tables):
    """Newest active model per organisation from the model registry."""
    reg = model_registry(t)
    best = max_by_key(reg.where("is_active").select("organization_id", "version", "created_at"),
                      ["organization_id"], ["created_at"], "m")
    return best.select("organization_id", F.col("m.version").alias("version"), F.col("m.created_at").alias("created_at"))


def model_registry(t: Tables):
    """One registered model per (organisation, feature count); active when k % 4 == 0."""
    from larder.plans import training as tr
    f = tr.training_frame(t).select("region", "transaction_date")
    ks = F.array(*[F.lit(k) for k in (4, 6, 8, 10, 12, 14)])
    last = f.groupBy("region").agg(F.max("transaction_date").alias("last_day"))
    x = last.select("region", "last_day", F.explode(ks).alias("k"))
    return x.select(F.col("region").alias("organization_id"), F.col("k").alias("version"), F.lit("ridge").alias("name"),
                    F.col("k").alias("feature_count"), F.date_add("last_day", F.col("k")).alias("created_at"),
                    (F.col("k") % 4 == 0).alias("is_active"))
