"""Validation-rule, ingestion and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import ingest as ig
from larder.operators import validate as vd
from larder.plans import uploads as up
from larder.plans.catalog import register
from larder.operators.mapping import fields_of
from larder.plans.oracle_views import _num_sql, _parse_date_sql, _q, view
from larder.sources.tables import Tables

_ISSUES = "select * from validation_issues"


def _rule(name: str, code_sql: str, code_filter):
    """``code_filter`` is a function returning the Column (built lazily: importing
    this module must not need a running Spark session)."""
    @register(name, f"{_ISSUES} where {code_sql}")
    def q(t: Tables):
        return up.issues(t).where(code_filter())
    q.__name__ = name
    return q


_rule("v01_missing_required_mapping", "code = 'MISSING_REQUIRED_MAPPING'", lambda: F.col("code") == "MISSING_REQUIRED_MAPPING")
_rule("v02_duplicate_target", "code = 'DUPLICATE_TARGET_MAPPING'", lambda: F.col("code") == "DUPLICATE_TARGET_MAPPING")
_rule("v03_duplicate_rows", "code = 'DUPLICATE_ROWS'", lambda: F.col("code") == "DUPLICATE_ROWS")
_rule("v04_missing_values", "code = 'MISSING_VALUES'", lambda: F.col("code") == "MISSING_VALUES")
_rule("v05_invalid_numeric", "code = 'INVALID_NUMERIC'", lambda: F.col("code") == "INVALID_NUMERIC")
_rule("v06_negative_value", "code = 'NEGATIVE_VALUE'", lambda: F.col("code") == "NEGATIVE_VALUE")
_rule("v07_discount_range", "code = 'DISCOUNT_OUT_OF_RANGE'", lambda: F.col("code") == "DISCOUNT_OUT_OF_RANGE")
_rule("v08_invalid_date", "code = 'INVALID_DATE'", lambda: F.col("code") == "INVALID_DATE")
_rule("v09_expiry_before_snapshot", "code = 'EXPIRATION_BEFORE_SNAPSHOT'",
      lambda: F.col("code") == "EXPIRATION_BEFORE_SNAPSHOT")
_rule("v10_empty_identifier", "code = 'EMPTY_IDENTIFIER'", lambda: F.col("code") == "EMPTY_IDENTIFIER")
_rule("v11_unknown_reference", "code like 'UNKNOWN\\_%' escape '\\'", lambda: F.col("code").startswith("UNKNOWN_"))
_rule("unknown_reference", "code like 'UNKNOWN\\_%' escape '\\'", lambda: F.col("code").startswith("UNKNOWN_"))


@register("rule_first_5", "select * from listed_issues where row_number is not null")
def rule_first_5(t: Tables):
    """The display form of the row rules: first 5 rows per (dataset, code, column)."""
    return vd.listed(up.issues(t)).where("row_number is not null")


@register("v14_issue_summary", """
select d.dataset_id, cast(count(*) filter (where i.severity = 'error') as bigint) as error_count,
       cast(count(*) filter (where i.severity = 'warning') as bigint) as warning_count,
       (select count(*) from listed_issues l where l.dataset_id = d.dataset_id) as listed_count,
       count(*) filter (where i.severity = 'error') = 0 as valid,
       case when count(*) filter (where i.severity = 'error') = 0 then 'validated' else 'mapping_required' end as status
from upload_datasets d left join validation_issues i on i.dataset_id = d.dataset_id
group by d.dataset_id""")
def v14_issue_summary(t: Tables):
    return vd.issue_summary(up.issues(t), up.datasets(t))


# ---------------------------------------------------------------------------
# Post-outcome columns that must never be model inputs.
LEAKAGE_COLUMNS = ["units_sold", "revenue", "profit", "profit_margin_pct", "units_wasted", "waste_pct",
                   "waste_cost", "was_spoiled", "daily_demand", "future_demand", "future_sales"]
# ---------------------------------------------------------------------------


@register("v15_leakage_review", f"""
select dataset_id, source_column, m.target_field,
       replace(lower(trim(coalesce(m.target_field, source_column))), ' ', '_') as normalized
from column_mappings m
where replace(lower(trim(coalesce(m.target_field, source_column))), ' ', '_') in ({", ".join(_q(c) for c in LEAKAGE_COLUMNS)})
   or (contains(replace(lower(trim(coalesce(m.target_field, source_column))), ' ', '_'), 'future')
       and (contains(replace(lower(trim(coalesce(m.target_field, source_column))), ' ', '_'), 'demand')
            or contains(replace(lower(trim(coalesce(m.target_field, source_column))), ' ', '_'), 'sales')))""")
def v15_leakage_review(t: Tables):
    """Post-outcome columns present in each dataset (by mapped name)."""
    m = up.mappings(t)
    norm = F.replace(F.lower(F.trim(F.coalesce("target_field", "source_column"))), F.lit(" "), F.lit("_"))
    risky = norm.isin(LEAKAGE_COLUMNS) | (norm.contains("future") & (norm.contains("demand") | norm.contains("sales")))
    return m.where(risky).select("dataset_id", "source_column", "target_field", norm.alias("normalized"))


# Rules of the canonical and catalogue tables: (table, rule, SQL condition of a
# violation), the same text in Spark and DuckDB; "unique:" rules name key columns.
TABLE_RULES = [
    ("sales_records", "units_sold_non_negative", "units_sold < 0"),
    ("sales_records", "selling_price_non_negative", "selling_price < 0"),
    ("sales_records", "discount_between_0_1", "discount_pct < 0 or discount_pct > 1"),
    ("sales_records", "spoilage_risk_non_negative", "spoilage_risk < 0"),
    ("sales_records", "date_and_product_present", "transaction_date is null or product_id is null"),
    ("sales_records", "row_number_from_2", "source_row_number < 2"),
    ("sales_records", "unique_dataset_row", "unique: dataset_id, source_row_number"),
    ("inventory_snapshots", "inventory_non_negative", "current_inventory < 0 or reserved_inventory < 0 or incoming_inventory < 0"),
    ("inventory_snapshots", "spoilage_risk_non_negative", "spoilage_risk < 0"),
    ("inventory_snapshots", "row_number_from_2", "source_row_number < 2"),
    ("inventory_snapshots", "unique_dataset_row", "unique: dataset_id, source_row_number"),
    ("products", "non_blank_name", "trim(coalesce(product_name, '')) = ''"),
    ("products", "prices_non_negative", "base_price < 0 or cost_price < 0"),
    ("products", "shelf_life_non_negative", "shelf_life_days < 0 or spoilage_sensitivity < 0"),
    ("products", "unique_product", "unique: product_id"),
    ("suppliers", "non_blank_name", "trim(coalesce(supplier_name, '')) = ''"),
    ("suppliers", "lead_time_non_negative", "lead_time_days < 0"),
    ("suppliers", "unique_supplier", "unique: supplier_id"),
    ("warehouses", "type_in_enum", "not warehouse_type in ('ambient', 'chilled', 'frozen', 'mixed')"),
    ("warehouses", "unique_code", "unique: warehouse_code"),
    ("stores", "unique_store", "unique: store_id"),
    ("dataset_catalogue", "status_in_enum",
     "not status in ('uploaded', 'mapping_required', 'validated', 'ready', 'ingesting', 'ingested', 'failed')"),
    ("dataset_catalogue", "type_in_enum", "not dataset_type in ('warehouse', 'products', 'suppliers', 'sales', 'inventory', 'custom')"),
    ("dataset_catalogue", "row_count_non_negative", "row_count < 0"),
    ("column_mappings", "type_in_enum",
     "not mapping_type in ('exact', 'alias', 'manual', 'generated', 'default', 'ignored', 'identifier', 'custom_feature')"),
    ("column_mappings", "confidence_between_0_1", "confidence < 0 or confidence > 1"),
    ("column_mappings", "unique_column", "unique: dataset_id, source_column"),
    ("forecast_requests", "horizon_in_enum", "not horizon_days in (14, 30, 60, 90)"),
    ("forecast_points", "bounds_ordered", "lower_bound > predicted_units_sold or predicted_units_sold > upper_bound or lower_bound < 0"),
    ("forecast_points", "units_non_negative", "predicted_units_sold < 0"),
]


def _rule_sql(table: str, rule: str, cond: str) -> str:
    count = (f"count(*) - count(distinct ({cond[8:]}))" if cond.startswith("unique: ") else f"count(*) filter (where {cond})")
    return f"select {_q(table)} as table_name, {_q(rule)} as rule, {count} as violations from {table}"


@register("v16_table_constraints", "\nunion all\n".join(_rule_sql(*r) for r in TABLE_RULES))
def v16_table_constraints(t: Tables):
    """CHECK-style rules over the canonical and catalogue tables: one aggregation per table."""
    from larder.plans import forecast as fc
    from larder.plans import queries_catalog as qc

    tables = {"sales_records": t.sales_records, "inventory_snapshots": t.inventory_snapshots, "products": t.products,
              "suppliers": t.suppliers, "warehouses": t.warehouses, "stores": t.stores,
              "dataset_catalogue": lambda: qc.catalogue(t), "column_mappings": lambda: up.mappings(t),
              "forecast_requests": t.forecast_requests, "forecast_points": lambda: fc.forecast_points(t)}
    parts = []
    for table, build in tables.items():
        rules = [(rule, cond) for name, rule, cond in TABLE_RULES if name == table]
        counts = [(F.count(F.lit(1)) - F.expr(f"count(distinct {cond[8:]})")) if cond.startswith("unique: ") else F.count_if(F.expr(cond))
                  for _, cond in rules]
        row = build().agg(*[c.cast("bigint").alias(f"v{i}") for i, c in enumerate(counts)])
        entries = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"v{i}").alias("violations")) for i, (rule, _) in enumerate(rules)])
        parts.append(row.select(F.lit(table).alias("table_name"), F.inline(entries)))
    return up._union(parts)


view("request_lines", """
select o_orderkey as request_id, l_partkey as product_id,
       case o_orderpriority when '1-URGENT' then 14 when '2-HIGH' then 30 when '3-MEDIUM' then 60
            when '4-NOT SPECIFIED' then 90 else 14 end as horizon_days,
       case when o_orderstatus = 'P' then 'sales_upload' end as dataset_id
from lineitem join orders on o_orderkey = l_orderkey""")

# ---------------------------------------------------------------------------
# Reject texts and codes of prediction requests.
REPEATED_PRODUCTS = "product_ids must be unique."
BAD_HORIZON = "forecast_horizon_days must be 14, 30, 60 or 90."
NOT_INGESTED = "The selected dataset has not completed ingestion."
NOT_CONFIRMED = "The selected dataset does not have fully confirmed mappings."
NO_SUCH_DATASET = "The requested dataset was not found."
UNKNOWN_PRODUCTS = "One or more products were not found in your organization."
# ---------------------------------------------------------------------------

view("request_contract", f"""
with g as (select request_id, count(*) as n_products, count(distinct product_id) as n_distinct,
                  max(horizon_days) as horizon_days, max(dataset_id) as dataset_id from request_lines group by request_id),
m as (select dataset_id, bool_and(is_confirmed) as confirmed from column_mappings group by dataset_id),
f as (select l.request_id, count(distinct l.product_id) as n_found from request_lines l
      join products p on p.product_id = l.product_id group by l.request_id)
select g.request_id, n_products, n_distinct, g.horizon_days, g.dataset_id,
       case when n_products <> n_distinct then {_q(REPEATED_PRODUCTS)}
            when not g.horizon_days in (14, 30, 60, 90) then {_q(BAD_HORIZON)}
            when g.dataset_id is not null and d.dataset_id is null then {_q(NO_SUCH_DATASET)}
            when g.dataset_id is not null and d.status <> 'ingested' then {_q(NOT_INGESTED)}
            when g.dataset_id is not null and not coalesce(m.confirmed, false) then {_q(NOT_CONFIRMED)}
            when coalesce(f.n_found, 0) <> n_distinct then {_q(UNKNOWN_PRODUCTS)} end as reject_reason
from g left join dataset_catalogue d on d.dataset_id = g.dataset_id left join m on m.dataset_id = g.dataset_id
left join f on f.request_id = g.request_id""",
     ["request_lines", "column_mappings", "dataset_catalogue", "products"])


def request_contract(t: Tables):
    """Per request: line counts and the first broken rule, from the lines as sent."""
    from larder.plans import queries_catalog as qc

    lines = t.request_lines()
    known = t.products().select("product_id", F.lit(True).alias("_known"))
    per_product = lines.groupBy("request_id", "product_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("horizon_days").alias("horizon_days"), F.max("dataset_id").alias("dataset_id"))
    g = per_product.join(known, "product_id", "left").groupBy("request_id").agg(
        F.sum("n").alias("n_products"), F.count(F.lit(1)).alias("n_distinct"), F.max("horizon_days").alias("horizon_days"),
        F.max("dataset_id").alias("dataset_id"), F.count("_known").alias("n_found"))
    d = qc.catalogue(t).select("dataset_id", F.col("status").alias("_status"))
    m = up.mappings(t).groupBy("dataset_id").agg(F.bool_and("is_confirmed").alias("_confirmed"))
    named = F.col("dataset_id").isNotNull()
    reason = (F.when(F.col("n_products") != F.col("n_distinct"), F.lit(REPEATED_PRODUCTS))
              .when(~F.col("horizon_days").isin(14, 30, 60, 90), F.lit(BAD_HORIZON))
              .when(named & F.col("_status").isNull(), F.lit(NO_SUCH_DATASET))
              .when(named & (F.col("_status") != "ingested"), F.lit(NOT_INGESTED))
              .when(named & ~F.coalesce("_confirmed", F.lit(False)), F.lit(NOT_CONFIRMED))
              .when(F.col("n_found") != F.col("n_distinct"), F.lit(UNKNOWN_PRODUCTS)))
    j = g.join(d, "dataset_id", "left").join(m, "dataset_id", "left")
    return j.select("request_id", "n_products", "n_distinct", "horizon_days", "dataset_id", reason.alias("reject_reason"))


@register("v19_request_contract", "select *, reject_reason is null as accepted from request_contract")
def v19_request_contract(t: Tables):
    """Per request: at least one product, no repeats, a known horizon, an ingested dataset with confirmed mappings."""
    return request_contract(t).withColumn("accepted", F.col("reject_reason").isNull())


# --- ingestion ----------------------------------------------------------------

def _pivot_sql(dataset_id: str, dataset_type: str) -> str:
    canon = ", ".join(_q(c) for c in ig.CANONICAL_FIELDS)
    cols = ",\n       ".join(f"max(case when \"column\" = {_q(f)} then value end) as {f}" for f in fields_of(dataset_type))
    return f"""select dataset_id, source_row_number,
       {cols},
       coalesce(to_json(map_from_entries(list({{'k': "column", 'v': value}} order by column_position)
                filter (where not "column" in ({canon})))), '{{}}') as extras
from mapped_cells where dataset_id = {_q(dataset_id)} group by dataset_id, source_row_number"""


def _text(c: str) -> str:
    return f"case when length(trim({c})) > 0 then trim({c}) end"


def _when(cond: str, message: str) -> str:
    return f"case when {cond} then {_q(message)} end"


def _numbers_sql(kind: str) -> str:
    return ", ".join(f"{_num_sql(c)} as {c}" for c in ig.NUMBERS[kind])


def _number_rules(kind: str) -> list[str]:
    return [_when(f"{c} is not null and ({_num_sql(c)}) is null", f"{c} is not numeric.") for c in ig.NUMBERS[kind]]


def _negative_rules(kind: str) -> list[str]:
    return [_when(f"({_num_sql(c)}) < 0", ig.IS_NEGATIVE.format(c)) for c in ig.NON_NEGATIVE[kind]]


def _first(rules: list[str]) -> str:
    return "coalesce(" + ",\n                ".join(rules) + ")"


def _warehouse_sql(dataset_id: str) -> str:
    default = up.DATASET_WAREHOUSE.get(dataset_id)
    return f"coalesce({_text('r.warehouse_id')}, {_q(default) if default else 'null'})"


_PRODUCT_RULE = [_when("pid is null", ig.IS_REQUIRED.format("product_id")),
                 _when("pkey is null", ig.UNKNOWN_ID.format("product_id"))]
_WAREHOUSE_RULE = [_when("wgiven is not null and wkey is null", ig.UNKNOWN_ID.format("warehouse_id")),
                   _when("wval is not null and wkey is null", ig.NO_DEFAULT_WAREHOUSE)]

_SALES_INGEST = f"""
with r as ({_pivot_sql('sales_upload', 'sales')}),
j as (select r.*, {_text('r.product_id')} as pid, {_text('r.warehouse_id')} as wgiven,
             {_warehouse_sql('sales_upload')} as wval, {_text('r.store_id')} as sval
      from r),
k as (select j.*, p.product_id as pkey, coalesce(wi.warehouse_id, wc.warehouse_id) as wkey, st.store_id as skey,
             {_parse_date_sql('j.transaction_date')} as tdate
      from j left join products p on cast(p.product_id as varchar) = j.pid
      left join warehouses wi on cast(wi.warehouse_id as varchar) = j.wval
      left join warehouses wc on wc.warehouse_code = j.wval
      left join stores st on cast(st.store_id as varchar) = j.sval)
select dataset_id, source_row_number, pkey as product_id, coalesce(cast(skey as varchar), sval) as store_id,
       sval is not null and skey is null as store_created, wkey as warehouse_id, tdate as transaction_date,
       case when lower(trim(is_promoted)) in ('true', '1', 'yes', 'y') then true
            when lower(trim(is_promoted)) in ('false', '0', 'no', 'n') then false end as is_promoted,
       {_numbers_sql('sales')}, extras,
       {_first([*_PRODUCT_RULE, *_WAREHOUSE_RULE, _when("tdate is null", ig.BAD_DATE.format("transaction_date")),
                *_number_rules('sales'),
                _when("is_promoted is not null and not lower(trim(is_promoted)) in ('true', '1', 'yes', 'y', 'false', '0', 'no', 'n')",
                      "is_promoted: Boolean value is invalid."),
                _when("units_sold is null", ig.IS_REQUIRED.format("units_sold")), *_negative_rules('sales'),
                _when(f"({_num_sql('discount_pct')}) not between 0 and 1", ig.BAD_DISCOUNT)])} as reject_reason
from k"""

_INVENTORY_INGEST = f"""
with r as ({_pivot_sql('inventory_upload', 'inventory')}),
j as (select r.*, {_text('r.product_id')} as pid, {_text('r.warehouse_id')} as wgiven,
             {_warehouse_sql('inventory_upload')} as wval from r),
k as (select j.*, p.product_id as pkey, coalesce(wi.warehouse_id, wc.warehouse_id) as wkey,
             {_parse_date_sql('j.snapshot_date')} as sdate, {_parse_date_sql('j.expiration_date')} as edate
      from j left join products p on cast(p.product_id as varchar) = j.pid
      left join warehouses wi on cast(wi.warehouse_id as varchar) = j.wval
      left join warehouses wc on wc.warehouse_code = j.wval)
select dataset_id, source_row_number, pkey as product_id, wkey as warehouse_id, sdate as snapshot_date,
       edate as expiration_date, batch_id, {_numbers_sql('inventory')}, extras,
       {_first([*_PRODUCT_RULE, *_WAREHOUSE_RULE, _when("wkey is null", ig.IS_REQUIRED.format("warehouse_id")),
                _when("sdate is null", ig.BAD_DATE.format("snapshot_date")),
                _when("expiration_date is not null and edate is null", ig.BAD_DATE.format("expiration_date")),
                *_number_rules('inventory'),
                _when("current_inventory is null", ig.IS_REQUIRED.format("current_inventory")),
                *_negative_rules('inventory'), _when("edate < sdate", ig.BAD_EXPIRY)])} as reject_reason
from k"""

_PRODUCTS_INGEST = f"""
with r as ({_pivot_sql('products_upload', 'products')}),
j as (select r.*, {_text('r.product_id')} as pid, {_text('r.product_name')} as pname, {_text('r.supplier_id')} as supv from r)
select dataset_id, source_row_number, pid as external_product_id, pname as product_name, category,
       s.supplier_id, {_numbers_sql('products')}, extras,
       {_first([_when("pid is null", ig.IS_REQUIRED.format("product_id")),
                _when("supv is not null and s.supplier_id is null", ig.UNKNOWN_ID.format("supplier_id")),
                _when("pname is null", ig.IS_REQUIRED.format("product_name")),
                *_number_rules('products'), *_negative_rules('products')])} as reject_reason
from j left join suppliers s on cast(s.supplier_id as varchar) = j.supv"""

_SUPPLIERS_INGEST = f"""
with r as ({_pivot_sql('suppliers_upload', 'suppliers')})
select dataset_id, source_row_number, {_text('supplier_id')} as external_supplier_id, {_text('supplier_name')} as supplier_name,
       {_numbers_sql('suppliers')}, supplier_country, extras,
       {_first([_when(f"({_text('supplier_id')}) is null", ig.IS_REQUIRED.format("supplier_id")),
                _when(f"({_text('supplier_name')}) is null", ig.IS_REQUIRED.format("supplier_name")),
                *_number_rules('suppliers'), *_negative_rules('suppliers')])} as reject_reason
from r"""

_WAREHOUSES_INGEST = f"""
with r as ({_pivot_sql('warehouse_upload', 'warehouse')}),
x as (select dataset_id, source_row_number, extras, country, region, city, storage_capacity, capacity_unit,
             {_text('warehouse_code')} as warehouse_code, {_text('warehouse_name')} as warehouse_name,
             {_text('warehouse_type')} as warehouse_type, coalesce({_text('timezone')}, 'UTC') as timezone from r)
select dataset_id, source_row_number, warehouse_code, warehouse_name, warehouse_type, country, region, city,
       {_numbers_sql('warehouse')}, capacity_unit, timezone, extras,
       {_first([_when("warehouse_code is null", ig.IS_REQUIRED.format("warehouse_code")),
                _when("warehouse_name is null", ig.IS_REQUIRED.format("warehouse_name")),
                _when("warehouse_type is null", ig.IS_REQUIRED.format("warehouse_type")),
                _when("not warehouse_type in ('ambient', 'chilled', 'frozen', 'mixed')", ig.BAD_TYPE),
                *_number_rules('warehouse'), *_negative_rules('warehouse')])} as reject_reason
from x"""


def _rows(t: Tables, dataset_id: str, dataset_type: str):
    """One mapped upload in the canonical layout of its type."""
    return ig.conform(up.mapped_frame(t, dataset_id), dataset_id, dataset_type)


def _sales_rows(t):
    return t._stored("ingested_sales", lambda: ig.ingest_sales(
        _rows(t, "sales_upload", "sales"), t.products(), t.warehouses(), t.stores(), up.DATASET_WAREHOUSE.get("sales_upload")))


def _inventory_rows(t):
    return t._stored("ingested_inventory", lambda: ig.ingest_inventory(
        _rows(t, "inventory_upload", "inventory"), t.products(), t.warehouses(), up.DATASET_WAREHOUSE.get("inventory_upload")))


def _products_rows(t):
    return t._stored("ingested_products", lambda: ig.ingest_products(_rows(t, "products_upload", "products"), t.suppliers()))


def _suppliers_rows(t):
    return t._stored("ingested_suppliers", lambda: ig.ingest_suppliers(_rows(t, "suppliers_upload", "suppliers")))


def _warehouses_rows(t):
    return t._stored("ingested_warehouses", lambda: ig.ingest_warehouses(_rows(t, "warehouse_upload", "warehouse")))


def ingested_rows(t):
    """(dataset_id, source_row_number, reject_reason) of every ingested upload."""
    cols = ["dataset_id", "source_row_number", "reject_reason"]
    parts = [f(t).select(*cols) for f in (_sales_rows, _inventory_rows, _products_rows, _suppliers_rows, _warehouses_rows)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("ingest_sales", _SALES_INGEST)
def ingest_sales(t: Tables):
    return _sales_rows(t)


@register("ingest_inventory", _INVENTORY_INGEST)
def ingest_inventory(t: Tables):
    return _inventory_rows(t)


@register("ingest_products", _PRODUCTS_INGEST)
def ingest_products(t: Tables):
    return _products_rows(t)


@register("ingest_suppliers", _SUPPLIERS_INGEST)
def ingest_suppliers(t: Tables):
    return _suppliers_rows(t)


@register("ingest_warehouses", _WAREHOUSES_INGEST)
def ingest_warehouses(t: Tables):
    return _warehouses_rows(t)


# The rules of the canonical tables, over the good rows of each upload:
# (dataset, rule, SQL condition of a violation), the same text in Spark and DuckDB.
GOOD_ROW_RULES = [
    ("sales_upload", "product_and_date_present", "product_id is null or transaction_date is null"),
    ("sales_upload", "units_sold_non_negative", "units_sold is null or units_sold < 0"),
    ("sales_upload", "selling_price_non_negative", "selling_price < 0"),
    ("sales_upload", "discount_between_0_1", "discount_pct < 0 or discount_pct > 1"),
    ("sales_upload", "spoilage_risk_non_negative", "spoilage_risk < 0"),
    ("sales_upload", "row_number_from_2", "source_row_number < 2"),
    ("inventory_upload", "keys_and_date_present", "product_id is null or warehouse_id is null or snapshot_date is null"),
    ("inventory_upload", "inventory_non_negative", "current_inventory is null or current_inventory < 0 or reserved_inventory < 0 or incoming_inventory < 0"),
    ("inventory_upload", "expiry_not_before_snapshot", "expiration_date < snapshot_date"),
    ("products_upload", "id_and_name_present", "trim(coalesce(external_product_id, '')) = '' or trim(coalesce(product_name, '')) = ''"),
    ("products_upload", "numbers_non_negative", "shelf_life_days < 0 or spoilage_sensitivity < 0 or base_price < 0 or cost_price < 0"),
    ("suppliers_upload", "id_and_name_present", "trim(coalesce(external_supplier_id, '')) = '' or trim(coalesce(supplier_name, '')) = ''"),
    ("suppliers_upload", "numbers_non_negative", "lead_time_days < 0 or minimum_order_quantity < 0"),
    ("warehouse_upload", "type_in_enum", "not warehouse_type in ('ambient', 'chilled', 'frozen', 'mixed')"),
    ("warehouse_upload", "capacity_non_negative", "storage_capacity < 0"),
]
_INGEST_VIEWS = {"sales_upload": ("sales_ingest", _sales_rows), "inventory_upload": ("inventory_ingest", _inventory_rows),
                 "products_upload": ("products_ingest", _products_rows), "suppliers_upload": ("suppliers_ingest", _suppliers_rows),
                 "warehouse_upload": ("warehouses_ingest", _warehouses_rows)}

view("sales_ingest", _SALES_INGEST.strip(), ["mapped_cells", "products", "warehouses", "stores"])
view("inventory_ingest", _INVENTORY_INGEST.strip(), ["mapped_cells", "products", "warehouses"])
view("products_ingest", _PRODUCTS_INGEST.strip(), ["mapped_cells", "suppliers"])
view("suppliers_ingest", _SUPPLIERS_INGEST.strip(), ["mapped_cells"])
view("warehouses_ingest", _WAREHOUSES_INGEST.strip(), ["mapped_cells"])


@register("ingest_good_rows", "\nunion all\n".join(
    f"select {_q(ds)} as dataset_id, {_q(rule)} as rule, count(*) as good_rows, count(*) filter (where {cond}) as violations "
    f"from {_INGEST_VIEWS[ds][0]} where reject_reason is null" for ds, rule, cond in GOOD_ROW_RULES))
def ingest_good_rows(t: Tables):
    """Rules of the canonical tables over the accepted rows: one aggregation per upload, violations must be 0."""
    parts = []
    for ds, (_, rows) in _INGEST_VIEWS.items():
        rules = [(rule, cond) for d, rule, cond in GOOD_ROW_RULES if d == ds]
        good = rows(t).where("reject_reason is null").agg(
            F.count(F.lit(1)).alias("good_rows"), *[F.count_if(F.expr(cond)).alias(f"v{i}") for i, (_, cond) in enumerate(rules)])
        entries = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"v{i}").alias("violations")) for i, (rule, _) in enumerate(rules)])
        parts.append(good.select(F.lit(ds).alias("dataset_id"), "good_rows", F.inline(entries)))
    return up._union(parts)


def _sub(sql: str, cols: str) -> str:
    return f"with x as ({sql}) select {cols} from x"


@register("resolve_product_fk", _sub(_SALES_INGEST, "dataset_id, source_row_number, product_id"))
def resolve_product_fk(t: Tables):
    return _sales_rows(t).select("dataset_id", "source_row_number", "product_id")


@register("resolve_warehouse_fk", _sub(_INVENTORY_INGEST, "dataset_id, source_row_number, warehouse_id, reject_reason"))
def resolve_warehouse_fk(t: Tables):
    """Inventory warehouse: key, else code; unknown ones rejected."""
    return _inventory_rows(t).select("dataset_id", "source_row_number", "warehouse_id", "reject_reason")


@register("resolve_supplier_fk", _sub(_PRODUCTS_INGEST, "dataset_id, source_row_number, supplier_id, reject_reason"))
def resolve_supplier_fk(t: Tables):
    return _products_rows(t).select("dataset_id", "source_row_number", "supplier_id", "reject_reason")


@register("resolve_or_create_store", f"""with x as ({_SALES_INGEST})
select store_id as external_store_id, min(warehouse_id) as warehouse_id, store_id as store_name, true as generated
from x where store_created group by store_id""")
def resolve_or_create_store(t: Tables):
    """Unknown external store ids of sales rows become new store rows."""
    return ig.new_stores(_sales_rows(t))


@register("row_failures", """
with x as (select dataset_id, source_row_number, reject_reason from sales_ingest
  union all select dataset_id, source_row_number, reject_reason from inventory_ingest
  union all select dataset_id, source_row_number, reject_reason from products_ingest
  union all select dataset_id, source_row_number, reject_reason from suppliers_ingest
  union all select dataset_id, source_row_number, reject_reason from warehouses_ingest),
c as (select dataset_id, count(*) filter (where reject_reason is null) as inserted_count,
             count(*) filter (where reject_reason is not null) as failed_count from x group by all),
f as (select dataset_id, list({'row_number': source_row_number, 'code': 'ROW_CONVERSION_FAILED',
                              'message': reject_reason} order by source_row_number) as failures
      from (select * from x where reject_reason is not null
            qualify row_number() over (partition by dataset_id order by source_row_number) <= 20) group by all)
select c.dataset_id, case when failed_count = 0 then 'ingested' else 'failed' end as status,
       inserted_count, failed_count, coalesce(failures, []) as failures
from c left join f on f.dataset_id = c.dataset_id""")
def row_failures(t: Tables):
    return ig.row_failures(ingested_rows(t))
