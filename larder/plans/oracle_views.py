"""Canonical views as SQL text for the DuckDB oracle.

Same definitions as ``sources/tables.py``. ``with_views`` prepends the CTEs a
query needs (dependencies resolved in order), because the oracle only sees
the raw driver tables.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def view(name: str, sql: str, deps: list[str] = ()) -> None:
    VIEWS[name] = sql.strip()
    DEPS[name] = list(deps)


view("suppliers", """
select s_suppkey as supplier_id, s_name as supplier_name, (s_acctbal+1000)/110 as supplier_score,
       s_suppkey%14+1 as lead_time_days, n_name as supplier_country
from supplier join nation on n_nationkey=s_nationkey""")

view("warehouses", """
select n_nationkey as warehouse_id, n_name as warehouse_code,
       case n_nationkey%4 when 0 then 'ambient' when 1 then 'chilled' when 2 then 'frozen' else 'mixed' end as warehouse_type,
       r_name as region
from nation join region on r_regionkey=n_regionkey""")

view("stores", """
select n_nationkey+100 as store_id, n_nationkey as warehouse_id, n_name as store_name,
       case when n_nationkey%3=0 then null else r_name end as region
from nation join region on r_regionkey=n_regionkey""")

view("products", """
select p_partkey as product_id, p_name as product_name, p_type as category, sup.l_suppkey as supplier_id,
       p_size as shelf_life_days, cast(p_size%20-5 as double) as storage_temp,
       cast(p_size as double)/50 as spoilage_sensitivity, p_retailprice as base_price,
       p_retailprice*cast(0.7 as double) as cost_price
from part left join (
  select l_partkey,l_suppkey from (
    select l_partkey,l_suppkey,row_number() over(partition by l_partkey order by sum(l_quantity) desc,l_suppkey) rn
    from lineitem group by l_partkey,l_suppkey) t where rn=1) sup on sup.l_partkey=p_partkey""")

view("li_numbered", """
select l.*, row_number() over(order by l_orderkey,l_linenumber,l_partkey,l_suppkey,l_shipdate,l_extendedprice,l_quantity)+1
       as source_row_number
from lineitem l""")

view("sales_records", """
select 'sales' as dataset_id, source_row_number, l_partkey as product_id, c_nationkey+100 as store_id,
       s_nationkey as warehouse_id, cast(l_shipdate as date) as transaction_date, l_quantity as units_sold,
       l_extendedprice/l_quantity as selling_price, l_discount as discount_pct, l_discount>=0.08 as is_promoted,
       case when l_tax=0 then null else l_tax end as spoilage_risk
from li_numbered join orders on o_orderkey=l_orderkey join customer on c_custkey=o_custkey
     join supplier on s_suppkey=l_suppkey where l_returnflag<>'N'""", ["li_numbered"])

view("inventory_snapshots", """
select 'inventory' as dataset_id, source_row_number, l_partkey as product_id, s_nationkey as warehouse_id,
       cast(l_shipdate as date) as snapshot_date, l_quantity*100 as current_inventory,
       cast(l_linenumber*10 as double) as reserved_inventory, l_tax*1000 as incoming_inventory,
       cast(l_orderkey as varchar)||'-'||cast(l_linenumber as varchar) as batch_id, l_discount as spoilage_risk
from li_numbered join supplier on s_suppkey=l_suppkey where l_returnflag='N'""", ["li_numbered"])

view("forecast_requests", """
select distinct o_orderkey as request_id, l_partkey as product_id, s_nationkey as warehouse_id,
       case when o_orderpriority in ('1-URGENT','2-HIGH') then c_nationkey+100 end as store_id,
       cast(o_orderdate as date) as forecast_start_date,
       case o_orderpriority when '1-URGENT' then 14 when '2-HIGH' then 30 when '3-MEDIUM' then 60
            when '4-NOT SPECIFIED' then 90 else 14 end as horizon_days
from lineitem join orders on o_orderkey=l_orderkey join customer on c_custkey=o_custkey
     join supplier on s_suppkey=l_suppkey""")

view("sale_asof", """
select r.*, s.source_row_number as sale_source_row_number, s.transaction_date as sale_transaction_date,
       s.units_sold as sale_units_sold, s.selling_price as sale_selling_price,
       s.discount_pct as sale_discount_pct, s.is_promoted as sale_is_promoted,
       s.spoilage_risk as sale_spoilage_risk
from forecast_requests r left join sales_records s
  on s.product_id=r.product_id and s.warehouse_id=r.warehouse_id
 and (r.store_id is null or s.store_id=r.store_id) and s.transaction_date<=r.forecast_start_date
qualify row_number() over (partition by r.request_id, r.product_id, r.warehouse_id
        order by s.transaction_date desc nulls last, s.source_row_number desc nulls last)=1""",
     ["forecast_requests", "sales_records"])

view("inventory_asof", """
select r.*, i.source_row_number as inv_source_row_number, i.snapshot_date as inv_snapshot_date,
       i.current_inventory as inv_current_inventory, i.incoming_inventory as inv_incoming_inventory,
       i.spoilage_risk as inv_spoilage_risk
from sale_asof r left join inventory_snapshots i
  on i.product_id=r.product_id and i.warehouse_id=r.warehouse_id and i.snapshot_date<=r.forecast_start_date
qualify row_number() over (partition by r.request_id, r.product_id, r.warehouse_id
        order by i.snapshot_date desc nulls last, i.source_row_number desc nulls last)=1""",
     ["sale_asof", "inventory_snapshots"])

view("forecast_context", """
select r.request_id, r.product_id, r.warehouse_id, r.store_id, r.forecast_start_date, r.horizon_days,
       p.shelf_life_days, p.cost_price, p.spoilage_sensitivity, p.storage_temp, p.category,
       su.supplier_score, coalesce(st.region, w.region) as region,
       r.sale_selling_price as selling_price,
       case when r.sale_source_row_number is null then 0.0 else r.sale_discount_pct end as discount_pct,
       case when r.sale_source_row_number is null then false else r.sale_is_promoted end as is_promoted,
       coalesce(r.sale_spoilage_risk, r.inv_spoilage_risk) as spoilage_risk,
       r.inv_current_inventory as current_inventory, r.inv_incoming_inventory as incoming_inventory
from inventory_asof r
left join products p on p.product_id=r.product_id
left join suppliers su on su.supplier_id=p.supplier_id
left join warehouses w on w.warehouse_id=r.warehouse_id
left join stores st on st.store_id=r.store_id""",
     ["inventory_asof", "products", "suppliers", "warehouses", "stores"])

_SCORE = " + ".join(
    f"{float(i)}*coalesce(cast({c} as double),0.0)" for i, c in enumerate(
        ["shelf_life_days", "cost_price", "selling_price", "discount_pct", "is_promoted",
         "supplier_score", "storage_temp", "spoilage_sensitivity", "spoilage_risk"], start=1))

view("scored_context", f"""
select c.*, greatest(0, cast(round_even(greatest(0.0, 10.0 + abs({_SCORE}) % 490.0), 0) as bigint))
       as predicted_units_sold
from forecast_context c""", ["forecast_context"])

view("forecast_points", """
select x.*, cast(x.forecast_start_date + x.day_index as date) as forecast_date,
       greatest(0, x.predicted_units_sold - cast(floor(42.0 + x.predicted_units_sold*0.08 + 0.5) as bigint)) as lower_bound,
       x.predicted_units_sold + cast(floor(42.0 + x.predicted_units_sold*0.08 + 0.5) as bigint) as upper_bound
from (select s.*, cast(unnest(generate_series(0, s.horizon_days-1)) as integer) as day_index
      from scored_context s) x""", ["scored_context"])


def with_views(body: str, *names: str) -> str:
    """``WITH`` clause for the named views (and what they depend on) + body."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in DEPS[n]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} as (\n{VIEWS[n]}\n)" for n in order)
    body = body.strip()
    head = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    if head:
        return f"with {head.group(1) or ''}{ctes},\n{body[head.end():]}"
    return f"with {ctes}\n{body}"


def referenced(body: str) -> list[str]:
    """View names used in a query body (word match)."""
    return [n for n in VIEWS if re.search(rf"\b{n}\b", body)]


def oracle(body: str) -> str:
    return with_views(body, *referenced(body))


view("sales_upload", """
select source_row_number,
       case when source_row_number%97=0 then 'not-a-date'
            when source_row_number%89=0 then strftime(transaction_date, '%m/%d/%Y')
            else strftime(transaction_date, '%Y-%m-%d') end as "Sale Date",
       case when source_row_number%83=0 then null when source_row_number%113=0 then '  '
            when source_row_number%79=0 then 'SKU-'||cast(product_id as varchar)
            else cast(product_id as varchar) end as sku,
       case when source_row_number%73=0 then '-'||cast(cast(units_sold as bigint) as varchar)
            when source_row_number%71=0 then null when source_row_number%67=0 then 'abc'
            when source_row_number%127=0 then cast(cast(units_sold as bigint) as varchar)||'d'
            else cast(cast(units_sold as bigint) as varchar) end as qty_sold,
       cast(cast(round(selling_price*100) as bigint)//100 as varchar) || '.' ||
         lpad(cast(cast(round(selling_price*100) as bigint)%100 as varchar), 2, '0') as unit_price,
       case when source_row_number%61=0 then '1.5' else cast(discount_pct as varchar) end as discount,
       case when source_row_number%59=0 then 'maybe' when is_promoted then 'yes' else 'no' end as promotion_flag,
       case when source_row_number%101=0 then 'S-'||cast(source_row_number%3 as varchar)
            else cast(store_id as varchar) end as store_code,
       case when source_row_number%107=0 then null else (select warehouse_code from warehouses w
                                                 where w.warehouse_id=s.warehouse_id) end as warehouse_id,
       cast(spoilage_risk as varchar) as spoilage_risk,
       'note '||cast(source_row_number%7 as varchar) as receipt_note
from sales_records s""", ["sales_records", "warehouses"])

view("inventory_upload", """
select i.source_row_number, strftime(i.snapshot_date, '%Y-%m-%d') as as_of_date,
       cast(i.product_id as varchar) as item_id,
       case when i.source_row_number%47=0 then 'WH-X' when i.source_row_number%109=0 then ' '
            else w.warehouse_code end as location_id,
       case when i.source_row_number%43=0 then '-'||cast(cast(i.current_inventory as bigint) as varchar)
            else cast(cast(i.current_inventory as bigint) as varchar) end as on_hand,
       cast(cast(i.reserved_inventory as bigint) as varchar) as reserved_inventory,
       cast(cast(round(i.incoming_inventory) as bigint) as varchar) as incoming_inventory,
       strftime(case when i.source_row_number%53=0 then i.snapshot_date - 3
                     else i.snapshot_date + p.shelf_life_days end, '%Y-%m-%d') as expiration_date,
       i.batch_id, cast(i.spoilage_risk as varchar) as spoilage_risk,
       't'||cast(i.source_row_number%11 as varchar) as temperature_log
from inventory_snapshots i left join products p on p.product_id=i.product_id
     left join warehouses w on w.warehouse_id=i.warehouse_id""",
     ["inventory_snapshots", "products", "warehouses"])

view("products_upload", """
select product_id+2 as source_row_number, cast(product_id as varchar) as sku,
       case when product_id%41=0 then ' ' else product_name end as product_name,
       case when product_id%29=0 then 'EXPERIMENTAL' else category end as category,
       case when product_id%37=0 then '999999' else cast(supplier_id as varchar) end as vendor_id,
       cast(shelf_life_days as varchar) as shelf_life_days,
       cast(cast(storage_temp as bigint) as varchar) as storage_temp,
       case when product_id%31=0 then '-1' else cast(product_id%900+100 as varchar) end as base_price,
       case when product_id%23=0 then '5f' else cast(product_id%700+50 as varchar) end as cost_price,
       'brand '||cast(product_id%13 as varchar) as brand_note
from products""", ["products"])


view("suppliers_upload", """
select supplier_id+1 as source_row_number,
       case when supplier_id%19=0 then '  ' else cast(supplier_id as varchar) end as supplier_code,
       case when supplier_id%23=0 then null else supplier_name end as supplier_name,
       case when supplier_id%17=0 then '12d' else cast(supplier_id%100 as varchar) end as supplier_score,
       case when supplier_id%13=0 then '-3' else cast(lead_time_days as varchar) end as lead_time_days,
       cast(supplier_id%40 as varchar) as minimum_order_quantity, supplier_country,
       'desk '||cast(supplier_id%5 as varchar) as contact_note
from suppliers""", ["suppliers"])

view("warehouse_upload", """
select cast(n_nationkey+2 as bigint) as source_row_number,
       case when n_nationkey%11=3 then ' ' else n_name end as warehouse_code,
       case when n_nationkey%13=5 then null else n_name||' DC' end as warehouse_name,
       case when n_nationkey%9=4 then 'tropical' when n_nationkey%4=0 then 'ambient' when n_nationkey%4=1 then 'chilled'
            when n_nationkey%4=2 then 'frozen' else 'mixed' end as warehouse_type,
       n_name as country, r_name as region,
       case when n_nationkey%8=6 then 'n.k.' else cast(n_nationkey*100-500 as varchar) end as storage_capacity,
       case when n_nationkey%6=1 then null else 'Europe/Paris' end as timezone,
       'dock '||cast(n_nationkey%3 as varchar) as dock_note
from nation join region on r_regionkey=n_regionkey""")

view("orders_upload", """
select cast(o_orderkey+1 as bigint) as source_row_number,
       strftime(date_trunc('month', cast(o_orderdate as date)), '%Y-%m-%d') as "Sale Date",
       strftime(date_trunc('year', cast(o_orderdate as date)), '%Y-%m-%d') as "date", o_orderpriority as sku,
       cast(cast(floor(o_totalprice/100000) as bigint) as varchar) as qty_sold
from orders""")


# --- upload onboarding -------------------------------------------------------
def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


UPLOAD_COLUMNS = {
    "sales_upload": ("sales", ["Sale Date", "sku", "qty_sold", "unit_price", "discount", "promotion_flag",
                               "store_code", "warehouse_id", "spoilage_risk", "receipt_note"]),
    "inventory_upload": ("inventory", ["as_of_date", "item_id", "location_id", "on_hand", "reserved_inventory",
                                       "incoming_inventory", "expiration_date", "batch_id", "spoilage_risk",
                                       "temperature_log"]),
    "products_upload": ("products", ["sku", "product_name", "category", "vendor_id", "shelf_life_days",
                                     "storage_temp", "base_price", "cost_price", "brand_note"]),
    "suppliers_upload": ("suppliers", ["supplier_code", "supplier_name", "supplier_score", "lead_time_days",
                                       "minimum_order_quantity", "supplier_country", "contact_note"]),
    "warehouse_upload": ("warehouse", ["warehouse_code", "warehouse_name", "warehouse_type", "country", "region",
                                       "storage_capacity", "timezone", "dock_note"]),
    "orders_upload": ("sales", ["Sale Date", "date", "sku", "qty_sold"]),
}

view("upload_cells", "\nunion all\n".join(
    f"select {_q(ds)} as dataset_id, {_q(dt)} as dataset_type, source_row_number, {i} as column_position, "
    f"{_q(c)} as source_column, \"{c}\" as value from {ds}"
    for ds, (dt, cols) in UPLOAD_COLUMNS.items() for i, c in enumerate(cols)),
    list(UPLOAD_COLUMNS))


def _parse_date_sql(x: str) -> str:
    from larder.functions.parsing import DATE_FORMATS
    return ("cast(coalesce(" + ", ".join(f"try_strptime(trim({x}), '{p}')" for _, p in DATE_FORMATS)
            + ") as date)")


def _num_sql(x: str) -> str:
    from larder.functions.parsing import NUMBER_PATTERN
    return f"case when regexp_full_match(trim({x}), '{NUMBER_PATTERN}') then try_cast(trim({x}) as double) end"


def _normalize_sql(x: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '[^a-zA-Z0-9]+', '_', 'g'), "
            f"'_+', '_', 'g'), '^_+|_+$', '', 'g')")


def _bool_tokens() -> str:
    from larder.functions.parsing import BOOLEAN_TOKENS
    return ", ".join(_q(b) for b in BOOLEAN_TOKENS)


view("column_profile", f"""
with c as (select *, {_parse_date_sql('value')} as pd from upload_cells),
stats as (
  select dataset_id, dataset_type, source_column, column_position, count(*) as n_rows, count(value) as n_nonnull,
         count(*) filter (where value is not null and not lower(trim(value)) in ({_bool_tokens()})) as n_not_bool,
         count(*) filter (where value is not null and ({_num_sql('value')}) is null) as n_not_num,
         count(pd) as n_date, min(pd) as date_min, max(pd) as date_max,
         count(distinct value) as unique_count
  from c group by all),
first_seen as (select dataset_id, source_column, value, min(source_row_number) as first_row
               from upload_cells where value is not null group by all),
samples as (select dataset_id, source_column, list(value order by first_row, value) as sample_values
            from (select *, row_number() over (partition by dataset_id, source_column order by first_row, value) as rk
                  from first_seen) where rk <= 5 group by all)
select s.dataset_id, s.dataset_type, s.source_column, s.column_position,
       {_normalize_sql('s.source_column')} as normalized_column,
       case when n_nonnull = 0 then 'unknown' when n_not_bool = 0 then 'boolean' when n_not_num = 0 then 'numeric'
            when n_date / n_nonnull >= 0.9 then 'date'
            when unique_count / greatest(1, n_nonnull) <= 0.5 then 'categorical' else 'text' end as detected_type,
       coalesce(sample_values, []::varchar[]) as sample_values, n_rows - n_nonnull as missing_count,
       cast(unique_count as bigint) as unique_count, date_min, date_max
from stats s left join samples p on p.dataset_id = s.dataset_id and p.source_column = s.source_column""",
     ["upload_cells"])


def _targets_sql() -> str:
    from larder.operators.mapping import TARGET_FIELDS
    return "select * from (values " + ", ".join(
        f"({_q(d)}, {_q(f)}, {'true' if r else 'false'})" for d, f, r in TARGET_FIELDS
    ) + ") v(dataset_type, target_field, is_required)"


def _aliases_sql() -> str:
    from larder.operators.mapping import alias_rows
    return "select * from (values " + ", ".join(
        f"({_q(a)}, {_q(t)})" for a, t in alias_rows()) + ") v(alias, alias_target)"


view("mapping_targets", _targets_sql())
view("mapping_aliases", _aliases_sql())

view("mapping_suggestions", f"""
select c.dataset_id, c.dataset_type, c.source_column,
       case when e.target_field is not null then e.target_field when a.alias_target is not null then a.alias_target end
         as suggested_target,
       cast(case when e.target_field is not null then 1.0 when a.alias_target is not null then 0.9 else 0.0 end
            as double) as confidence,
       case when e.target_field is not null then 'exact' when a.alias_target is not null then 'alias' else 'ignored' end
         as mapping_type
from (select dataset_id, dataset_type, source_column, normalized_column from column_profile) c
left join mapping_targets e on e.dataset_type = c.dataset_type and e.target_field = c.normalized_column
left join (select al.alias, al.alias_target, t.dataset_type from mapping_aliases al
           join mapping_targets t on t.target_field = al.alias_target) a
  on a.dataset_type = c.dataset_type and a.alias = c.normalized_column""",
     ["column_profile", "mapping_targets", "mapping_aliases"])


def _unconfirmed_sql() -> str:
    from larder.plans.uploads import UNCONFIRMED
    return " or ".join(f"(dataset_id = {_q(d)} and source_column = {_q(c)})" for d, c in UNCONFIRMED)


def _defaults_sql() -> str:
    from larder.plans.uploads import DEFAULT_MAPPINGS
    return ", ".join(f"({_q(ds)}, {_q(dt)}, {_q('(default) ' + f)}, {_q(f)}, {_q(v)}, {len(UPLOAD_COLUMNS[ds][1]) + i})"
                     for i, (ds, dt, f, v) in enumerate(DEFAULT_MAPPINGS))


view("default_mappings", f"""
select * from (values {_defaults_sql()}) v(dataset_id, dataset_type, source_column, target_field, default_value, position)""")

view("column_mappings", f"""
select dataset_id, dataset_type, source_column, suggested_target as target_field, mapping_type,
       mapping_type <> 'ignored' and not ({_unconfirmed_sql()}) as is_confirmed,
       cast(case when mapping_type <> 'ignored' and not ({_unconfirmed_sql()}) then 1.0 else 0.0 end as double)
         as confidence, cast(null as varchar) as default_value
from mapping_suggestions
union all select dataset_id, dataset_type, source_column, target_field, 'default', true, 1.0, default_value
from default_mappings""", ["mapping_suggestions", "default_mappings"])

view("mapped_cells", """
select c.dataset_id, c.dataset_type, c.source_row_number, c.column_position, c.source_column,
       case when m.is_confirmed then m.target_field else c.source_column end as "column", c.value
from upload_cells c left join column_mappings m on m.dataset_id = c.dataset_id and m.source_column = c.source_column
union all
select d.dataset_id, d.dataset_type, r.source_row_number, d.position, d.source_column, d.target_field, d.default_value
from default_mappings d join (select distinct dataset_id, source_row_number from upload_cells) r
  on r.dataset_id = d.dataset_id""",
     ["upload_cells", "column_mappings", "default_mappings"])

view("upload_datasets", "select * from (values " + ", ".join(
    f"({_q(ds)}, {_q(dt)}, 'uploaded')" for ds, (dt, _) in UPLOAD_COLUMNS.items())
    + ") v(dataset_id, dataset_type, status)")

view("missing_required", """
select d.dataset_id, t.target_field, d.dataset_type from upload_datasets d
join mapping_targets t on t.dataset_type = d.dataset_type and t.is_required
where not exists (select 1 from column_mappings m where m.dataset_id = d.dataset_id and m.is_confirmed
                  and m.target_field = t.target_field and m.mapping_type <> 'ignored')""",
     ["upload_datasets", "mapping_targets", "column_mappings"])

view("known_references", """
select 'product_id' as "column", cast(product_id as varchar) as value from products
union all select 'supplier_id', cast(supplier_id as varchar) from suppliers
union all select 'warehouse_id', warehouse_code from warehouses
union all select 'store_id', cast(store_id as varchar) from stores""",
     ["products", "suppliers", "warehouses", "stores"])


def _in(names) -> str:
    return ", ".join(_q(n) for n in names)


def _issues_sql() -> str:
    from larder.operators.validate import (DATE_FIELDS, IDENTIFIER_FIELDS, NUMERIC_NON_NEGATIVE,
                                           REFERENCE_FIELDS)
    refs = " union all ".join(f"select {_q(t)} as dataset_type, {_q(f)} as \"column\""
                              for t, fs in REFERENCE_FIELDS.items() for f in fs)
    pdv = _parse_date_sql("value")
    return f"""
with m as (select *, {_num_sql("value")} as num from mapped_cells),
cell as (
  select dataset_id, source_row_number, 'error' as severity, 'INVALID_NUMERIC' as code, "column" as issue_column,
         value as issue_value from m
  where "column" in ({_in(NUMERIC_NON_NEGATIVE)}) and value is not null and num is null
  union all
  select dataset_id, source_row_number, 'error', 'NEGATIVE_VALUE', "column", value from m
  where "column" in ({_in(NUMERIC_NON_NEGATIVE)}) and num < 0
  union all
  select dataset_id, source_row_number, 'error', 'DISCOUNT_OUT_OF_RANGE', "column", value from m
  where "column" = 'discount_pct' and num is not null and (num < 0 or num > 1)
  union all
  select dataset_id, source_row_number, 'error', 'INVALID_DATE', "column", value from m
  where "column" in ({_in(DATE_FIELDS)}) and value is not null and {pdv} is null
  union all
  select dataset_id, source_row_number, 'error', 'EMPTY_IDENTIFIER', "column", null from m
  where "column" in ({_in(IDENTIFIER_FIELDS)}) and trim(coalesce(value, '')) = ''
  union all
  select x.dataset_id, x.source_row_number, 'error', 'UNKNOWN_' || upper(x."column"), x."column", x.v
  from (select m.*, trim(value) as v from m join ({refs}) r
        on r.dataset_type = m.dataset_type and r."column" = m."column") x
  where coalesce(x.v, '') <> ''
    and not exists (select 1 from known_references k where k."column" = x."column" and k.value = x.v)
  union all
  select dataset_id, source_row_number, 'error', 'EXPIRATION_BEFORE_SNAPSHOT', 'expiration_date', null
  from (select dataset_id, source_row_number,
               max(case when "column" = 'expiration_date' then {pdv} end) as exp,
               max(case when "column" = 'snapshot_date' then {pdv} end) as snap
        from m where "column" in ('expiration_date', 'snapshot_date') group by all) r
  where exp < snap),
cells as (
  select dataset_id, severity, code, issue_column as "column", source_row_number as row_number, issue_value as value
  from cell),
missing as (
  select c.dataset_id, case when t.is_required then 'error' else 'warning' end as severity,
         'MISSING_VALUES' as code, c."column", cast(null as bigint) as row_number,
         cast(c.n_missing as varchar) as value
  from (select dataset_id, dataset_type, "column", count(*) filter (where value is null) as n_missing
        from mapped_cells group by all) c
  left join mapping_targets t on t.dataset_type = c.dataset_type and t.target_field = c."column" and t.is_required
  where c.n_missing > 0),
dups as (
  select dataset_id, 'warning' as severity, 'DUPLICATE_ROWS' as code, cast(null as varchar) as "column",
         cast(null as bigint) as row_number, cast(n_dup as varchar) as value
  from (select dataset_id, count(*) - count(distinct cells) as n_dup
        from (select dataset_id, source_row_number,
                     list({{'p': column_position, 'c': "column", 'v': value}} order by column_position) as cells
              from mapped_cells group by dataset_id, source_row_number) x group by dataset_id) where n_dup > 0),
maps as (
  select dataset_id, 'error' as severity, 'MISSING_REQUIRED_MAPPING' as code, target_field as "column",
         cast(null as bigint) as row_number, cast(null as varchar) as value from missing_required
  union all
  select dataset_id, 'error', 'DUPLICATE_TARGET_MAPPING', target_field, cast(null as bigint), cast(count(*) as varchar)
  from column_mappings where is_confirmed and target_field is not null group by dataset_id, target_field
  having count(*) > 1)
select * from maps union all select * from dups union all select * from missing union all select * from cells"""


view("validation_issues", _issues_sql(),
     ["mapped_cells", "known_references", "mapping_targets", "missing_required", "column_mappings"])

view("listed_issues", """
select * from validation_issues where row_number is null
union all
select * from validation_issues where row_number is not null
qualify row_number() over (partition by dataset_id, code, "column" order by row_number) <= 5""", ["validation_issues"])


view("hourly_arrays", """
with per_hour as (select user_id, cast(ts as date) as dt, hour(ts) as hr, sum(value) as v from events group by all),
slots as (select user_id, dt, unnest(range(24)) as h from (select distinct user_id, dt from per_hour))
select s.user_id, s.dt, list(round(coalesce(p.v, 0.0), 6) order by s.h) as hours_sale,
       list(case when p.v is null then 1 else 0 end order by s.h) as hours_stock_status
from slots s left join per_hour p on p.user_id = s.user_id and p.dt = s.dt and p.hr = s.h
group by s.user_id, s.dt""")


# --- training frame ------------------------------------------------------------
view("training_frame", """
select s.source_row_number as row_id, s.transaction_date, s.units_sold, cast(p.shelf_life_days as double) as shelf_life_days,
       p.cost_price, p.spoilage_sensitivity, s.spoilage_risk, s.selling_price, s.discount_pct,
       cast(s.is_promoted as double) as is_promoted, su.supplier_score, p.storage_temp, p.category,
       coalesce(st.region, w.region) as region
from sales_records s left join products p on p.product_id = s.product_id
left join suppliers su on su.supplier_id = p.supplier_id
left join stores st on st.store_id = s.store_id
left join warehouses w on w.warehouse_id = s.warehouse_id""",
     ["sales_records", "products", "suppliers", "stores", "warehouses"])

view("split_random", """
select *, case when cast(('0x' || substr(md5('42:' || cast(row_id as varchar)), 1, 8)) as bigint) / 4294967296.0 < 0.65
               then 'train' else 'test' end as split from training_frame""", ["training_frame"])

view("daily_series", """
select product_id, warehouse_id, transaction_date as day, sum(units_sold) as units, avg(selling_price) as price,
       max(cast(is_promoted as integer)) as promoted
from sales_records group by all""", ["sales_records"])
