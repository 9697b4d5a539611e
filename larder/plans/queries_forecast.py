"""Forecast request, context, horizon, scoring and analytics queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larder.functions import forecast as ff
from larder.operators.asof import flatten
from larder.plans import analytics as an
from larder.plans import forecast as fc
from larder.plans.catalog import register
from larder.session import SHUFFLE_CLEANUP, scratch_path, settings

S = "request_id, product_id, warehouse_id"
U = "predicted_units_sold"


@register("latest_sale_asof", "select * from sale_asof")
def latest_sale_asof(t):
    return flatten(fc.with_latest_sale(t), "sale", "sale_")


@register("latest_inventory_asof", """
select r.*, i.source_row_number as inv_source_row_number, i.snapshot_date as inv_snapshot_date,
       i.current_inventory as inv_current_inventory, i.incoming_inventory as inv_incoming_inventory,
       i.spoilage_risk as inv_spoilage_risk
from forecast_requests r left join inventory_snapshots i
  on i.product_id=r.product_id and i.warehouse_id=r.warehouse_id and i.snapshot_date<=r.forecast_start_date
qualify row_number() over (partition by r.request_id, r.product_id, r.warehouse_id
        order by i.snapshot_date desc nulls last, i.source_row_number desc nulls last)=1""")
def latest_inventory_asof(t):
    return flatten(fc.with_latest_inventory(t, t.forecast_requests()), "inv", "inv_")


@register("forecast_context", "select * from forecast_context")
def forecast_context(t):
    return fc.forecast_context(t)


@register("horizon_dates", """
select request_id, forecast_start_date, horizon_days, day_index,
       cast(forecast_start_date + day_index as date) as forecast_date
from (select r.*, cast(unnest(generate_series(0, r.horizon_days-1)) as integer) as day_index
      from (select distinct request_id, forecast_start_date, horizon_days from forecast_requests) r) x""")
def horizon_dates(t):
    req = t.forecast_requests().select("request_id", "forecast_start_date", "horizon_days").distinct()
    return fc.horizon_rows(req)


@register("product_date_cross", f"""
select {S}, day_index, cast(forecast_start_date + day_index as date) as forecast_date
from (select r.*, cast(unnest(generate_series(0, r.horizon_days-1)) as integer) as day_index
      from forecast_requests r) x""")
def product_date_cross(t):
    return fc.horizon_rows(t.forecast_requests()).select(*fc.SERIES, "day_index", "forecast_date")


@register("default_features", f"""
select {S}, {", ".join(f"coalesce(cast({c} as double), 0.0) as {c}" for c in ff.DEFAULT_FEATURES)}
from forecast_context""")
def default_features(t):
    ctx = fc.forecast_context(t)
    return ctx.select(*fc.SERIES, *[ff.default_feature(c).alias(c) for c in ff.DEFAULT_FEATURES])


_RAW = " + ".join(f"{float(i)}*coalesce(cast({c} as double),0.0)"
                  for i, c in enumerate(ff.DEFAULT_FEATURES, start=1))


@register("placeholder_score", f"""
select {S}, greatest(0.0, 10.0 + abs({_RAW}) % 490.0) as raw_score from forecast_context""")
def placeholder_score(t):
    ctx = fc.forecast_context(t)
    score = ff.placeholder_score([ff.default_feature(c) for c in ff.DEFAULT_FEATURES])
    return ctx.select(*fc.SERIES, score.alias("raw_score"))


@register("round_units", f"select {S}, {U} from scored_context")
def round_units(t):
    return fc.score_context(fc.forecast_context(t)).select(*fc.SERIES, U)


@register("forecast_bounds", f"""
select {S}, {U},
       greatest(0, {U} - cast(floor(42.0 + {U}*0.08 + 0.5) as bigint)) as lower_bound,
       {U} + cast(floor(42.0 + {U}*0.08 + 0.5) as bigint) as upper_bound
from scored_context""")
def forecast_bounds(t):
    s = fc.score_context(fc.forecast_context(t))
    return s.select(*fc.SERIES, U, ff.lower_bound(U).alias("lower_bound"), ff.upper_bound(U).alias("upper_bound"))


@register("weekly_totals", f"""
select {S}, cast(floor(day_index/7) as integer) as week_index, min(forecast_date) as week_start,
       max(forecast_date) as week_end, cast(sum({U}) as bigint) as units
from forecast_points group by all""")
def weekly_totals(t):
    return an.weekly_totals(fc.scored_series(t))


@register("forecast_summary", f"""
select {S}, count(*) as n_days, cast(sum({U}) as bigint) as total_units,
       cast(floor(sum({U})/count(*) + 0.5) as bigint) as average_units,
       first(forecast_date order by {U} desc, day_index) as peak_date, max({U}) as peak_units,
       first(forecast_date order by {U}, day_index) as lowest_date, min({U}) as lowest_units,
       cast(floor((sum(case when day_index >= horizon_days - greatest(1, floor(horizon_days/4)) then {U} else 0 end)
                   / max(greatest(1, floor(horizon_days/4)))
                 - sum(case when day_index < greatest(1, floor(horizon_days/4)) then {U} else 0 end)
                   / max(greatest(1, floor(horizon_days/4))))
                / nullif(sum(case when day_index < greatest(1, floor(horizon_days/4)) then {U} else 0 end)
                   / max(greatest(1, floor(horizon_days/4))), 0.0) * 100 + 0.5) as bigint) as trend_pct
from forecast_points group by all""")
def forecast_summary(t):
    return an.forecast_summary(fc.scored_series(t))


_PROJ = f"""proj as (
  select *, cast(floor(coalesce(current_inventory, 0.0) - sum({U}) over (partition by {S} order by day_index
         rows between unbounded preceding and current row) + 0.5) as bigint) as projected_inventory
  from forecast_points)"""

_IMPACT = f"""impact as (
  select {S}, first(coalesce(current_inventory, 0.0)) as current_inventory,
         first(coalesce(incoming_inventory, 0.0)) as incoming_inventory,
         cast(sum({U}) as bigint) as demand,
         min(case when projected_inventory + coalesce(incoming_inventory, 0.0) < 0 then forecast_date end) as stockout_date
  from proj group by all)"""

_IMPACT_COLS = """current_inventory + incoming_inventory - demand as remaining,
       greatest(0.0, -(current_inventory + incoming_inventory - demand)) as shortage"""


@register("projected_inventory", f"""
with {_PROJ}
select {S}, forecast_date, projected_inventory from proj""")
def projected_inventory(t):
    return an.projected_inventory(fc.scored_series(t)).select(*fc.SERIES, "forecast_date", "projected_inventory")


@register("inventory_impact", f"""
with {_PROJ}, {_IMPACT}, x as (select *, {_IMPACT_COLS} from impact)
select *, greatest(0.0, shortage + floor(demand*0.15 + 0.5)) as reorder,
       case when shortage > 0 then 'Stockout expected' when remaining < demand*0.15 then 'Low stock risk'
            else 'Sufficient stock' end as stock_state
from x""")
def inventory_impact(t):
    return an.inventory_impact(fc.scored_series(t))


@register("stockout_date", f"""
with {_PROJ}, {_IMPACT}
select {S}, stockout_date from impact""")
def stockout_date(t):
    return an.stockout_date(fc.scored_series(t))


@register("stock_state", f"""
with {_PROJ}, {_IMPACT}, x as (select *, {_IMPACT_COLS} from impact)
select {S}, case when shortage > 0 then 'Stockout expected' when remaining < demand*0.15 then 'Low stock risk'
            else 'Sufficient stock' end as stock_state from x""")
def stock_state(t):
    return an.inventory_impact(fc.scored_series(t)).select(*fc.SERIES, "stock_state")


@register("peak_window", f"""
select {S}, greatest(min(forecast_date), cast(first(forecast_date order by {U} desc, day_index) - 3 as date)) as window_start,
       first(forecast_date order by {U} desc, day_index) as peak_date
from forecast_points group by all""")
def peak_window(t):
    return an.peak_window(fc.forecast_points(t, by_series=True))


@register("demand_status", f"""
select {S}, forecast_date, {U},
       case when {U} = max({U}) over w then 'Peak'
            when {U} >= cast(floor(sum({U}) over w / count(*) over w + 0.5) as bigint)*1.15 then 'High'
            when {U} <= cast(floor(sum({U}) over w / count(*) over w + 0.5) as bigint)*0.85 then 'Low'
            else 'Normal' end as demand_status
from forecast_points window w as (partition by {S})""")
def demand_status(t):
    return an.demand_status(fc.scored_series(t))


_EXPORT = f"""
with {_PROJ}, e as (
  select *, coalesce(is_promoted, false) and day_index between floor(horizon_days*0.25) and floor(horizon_days*0.45) as promo,
         coalesce(discount_pct, 0.0)*100 as pct
  from proj)
select {S}, strftime(forecast_date, '%Y-%m-%d') as date, {U}, lower_bound, upper_bound,
       case when promo then cast(floor(selling_price*(1.0 - pct/100.0) + 0.5) as double) else selling_price end
         as planned_selling_price,
       case when promo then pct else 0.0 end as discount_pct, promo as is_promoted, projected_inventory
from e"""


@register("planned_price", f"""
with {_PROJ}, e as (
  select *, coalesce(is_promoted, false) and day_index between floor(horizon_days*0.25) and floor(horizon_days*0.45) as promo,
         coalesce(discount_pct, 0.0)*100 as pct
  from proj)
select {S}, forecast_date,
       case when promo then cast(floor(selling_price*(1.0 - pct/100.0) + 0.5) as double) else selling_price end
         as planned_selling_price
from e""")
def planned_price(t):
    pts = fc.forecast_points(t)
    pct = F.coalesce(F.col("discount_pct"), F.lit(0.0)) * 100
    return pts.select(*fc.SERIES, "forecast_date",
                      ff.planned_price("selling_price", pct, F.coalesce(F.col("is_promoted"), F.lit(False)),
                                       "day_index", "horizon_days").alias("planned_selling_price"))


EXPORT_SCHEMA = ("request_id bigint, product_id bigint, warehouse_id int, date string, "
                 "predicted_units_sold bigint, lower_bound bigint, upper_bound bigint, "
                 "planned_selling_price double, discount_pct double, is_promoted boolean, "
                 "projected_inventory bigint")


EXPORT_SPLIT = "8m"  # bytes of the stored series that one task of the export writes out


@register("write_forecast_csv", _EXPORT)
def write_forecast_csv(t):
    """Write the daily export as header CSV (gzip) to the shared scratch folder, read it back."""
    out = scratch_path(t.spark, f"forecast_csv/{uuid.uuid4().hex}")
    # A few files of series a task: their daily rows are many times as much work as their bytes. The rows of a series are so
    # alike that the fastest gzip level loses little.
    with settings(t.spark, {"spark.sql.files.maxPartitionBytes": EXPORT_SPLIT, SHUFFLE_CLEANUP: "true"}):
        (an.forecast_export(fc.scored_series(t)).write.mode("overwrite").option("header", True)
         .option("zlib.compress.level", "BEST_SPEED").csv(out, compression="gzip"))
    return t.spark.read.schema(EXPORT_SCHEMA).option("header", True).csv(out)


@register("table_page", f"""
with r as (select {S}, forecast_date, {U},
                  row_number() over (partition by {S} order by {U} desc, forecast_date) as row_in_series,
                  count(*) over (partition by {S}) as n_rows
           from forecast_points)
select {S}, forecast_date, {U}, row_in_series from r
where ceil(row_in_series/10) = least(2, greatest(1, ceil(n_rows/10)))""")
def table_page(t):
    return an.table_page(fc.forecast_points(t, by_series=True), sort_key=U, ascending=False, page=2)


@register("forecast_search", f"""
select {S}, forecast_date, {U} from forecast_points
where contains(strftime(forecast_date, '%Y-%m-%d'), 'march 1')
   or contains(lower(strftime(forecast_date, '%B %-d, %Y')), lower('march 1'))""")
def forecast_search(t):
    q = "march 1"
    d = F.col("forecast_date")
    hit = (F.date_format(d, "yyyy-MM-dd").contains(q)
           | F.lower(F.date_format(d, "MMMM d, yyyy")).contains(q.lower()))
    return fc.forecast_points(t).where(hit).select(*fc.SERIES, "forecast_date", U)
