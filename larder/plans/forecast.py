"""Prediction requests -> context -> horizon rows -> scores, as one plan.

Mirrors the request flow of the forecasting backend, but for every request at
once: dimension look-ups are joins, the two "latest record" look-ups are
as-of operators, and the per-day loop is ``posexplode(sequence(...))``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import forecast as ff
from larder.functions.parsing import to_number
from larder.operators.asof import Facts, latest_asof_each
from larder.operators.scorers import ExpressionScorer, Scorer
from larder.sources.tables import Tables

SERIES = ["request_id", "product_id", "warehouse_id"]

SALE_VALUES = ["source_row_number", "transaction_date", "units_sold", "selling_price",
               "discount_pct", "is_promoted", "spoilage_risk"]
INVENTORY_VALUES = ["source_row_number", "snapshot_date", "current_inventory",
                    "incoming_inventory", "spoilage_risk"]


#: What the context takes from a sale and from a snapshot.
CONTEXT_SALE = ["selling_price", "discount_pct", "is_promoted", "spoilage_risk"]
CONTEXT_INVENTORY = ["current_inventory", "incoming_inventory", "spoilage_risk"]

#: Series in a file of the stored context: each is up to 90 daily rows to whoever reads it.
SERIES_ROWS = 1 << 18


def sale_facts(t: Tables, values: list[str] = SALE_VALUES) -> Facts:
    return Facts(t.sales_records(), "transaction_date", values, ["source_row_number"], ["store_id"], alias="sale")


def inventory_facts(t: Tables, values: list[str] = INVENTORY_VALUES) -> Facts:
    return Facts(t.inventory_snapshots(), "snapshot_date", values, ["source_row_number"], alias="inv")


def with_latest_sale(t: Tables, requests: DataFrame | None = None, values: list[str] = SALE_VALUES) -> DataFrame:
    """latest_sale_asof: newest sale on or before the start date, same product and
    warehouse, and the same store when the request names one."""
    req = requests if requests is not None else t.forecast_requests()
    return latest_asof_each(req, [sale_facts(t, values)], keys=["product_id", "warehouse_id"], request_date="forecast_start_date")


def with_latest_inventory(t: Tables, requests: DataFrame, values: list[str] = INVENTORY_VALUES) -> DataFrame:
    """latest_inventory_asof: newest snapshot on or before the start date."""
    return latest_asof_each(requests, [inventory_facts(t, values)], keys=["product_id", "warehouse_id"], request_date="forecast_start_date")


def forecast_context(t: Tables, requests: DataFrame | None = None) -> DataFrame:
    """Per series: product, supplier, region and latest sale / inventory fields.

    Region: the store's when it has one, else the warehouse's. Discount and
    promotion fall back to 0 / false only when there is no sale at all; a sale
    with a null discount keeps the null. Spoilage risk: sale, then inventory.
    """
    if requests is None:  # the context of all stored requests is itself stored: every query reads it
        return t._stored("forecast_context", lambda: _context(t, t.forecast_requests()), SERIES_ROWS)
    return _context(t, requests)


def _context(t: Tables, req: DataFrame) -> DataFrame:
    # Both look-ups of with_latest_sale and with_latest_inventory in one pass: the requests move once.
    ctx = latest_asof_each(req, [sale_facts(t, CONTEXT_SALE), inventory_facts(t, CONTEXT_INVENTORY)],
                           keys=["product_id", "warehouse_id"], request_date="forecast_start_date")
    prod = t.products().select("product_id", "category", "supplier_id", "shelf_life_days",
                               "cost_price", "spoilage_sensitivity", "storage_temp")
    sup = t.suppliers().select("supplier_id", "supplier_score")
    wh = t.warehouses().select("warehouse_id", F.col("region").alias("warehouse_region"))
    st = t.stores().select("store_id", F.col("region").alias("store_region"))
    j = (ctx.join(prod, "product_id", "left")
         .join(sup, "supplier_id", "left")
         .join(wh, "warehouse_id", "left")
         .join(st, "store_id", "left"))
    has_sale = F.col("sale").isNotNull()
    return j.select(
        *SERIES, "store_id", "forecast_start_date", "horizon_days",
        "shelf_life_days", "cost_price", "spoilage_sensitivity", "storage_temp", "category",
        "supplier_score",
        F.coalesce("store_region", "warehouse_region").alias("region"),
        F.col("sale.selling_price").alias("selling_price"),
        F.when(has_sale, F.col("sale.discount_pct")).otherwise(F.lit(0.0)).alias("discount_pct"),
        F.when(has_sale, F.col("sale.is_promoted")).otherwise(F.lit(False)).alias("is_promoted"),
        F.coalesce(F.col("sale.spoilage_risk"), F.col("inv.spoilage_risk")).alias("spoilage_risk"),
        F.col("inv.current_inventory").alias("current_inventory"),
        F.col("inv.incoming_inventory").alias("incoming_inventory"))


#: Stand-in scorer over the context's own columns, missing ones as 0; flagged as a mock.
PLACEHOLDER = ExpressionScorer("placeholder", "1", list(ff.DEFAULT_FEATURES),
                               lambda _: ff.placeholder_score([ff.default_feature(c) for c in ff.DEFAULT_FEATURES]), is_mock=True)


def score_context(ctx: DataFrame, scorer: Scorer = PLACEHOLDER) -> DataFrame:
    """A scorer's prediction as whole units, once per series."""
    return scorer.transform(ctx, "_raw").withColumn("predicted_units_sold", ff.round_units(F.col("_raw"))).drop("_raw")


def horizon_rows(df: DataFrame, start: str = "forecast_start_date", horizon: str = "horizon_days") -> DataFrame:
    """product_date_cross / horizon_dates: one row per day start .. start + h - 1.

    ``posexplode`` runs inside the producing task: no shuffle.
    """
    days = F.sequence(F.col(start), F.date_add(F.col(start), F.col(horizon) - 1))
    return df.select("*", F.posexplode(days).alias("day_index", "forecast_date"))


def scored_series(t: Tables, requests: DataFrame | None = None, scorer: Scorer = PLACEHOLDER) -> DataFrame:
    """One row a series: scored context with the predicted units of its days as an array."""
    from larder.plans.analytics import daily_units
    return daily_units(score_context(forecast_context(t, requests), scorer))


def forecast_points(t: Tables, requests: DataFrame | None = None, by_series: bool = False) -> DataFrame:
    """All forecast points with the context carried along (for analytics).

    ``by_series`` deals the narrow scored context by series before the horizon
    rows are generated: the generator keeps the partitioning, so windows and
    aggregations by series need no exchange of the many rows after it.
    """
    scored = score_context(forecast_context(t, requests))
    rows = horizon_rows(scored.repartition(*SERIES) if by_series else scored)
    return rows.withColumn("lower_bound", ff.lower_bound("predicted_units_sold")) \
               .withColumn("upper_bound", ff.upper_bound("predicted_units_sold"))


def apply_overrides(ctx: DataFrame, overrides: DataFrame) -> DataFrame:
    """Context after scenario overrides (request_id, overrides map): a key that is present wins,
    else the sale / inventory / default fallbacks of the context stand."""
    def given(k: str):
        return F.element_at("overrides", F.lit(k))

    def number(k: str):
        return F.when(given(k).isNotNull(), to_number(given(k))).otherwise(F.col(k)).alias(k)

    changed = {k: number(k) for k in ("selling_price", "discount_pct", "spoilage_risk")}
    changed["is_promoted"] = F.when(given("is_promoted").isNotNull(), F.lower(given("is_promoted")) == "true").otherwise(
        F.col("is_promoted")).alias("is_promoted")
    return ctx.join(overrides, "request_id").select(*[changed.get(c, F.col(c)) for c in ctx.columns])


def forecast_run(t: Tables, jobs: DataFrame, overrides: DataFrame, scorer: Scorer = PLACEHOLDER) -> DataFrame:
    """The forecast_results table: contexts of completed jobs under their overrides, scored
    by the given scorer (mocks are flagged), one row per day of the horizon."""
    done = jobs.where("status = 'completed'").select("request_id")
    scored = score_context(apply_overrides(forecast_context(t).join(done, "request_id", "left_semi"), overrides), scorer)
    pts = horizon_rows(scored).withColumn("lower_bound", ff.lower_bound("predicted_units_sold")) \
                              .withColumn("upper_bound", ff.upper_bound("predicted_units_sold"))
    return pts.select(*SERIES, "store_id", "forecast_date", "predicted_units_sold",
                      "lower_bound", "upper_bound", F.lit(scorer.is_mock).alias("is_mock"))
