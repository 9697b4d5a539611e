"""Forecast analytics over scored series and over their daily points.

A series is one (request, product, warehouse). Totals, summaries and stock
figures work on one row a series that holds its days as an array. Every window here is
partitioned by series, and a series holds at most the horizon (<= 90 days),
so no window partition can grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import forecast as ff
from larder.functions.aggregates import arg_max
from larder.operators.repeats import MARK, mark_of, repeated_marks
from larder.plans.forecast import SERIES

U = "predicted_units_sold"


def _series_window(order: str = "day_index"):
    return Window.partitionBy(*SERIES).orderBy(order)


def daily_units(scored: DataFrame) -> DataFrame:
    """One row a series with the predicted units of its days in order (the horizon bounds the array)."""
    return scored.withColumn("units", F.array_repeat(F.col(U), F.col("horizon_days")))


def _total(units) -> Column:
    return F.aggregate(units, F.lit(0).cast("bigint"), lambda run, u: run + u)


def weekly_totals(series: DataFrame) -> DataFrame:
    """Consecutive 7-day buckets from the series start; the last may be short. Weeks are cut inside the row: no shuffle."""
    start, days = F.col("forecast_start_date"), F.size("units")

    def week(w):
        return F.struct(w.alias("week_index"), F.date_add(start, w * 7).alias("week_start"),
                        F.date_add(start, F.least(w * 7 + 6, days - 1)).alias("week_end"), _total(F.slice("units", w * 7 + 1, 7)).alias("units"))

    weeks = F.transform(F.sequence(F.lit(0), F.floor((days - 1) / 7).cast("int")), week)
    return series.where(days > 0).select(*SERIES, F.inline(weeks))


def forecast_summary(series: DataFrame) -> DataFrame:
    """total, rounded mean, peak / lowest day (first on ties), trend %; all inside the series' row.

    Trend compares the mean of the last and the first max(1, floor(n/4)) days;
    a zero first-window mean gives null instead of a division by zero.
    """
    n = F.size("units")
    w = F.greatest(F.lit(1), F.floor(n / 4)).cast("int")
    first, last = _total(F.slice("units", F.lit(1), w)) / w, _total(F.slice("units", n - w + 1, w)) / w
    peak, low = F.array_max("units"), F.array_min("units")

    def day_of(value):
        return F.date_add("forecast_start_date", (F.array_position("units", value) - 1).cast("int"))

    return series.where(n > 0).select(
        *SERIES, n.cast("bigint").alias("n_days"), _total(F.col("units")).alias("total_units"),
        ff.half_up(_total(F.col("units")) / n).cast("bigint").alias("average_units"),
        day_of(peak).alias("peak_date"), peak.alias("peak_units"), day_of(low).alias("lowest_date"), low.alias("lowest_units"),
        ff.half_up((last - first) / F.nullif(first, F.lit(0.0)) * 100).cast("bigint").alias("trend_pct"))


def _days(series: DataFrame, entries: Column | None = None, *whole: Column) -> DataFrame:
    """A row for every day of each series' row, with day_index, forecast_date and the columns ``whole``.

    With ``entries``, an array worked out from the days' units, a day has its entry as ``_entry``, unless the series' days are
    all the same: then ``_same`` holds and ``_unit`` is the units of each, so nothing is worked out day by day inside the row."""
    units, dates = F.col("units"), F.sequence("forecast_start_date", F.date_add("forecast_start_date", F.col("horizon_days") - 1))
    kept = [F.col(c) for c in series.columns if c != "units"]
    if entries is not None:
        same = (F.size(units) == F.col("horizon_days")) & units.eqNullSafe(F.array_repeat(F.get(units, F.lit(0)), F.size(units)))
        kept += [F.coalesce(same, F.lit(False)).alias("_same"), F.get(units, F.lit(0)).alias("_unit"), *whole]
        dates = F.when(units.isNotNull(), dates)
    # What holds for the whole series is worked out in steps of their own: beside the generator it would be done again for every
    # day. The outer form keeps the planner from filtering the series by their days, which would work these out twice.
    ready = series.select(*kept, dates.alias("_dates"), *([] if entries is None else ["units"]))
    if entries is not None:
        ready = ready.withColumn("_path", F.when(~F.col("_same"), entries)).drop("units")
    rows = ready.select(*[c for c in ready.columns if c != "_dates"], F.posexplode_outer("_dates").alias("day_index", "forecast_date")).where("day_index is not null")
    return rows if entries is None else rows.withColumn("_entry", F.get("_path", F.col("day_index"))).drop("_path")


def _by_copies(series: DataFrame, inside, across) -> DataFrame:
    """Daily rows: ``inside`` for series of one row, from that row's own days; ``across`` for the daily rows of series that
    have several rows (or share their hash with another), whose figures run over all of them. No series or day of the first kind moves."""
    repeated, mark = repeated_marks(series, SERIES), mark_of(SERIES)
    if repeated.isEmpty():
        return inside(series)
    one = series.join(repeated, mark == F.col(MARK), "left_anti")
    more = series.join(repeated, mark == F.col(MARK), "left_semi")
    return inside(one).unionByName(across(_days(more)))


def projected_inventory(series: DataFrame) -> DataFrame:
    """Daily rows with the start stock minus the running sum of predicted demand, rounded."""
    start = F.coalesce(F.col("current_inventory"), F.lit(0.0))

    def step(state, u):
        run = state["run"] + u
        return F.struct(run.alias("run"), F.concat(state["path"], F.array(run)).alias("path"))

    def inside(one):
        begin = F.struct(F.lit(0).cast("bigint").alias("run"), F.array().cast("array<bigint>").alias("path"))
        rows = _days(one, F.aggregate("units", begin, step)["path"])
        run = F.when(F.col("_same"), F.col("_unit") * (F.col("day_index") + 1)).otherwise(F.col("_entry"))
        return rows.withColumn("_run", run).drop("_same", "_unit", "_entry")

    def across(points):
        return points.withColumn("_run", F.sum(U).over(_series_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    rows = _by_copies(series, inside, across)
    return rows.withColumn("projected_inventory", ff.half_up(start - F.col("_run")).cast("bigint")).drop("_run")


def inventory_impact(series: DataFrame) -> DataFrame:
    """demand, remaining, first stock-out date, shortage and reorder size per series.

    Stock comes from the latest inventory snapshot (0 when there is none). The running
    stock is a fold over the row's own days: no explode, sort, window or aggregation.
    """
    stock = F.coalesce(F.col("current_inventory"), F.lit(0.0))
    incoming = F.coalesce(F.col("incoming_inventory"), F.lit(0.0))

    def step(state, u):
        run = state["run"] + u
        short = ff.half_up(stock - run).cast("bigint") + incoming < 0
        return F.struct(run.alias("run"), (state["day"] + 1).alias("day"), F.coalesce(state["out"], F.when(short, state["day"])).alias("out"))

    begin = F.struct(F.lit(0).cast("bigint").alias("run"), F.lit(0).alias("day"), F.lit(None).cast("int").alias("out"))
    g = series.withColumn("_path", F.aggregate("units", begin, step)).select(
        *SERIES, stock.alias("current_inventory"), incoming.alias("incoming_inventory"), F.col("_path.run").alias("demand"),
        F.date_add("forecast_start_date", F.col("_path.out")).alias("stockout_date"))
    remaining = F.col("current_inventory") + F.col("incoming_inventory") - F.col("demand")
    shortage = F.greatest(F.lit(0.0), -F.col("remaining"))
    return (g.withColumn("remaining", remaining)
            .withColumn("shortage", shortage)
            .withColumn("reorder", F.greatest(F.lit(0.0), F.col("shortage") + ff.half_up(F.col("demand") * 0.15)))
            .withColumn("stock_state", ff.stock_state("shortage", "remaining", "demand")))


def peak_window(points: DataFrame) -> DataFrame:
    """From 3 days before the peak to the peak, clipped at the series start."""
    g = points.groupBy(*SERIES).agg(
        F.min("forecast_date").alias("series_start"),
        arg_max(F.col("forecast_date"), [F.col(U), -F.col("day_index")]).alias("peak_date"))
    return g.select(*SERIES, F.greatest("series_start", F.date_sub("peak_date", 3)).alias("window_start"),
                    "peak_date")


def demand_status(series: DataFrame) -> DataFrame:
    """Per day: Peak / High / Low / Normal against the rounded series mean."""
    def inside(one):
        mean = ff.half_up(_total(F.col("units")) / F.size("units")).cast("bigint")
        rows = _days(one, F.col("units"), mean.alias("series_mean"), F.array_max("units").alias("series_peak"))
        return rows.withColumn("_unit", F.when(F.col("_same"), F.col("_unit")).otherwise(F.col("_entry"))).drop("_same", "_entry")

    def across(points):
        w = Window.partitionBy(*SERIES)
        return (points.withColumn("series_mean", ff.half_up(F.sum(U).over(w) / F.count(F.lit(1)).over(w)).cast("bigint"))
                .withColumn("series_peak", F.max(U).over(w)).withColumn("_unit", F.col(U)))

    return _by_copies(series, inside, across).select(
        *SERIES, "forecast_date", F.col("_unit").alias(U), ff.demand_status("_unit", "series_mean", "series_peak").alias("demand_status"))


def stockout_date(series: DataFrame) -> DataFrame:
    return inventory_impact(series).select(*SERIES, "stockout_date")


def forecast_export(series: DataFrame) -> DataFrame:
    """The 8-column daily export (plus series keys): price plan and stock path."""
    proj = projected_inventory(series)
    promoted = F.coalesce(F.col("is_promoted"), F.lit(False)) & ff.promo_window("day_index", "horizon_days")
    pct = F.coalesce(F.col("discount_pct"), F.lit(0.0)) * 100
    return proj.select(
        *SERIES,
        F.col("forecast_date").cast("string").alias("date"),
        U, ff.lower_bound(U).alias("lower_bound"), ff.upper_bound(U).alias("upper_bound"),
        ff.planned_price("selling_price", pct, F.coalesce(F.col("is_promoted"), F.lit(False)),
                         "day_index", "horizon_days").alias("planned_selling_price"),
        F.when(promoted, pct).otherwise(F.lit(0.0)).alias("discount_pct"),
        promoted.alias("is_promoted"),
        "projected_inventory")


def table_page(points: DataFrame, sort_key: str = U, ascending: bool = False, page: int = 1,
               page_size: int = 10) -> DataFrame:
    """One page of each series' daily table; stable sort (ties keep date order),
    requested page clamped to the last page."""
    key = F.col(sort_key) if ascending else F.col(sort_key).desc()
    w = Window.partitionBy(*SERIES).orderBy(key, F.col("forecast_date"))
    ranked = (points.withColumn("row_in_series", F.row_number().over(w))
              .withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy(*SERIES))))
    last_page = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / page_size))
    shown = F.least(F.lit(page), last_page)
    row_page = F.ceil(F.col("row_in_series") / page_size)
    return ranked.where(row_page == shown).select(*SERIES, "forecast_date", U, "row_in_series")
