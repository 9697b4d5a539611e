"""Feature operators: calendar, cyclical time, stock-out arrays, daily-series
lags / rolling statistics, promotion streaks, one-hot encoding, scaling.

Daily-series features never gap-fill a calendar: lags and rolling figures are
RANGE windows over day numbers that share one sort, with missing days counting
as zero units. A series' window partition holds at most
one row per sale day.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.names import category_token


def cyclical_time(ts: Column) -> list[Column]:
    """hour, day_of_week (Mon=0), day, month and their sin/cos (periods 24, 7, 31, 12)."""
    parts = [("hour", F.hour(ts), 24), ("day_of_week", F.weekday(ts), 7),
             ("day", F.dayofmonth(ts), 31), ("month", F.month(ts), 12)]
    out = []
    for name, expr, period in parts:
        angle = F.lit(2 * math.pi) * expr / F.lit(float(period))
        out += [expr.alias(name), F.round(F.sin(angle), 9).alias(f"{name}_sin"),
                F.round(F.cos(angle), 9).alias(f"{name}_cos")]
    return out


def calendar_features(d: Column, expiry: Column | None = None) -> list[Column]:
    dow = F.weekday(d)
    out = [dow.alias("day_of_week"), (dow >= 5).cast("int").alias("is_weekend"), F.month(d).alias("month"),
           F.quarter(d).alias("quarter"), F.weekofyear(d).alias("week_of_year")]
    if expiry is not None:
        out.append(F.datediff(expiry, d).alias("days_until_expiry"))
    return out


def stockout_features(arr: Column) -> list[Column]:
    """From a 24-slot 0/1 stock-out array: hours, ratio, longest run, first and
    last stock-out hour (-1 if none), stock-out hours in business slots 8..17."""
    ones = F.aggregate(arr, F.lit(0), lambda acc, x: acc + x)
    runs = F.transform(F.split(F.array_join(arr.cast("array<string>"), ""), "0"), lambda s: F.length(s))
    first = F.array_position(arr, 1)
    last = F.array_position(F.reverse(arr), 1)
    return [ones.alias("stockout_hours"),
            F.round(ones / 24.0, 9).alias("stockout_ratio"),
            F.array_max(runs).alias("longest_stockout_run"),
            F.when(first > 0, first - 1).otherwise(-1).cast("int").alias("first_stockout_hour"),
            F.when(last > 0, 24 - last).otherwise(-1).cast("int").alias("last_stockout_hour"),
            F.aggregate(F.slice(arr, 9, 10), F.lit(0), lambda acc, x: acc + x).alias("business_stockout_hours")]


def daily_series(sales: DataFrame, keys: list[str], date: str = "transaction_date") -> DataFrame:
    """Per (series, day): units, mean price, promoted flag; partial aggregation."""
    return sales.groupBy(*keys, F.col(date).alias("day")).agg(
        F.sum("units_sold").alias("units"), F.avg("selling_price").alias("price"),
        F.max(F.col("is_promoted").cast("int")).alias("promoted"))


def lag_features(daily: DataFrame, keys: list[str], lags=(7, 14, 30)) -> DataFrame:
    """units k calendar days earlier (0 when that day had no sale)."""
    out = daily.withColumn("_dn", F.datediff("day", F.lit("1970-01-01")).cast("long"))
    for k in lags:
        that_day = Window.partitionBy(*keys).orderBy("_dn").rangeBetween(-k, -k)
        out = out.withColumn(f"lag_{k}", F.coalesce(F.sum("units").over(that_day), F.lit(0.0)))
    return out.drop("_dn")


def rolling_features(daily: DataFrame, keys: list[str]) -> DataFrame:
    """rolling_mean_7, rolling_mean_30, rolling_std_30 over the previous days
    (current day excluded), missing days as zero units; plus the coefficient
    of variation (demand_variability)."""
    dn = F.datediff("day", F.lit("1970-01-01")).cast("long")
    x = daily.withColumn("_dn", dn)

    def frame(n):
        return Window.partitionBy(*keys).orderBy("_dn").rangeBetween(-n, -1)

    s7 = F.coalesce(F.sum("units").over(frame(7)), F.lit(0.0))
    s30 = F.coalesce(F.sum("units").over(frame(30)), F.lit(0.0))
    # Variance around the 30-day mean from the sale days' own variance and the zero days,
    # without the difference of two large sums.
    m30, v30 = F.count("units").over(frame(30)), F.coalesce(F.var_pop("units").over(frame(30)), F.lit(0.0))
    mean, own = F.col("_s30") / 30.0, F.col("_s30") / F.greatest(F.col("_m30"), F.lit(1))
    var30 = (F.col("_m30") * (F.col("_v30") + (own - mean) * (own - mean)) + (30 - F.col("_m30")) * mean * mean) / 29.0
    out = (x.withColumn("_s7", s7).withColumn("_s30", s30).withColumn("_m30", m30).withColumn("_v30", v30)
           .withColumn("rolling_mean_7", F.round(F.col("_s7") / 7.0, 6))
           .withColumn("rolling_mean_30", F.round(F.col("_s30") / 30.0, 6))
           .withColumn("rolling_std_30", F.round(F.sqrt(F.greatest(F.lit(0.0), var30)), 6)))
    cv = F.col("rolling_std_30") / F.nullif(F.col("rolling_mean_30"), F.lit(0.0))
    return out.withColumn("demand_variability", F.round(cv, 6)).drop("_dn", "_s7", "_s30", "_m30", "_v30")


def price_change_pct(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Change against the previous sale day's price of the series, in %."""
    w = Window.partitionBy(*keys).orderBy("day")
    prev = F.lag("price").over(w)
    return daily.withColumn("price_change_pct", F.round((F.col("price") - prev) / F.nullif(prev, F.lit(0.0)) * 100, 6))


def promotion_duration(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Days in the running promotion streak (consecutive calendar days promoted).

    Gaps and islands: a new island starts when a day is not promoted or the
    previous promoted day is not yesterday; a running count within the island.
    """
    w = Window.partitionBy(*keys).orderBy("day")
    prev_day = F.lag("day").over(w)
    prev_promo = F.lag("promoted").over(w)
    starts = ((F.col("promoted") == 0) | (prev_promo.isNull()) | (prev_promo == 0)
              | (F.datediff("day", prev_day) != 1)).cast("int")
    x = daily.withColumn("_start", starts)
    x = x.withColumn("_island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    wi = Window.partitionBy(*keys, "_island").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    streak = F.when(F.col("promoted") == 1, F.count(F.lit(1)).over(wi)).otherwise(0)
    return x.withColumn("promotion_duration", streak).drop("_start", "_island")


def one_hot_vocabulary(df: DataFrame, groups: list[str]) -> DataFrame:
    """Training vocabulary: sorted distinct tokens per group; null -> __MISSING__."""
    parts = []
    for g in groups:
        # A token is made once a raw value, not once a row; two distincts in a row would be planned as one, counted values are not.
        values = df.groupBy(g).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
        parts.append(values.select(F.lit(g).alias("group"), group_token(g).alias("level")).distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("feature", F.concat_ws("_", "group", "level"))


def group_token(group: str) -> Column:
    """Token of a category column, null as its own level."""
    return F.when(F.col(group).isNull(), F.lit("__MISSING__")).otherwise(category_token(F.col(group)))


def one_hot_long(df: DataFrame, id_col: str, groups: list[str], vocabulary: DataFrame) -> DataFrame:
    """Sparse one-hot rows (id, feature, value = 1.0): one per row and group whose token is in
    ``vocabulary`` (group, level, feature); unknown tokens have no row, which means all zeros."""
    entries = F.array(*[F.struct(F.lit(g).alias("group"), group_token(g).alias("level")) for g in groups])
    return df.select(id_col, F.inline(entries)).join(vocabulary, ["group", "level"]).select(
        id_col, "feature", F.lit(1.0).alias("value"))


def min_max_scale(x: Column, lo: Column, hi: Column) -> Column:
    """(x - min) / (max - min); 0 for a constant column; no clipping."""
    return F.when(hi == lo, F.lit(0.0)).otherwise((x - lo) / (hi - lo))


def min_max_inverse(z: Column, lo: Column, hi: Column) -> Column:
    return z * (hi - lo) + lo


def interaction_features() -> list[Column]:
    """Products of discount, calendar and weather columns with stock-out measures, and the weekend flag."""
    def product(a: str, b: str, name: str) -> Column:
        return F.round(F.col(a) * F.col(b), 9).alias(name)

    return [product("discount", "stockout_ratio", "discount_stockout_ratio"),
            product("discount", "stock_hour6_22_cnt", "discount_stock_hour6_22_cnt"),
            product("discount", "business_stockout", "discount_business_stockout"),
            product("holiday_flag", "stockout_ratio", "holiday_stockout_ratio"),
            product("activity_flag", "stockout_ratio", "activity_stockout_ratio"),
            product("precpt", "avg_humidity", "bad_weather"), (F.col("day_of_week") >= 5).cast("int").alias("is_weekend")]


def drop_columns(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """The frame without the named columns, and the names that it did not have."""
    absent = [n for n in names if n not in df.columns]
    return df.drop(*[n for n in names if n in df.columns]), absent
