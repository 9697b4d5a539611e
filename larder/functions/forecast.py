"""Forecast-point expressions: scoring placeholder, rounding, bounds, prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.names import _col

# The nine inputs of the placeholder scorer, in weight order 1..9.
DEFAULT_FEATURES = [
    "shelf_life_days", "cost_price", "selling_price", "discount_pct", "is_promoted",
    "supplier_score", "storage_temp", "spoilage_sensitivity", "spoilage_risk",
]


def half_up(c) -> Column:
    """Round half up (the UI's Math.round): floor(x + 0.5)."""
    return F.floor(_col(c) + F.lit(0.5))


def default_feature(c) -> Column:
    """Numeric feature or 0.0 when missing (booleans become 1.0 / 0.0)."""
    return F.coalesce(_col(c).cast("double"), F.lit(0.0))


def placeholder_score(cols: list) -> Column:
    """10 + (|sum_i i * x_i| mod 490), weights 1..n; a labelled mock prediction."""
    weighted = None
    for i, c in enumerate(cols, start=1):
        term = F.lit(float(i)) * _col(c)
        weighted = term if weighted is None else weighted + term
    return F.greatest(F.lit(0.0), F.lit(10.0) + F.abs(weighted) % F.lit(490.0))


def round_units(c) -> Column:
    """max(0, round-half-even(x)) as an integer count."""
    return F.greatest(F.lit(0), F.bround(_col(c), 0).cast("bigint"))


def forecast_spread(predicted) -> Column:
    return half_up(F.lit(42.0) + _col(predicted) * F.lit(0.08)).cast("bigint")


def lower_bound(predicted) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), _col(predicted) - forecast_spread(predicted))


def upper_bound(predicted) -> Column:
    return _col(predicted) + forecast_spread(predicted)


def promo_window(day_index, horizon) -> Column:
    """Day index inside floor(0.25 h) .. floor(0.45 h), both ends included."""
    h = _col(horizon).cast("double")
    return _col(day_index).between(F.floor(h * 0.25), F.floor(h * 0.45))


def planned_price(price, discount_pct, promoted, day_index, horizon) -> Column:
    """Promotion-window price: round-half-up(price * (1 - pct/100)), else price."""
    cut = half_up(_col(price) * (F.lit(1.0) - _col(discount_pct) / F.lit(100.0))).cast("double")
    on = _col(promoted) & promo_window(day_index, horizon)
    return F.when(on, cut).otherwise(_col(price))


def demand_status(value, rounded_mean, peak) -> Column:
    """Peak / High (>= 1.15 mean) / Low (<= 0.85 mean) / Normal, first match wins."""
    v = _col(value)
    m = _col(rounded_mean)
    return (F.when(v == _col(peak), "Peak").when(v >= m * 1.15, "High")
            .when(v <= m * 0.85, "Low").otherwise("Normal"))


def stock_state(shortage, remaining, demand) -> Column:
    return (F.when(_col(shortage) > 0, "Stockout expected")
            .when(_col(remaining) < _col(demand) * 0.15, "Low stock risk")
            .otherwise("Sufficient stock"))
