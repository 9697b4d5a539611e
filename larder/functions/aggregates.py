"""Aggregate helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def arg_max(value: Column, order: list[Column]) -> Column:
    """Value of the row with the greatest ``order`` tuple, as ``max(struct(order, value))``.

    Same result as ``max_by(value, struct(order))`` for a unique order tuple,
    but a plain ``max`` over a struct runs as a faster aggregation than
    ``max_by`` with struct arguments. Nulls in ``order`` sort first.
    """
    packed = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], value.alias("_v"))
    return F.max(packed)["_v"]


def arg_min(value: Column, order: list[Column]) -> Column:
    packed = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], value.alias("_v"))
    return F.min(packed)["_v"]
