"""Artifact-driven feature resolution for scoring (serving_features).

A saved feature schema lists model inputs in order. Each input resolves to
the context column of the same name; otherwise ``category_<level>`` /
``region_<level>`` become 1.0 / 0.0 by token equality with the row's category
or region; anything else is missing. Rows with missing inputs carry the
names in ``missing_features`` (the caller rejects them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.names import feature_token


def resolve_feature(df: DataFrame, feature: str) -> Column:
    if feature == "units_sold":
        raise ValueError("units_sold cannot be a model input.")
    direct = F.col(feature).cast("double") if feature in df.columns else None
    for group in ("category", "region"):
        prefix = f"{group}_"
        if feature.startswith(prefix) and group in df.columns:
            want = feature_token(F.lit(feature[len(prefix):]))
            onehot = F.when(F.col(group).isNull(), F.lit(None).cast("double")).otherwise(
                (feature_token(F.col(group)) == want).cast("double"))
            return onehot if direct is None else F.coalesce(direct, onehot)
    return direct if direct is not None else F.lit(None).cast("double")


def check_schema(schema: dict) -> list[str]:
    """v18: feature_count = length, no duplicates, target not an input,
    selected features among the candidates. Returns the problems found."""
    order = list(schema.get("feature_order") or [])
    cands = list(schema.get("candidate_feature_order") or order)
    problems = []
    if schema.get("feature_count") != len(order):
        problems.append("Saved feature_count does not match feature_order.")
    if len(set(order)) != len(order):
        problems.append("feature_order has duplicates.")
    if "units_sold" in order or "units_sold" in cands:
        problems.append("units_sold cannot be a model input.")
    missing = sorted(set(order) - set(cands))
    if missing:
        problems.append(f"Selected features missing from candidates: {missing}")
    return problems


def serving_features(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys + one double column per feature (schema order) + missing_features."""
    cols = [resolve_feature(df, f).alias(f) for f in features]
    missing = F.array_compact(F.array(*[F.when(resolve_feature(df, f).isNull(), F.lit(f)) for f in features]))
    return df.select(*keys, *cols, missing.alias("missing_features"))
