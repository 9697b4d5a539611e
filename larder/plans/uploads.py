"""Upload onboarding plan: raw uploads -> cells -> profile -> mappings -> mapped cells.

All uploaded datasets are processed together: their cells are one long
DataFrame keyed by ``dataset_id``, so a single plan profiles, maps and
validates every dataset at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import mapping as mp
from larder.operators import profile as pf
from larder.operators import validate as vd
from larder.sources.tables import Tables

# (dataset_id, dataset_type, builder name) of the uploaded files.
UPLOADS = [("sales_upload", "sales", "sales_upload"),
           ("inventory_upload", "inventory", "inventory_upload"),
           ("products_upload", "products", "products_upload"),
           ("suppliers_upload", "suppliers", "suppliers_upload"),
           ("warehouse_upload", "warehouse", "warehouse_upload"),
           ("orders_upload", "sales", "orders_upload")]

# The user's mapping review left this column unconfirmed (exercises the
# missing-required-mapping rule).
UNCONFIRMED = [("products_upload", "product_name")]

# Constants the user gave for targets that a file does not hold:
# (dataset_id, dataset_type, target, value).
DEFAULT_MAPPINGS = [("products_upload", "products", "spoilage_sensitivity", "0.5")]

# The warehouse configured for a dataset; blank warehouse cells take it.
DATASET_WAREHOUSE = {"sales_upload": "7"}


def upload_frames(t: Tables) -> list[tuple[str, str, DataFrame]]:
    """The landed uploads: written once, read by profile, validation and ingestion."""
    return [(ds, dt, t._stored(f"landed_{ds}", getattr(t, b))) for ds, dt, b in UPLOADS]


def upload_frame(t: Tables, dataset_id: str) -> DataFrame:
    return next(df for ds, _, df in upload_frames(t) if ds == dataset_id)


def datasets(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(ds, dt, "uploaded") for ds, dt, _ in UPLOADS],
                                   "dataset_id string, dataset_type string, status string")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cells(t: Tables) -> DataFrame:
    return _union([pf.to_cells(df, ds, dt) for ds, dt, df in upload_frames(t)])


def column_profile(t: Tables) -> DataFrame:
    return pf.column_profile(cells(t))


def suggestions(t: Tables) -> DataFrame:
    cols = column_profile(t).select("dataset_id", "dataset_type", "source_column")
    return mp.mapping_suggest(cols)


def mappings(t: Tables) -> DataFrame:
    """Stored column mappings (datasets x columns), read by validation and ingestion."""
    def build():
        unconfirmed = t.spark.createDataFrame(UNCONFIRMED, "dataset_id string, source_column string")
        return mp.confirm(suggestions(t), unconfirmed).unionByName(mp.default_mappings(t.spark, DEFAULT_MAPPINGS))
    return t._stored("column_mappings", build)


def mapping_rows(t: Tables, dataset_id: str) -> list:
    """Stored mappings of one dataset: as many rows as it has columns."""
    return mappings(t).where(F.col("dataset_id") == dataset_id).collect()


def mapped_cells(t: Tables) -> DataFrame:
    """Cells under their mapped names: one generator pass over each landed upload."""
    parts = []
    for ds, dt, df in upload_frames(t):
        names, defaults = mp.column_names([c for c in df.columns if c != "source_row_number"], mapping_rows(t, ds))
        parts.append(pf.to_cells(df, ds, dt, names=names, defaults=defaults))
    return _union(parts)


def mapped_frame(t: Tables, dataset_id: str) -> DataFrame:
    """One landed upload under its mapped names (wide; a select)."""
    return mp.map_columns(upload_frame(t, dataset_id), mapping_rows(t, dataset_id))


def missing_required(t: Tables) -> DataFrame:
    return mp.missing_required(mappings(t), datasets(t))


def known_references(t: Tables) -> DataFrame:
    """(column, value) pairs of ids known to the catalogue."""
    return (t.products().select(F.lit("product_id").alias("column"), F.col("product_id").cast("string").alias("value"))
            .unionByName(t.suppliers().select(F.lit("supplier_id").alias("column"),
                                              F.col("supplier_id").cast("string").alias("value")))
            .unionByName(t.warehouses().select(F.lit("warehouse_id").alias("column"),
                                               F.col("warehouse_code").alias("value")))
            .unionByName(t.stores().select(F.lit("store_id").alias("column"),
                                           F.col("store_id").cast("string").alias("value"))))


def issues(t: Tables) -> DataFrame:
    """Every issue of every upload, stored once."""
    def build():
        dups = vd.duplicate_counts_from_wide([(ds, df) for ds, _, df in upload_frames(t)])
        expiry = vd.expiry_issues_wide(mapped_frame(t, "inventory_upload"), "inventory_upload")
        return vd.validate(mapped_cells(t), mappings(t), missing_required(t), known_references(t), dups, expiry)
    return t._stored("validation_issues", build)
