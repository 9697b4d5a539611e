"""Ingestion of mapped uploads into canonical tables, with row rejects.

The per-row remote look-ups of a web backend become joins on the narrow key
columns, sized by AQE. Rows stay wide from the upload to the canonical table:
mapping is a select and the columns that are not canonical are packed into one
JSON object per row, so nothing is exploded and gathered again. Every row gets
a ``reject_reason`` (first failing check: look-ups, parsing, then the rules of
the canonical table); good and bad rows are two filters of one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.parsing import boolean_reject, parse_boolean, parse_date, required_text, to_number
from larder.operators.mapping import TARGET_FIELDS, fields_of

CANONICAL_FIELDS = sorted({f for _, f, _ in TARGET_FIELDS})
FAILURE_SAMPLE_LIMIT = 20

# ---------------------------------------------------------------------------
# Warehouse types of the canonical table, numeric columns that
# may not be negative, and the reject messages (also used by the SQL oracle).
WAREHOUSE_TYPES = ["ambient", "chilled", "frozen", "mixed"]
DEFAULT_TIMEZONE = "UTC"
NON_NEGATIVE = {
    "sales": ["units_sold", "selling_price", "spoilage_risk"],
    "inventory": ["current_inventory", "reserved_inventory", "incoming_inventory", "spoilage_risk"],
    "products": ["shelf_life_days", "spoilage_sensitivity", "base_price", "cost_price"],
    "suppliers": ["lead_time_days", "minimum_order_quantity"],
    "warehouse": ["storage_capacity"],
}
NUMBERS = {
    "sales": ["units_sold", "selling_price", "discount_pct", "spoilage_risk"],
    "inventory": ["current_inventory", "reserved_inventory", "incoming_inventory", "spoilage_risk"],
    "products": ["shelf_life_days", "storage_temp", "spoilage_sensitivity", "base_price", "cost_price"],
    "suppliers": ["supplier_score", "lead_time_days", "minimum_order_quantity"],
    "warehouse": ["storage_capacity"],
}
IS_REQUIRED = "{} is required."
IS_NEGATIVE = "{} must not be negative."
UNKNOWN_ID = "Unknown {}."
NO_DEFAULT_WAREHOUSE = "Configured warehouse is unavailable."
BAD_DATE = "{} is not a valid date."
BAD_DISCOUNT = "discount_pct must be between 0 and 1."
BAD_EXPIRY = "expiration_date is before snapshot_date."
BAD_TYPE = "warehouse_type is not known."
# ---------------------------------------------------------------------------


def conform(frame: DataFrame, dataset_id: str, dataset_type: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """A mapped wide upload as (dataset_id, source_row_number, fields of its type, extras, carried columns).

    Fields that the upload lacks are null; columns outside the canonical and ``carried``
    ones become the JSON object ``extras``, in file order.
    """
    others = [c for c in frame.columns if c not in CANONICAL_FIELDS and c != "source_row_number" and c not in carried]
    extras = F.to_json(F.create_map(*[x for c in others for x in (F.lit(c), F.col(f"`{c}`"))])) if others else F.lit("{}")
    fields = [(F.col(f) if f in frame.columns else F.lit(None).cast("string")).alias(f) for f in fields_of(dataset_type)]
    return frame.select(F.lit(dataset_id).alias("dataset_id"), "source_row_number", *fields, extras.alias("extras"), *carried)


def _parsed(rows: DataFrame, dataset_type: str, **more) -> DataFrame:
    """Rows with every numeric column of the type parsed once, as ``_n_<name>``, and further parsed columns.

    The values, the rejects and the rules of the table read these: a cell is not parsed again for each of them."""
    return rows.withColumns({**{f"_n_{c}": to_number(c) for c in NUMBERS[dataset_type]}, **more})


def _numbers(dataset_type: str) -> list:
    """Numeric columns of a type, parsed."""
    return [F.col(f"_n_{c}").alias(c) for c in NUMBERS[dataset_type]]


def _number_rejects(dataset_type: str) -> list:
    return [F.when(F.col(c).isNotNull() & F.col(f"_n_{c}").isNull(), F.lit(f"{c} is not numeric.")) for c in NUMBERS[dataset_type]]


def _negative_rejects(dataset_type: str) -> list:
    return [F.when(F.col(f"_n_{c}") < 0, F.lit(IS_NEGATIVE.format(c))) for c in NON_NEGATIVE[dataset_type]]


def resolve_product(rows: DataFrame, products: DataFrame) -> DataFrame:
    """product external id -> product key; blank -> required, unknown -> reject."""
    p = products.select(F.col("product_id").cast("string").alias("_pext"), F.col("product_id").alias("_pkey"))
    r = rows.withColumn("_pid", required_text("product_id"))
    return r.join(p, F.col("_pid") == F.col("_pext"), "left").withColumn(
        "_product_reject",
        F.when(F.col("_pid").isNull(), F.lit(IS_REQUIRED.format("product_id")))
         .when(F.col("_pkey").isNull(), F.lit(UNKNOWN_ID.format("product_id"))))


def resolve_warehouse(rows: DataFrame, warehouses: DataFrame, default_id: str | None = None) -> DataFrame:
    """Value equal to a warehouse key -> that warehouse; else match by code;
    blank -> the dataset's configured warehouse, if any; anything else -> reject."""
    by_id = warehouses.select(F.col("warehouse_id").cast("string").alias("_wid_txt"), F.col("warehouse_id").alias("_wkey_id"))
    by_code = warehouses.select(F.col("warehouse_code").alias("_wcode"), F.col("warehouse_id").alias("_wkey_code"))
    w = F.trim(F.col("warehouse_id"))
    given = F.when(F.length(w) > 0, w)
    r = (rows.withColumn("_wgiven", given.isNotNull()).withColumn("_wval", F.coalesce(given, F.lit(default_id).cast("string")))
         .join(by_id, F.col("_wval") == F.col("_wid_txt"), "left")
         .join(by_code, F.col("_wval") == F.col("_wcode"), "left"))
    unknown = F.when(F.col("_wgiven"), F.lit(UNKNOWN_ID.format("warehouse_id"))).otherwise(F.lit(NO_DEFAULT_WAREHOUSE))
    return (r.withColumn("_wkey", F.coalesce("_wkey_id", "_wkey_code"))
            .withColumn("_warehouse_reject", F.when(F.col("_wval").isNotNull() & F.col("_wkey").isNull(), unknown)))


def resolve_store(rows: DataFrame, stores: DataFrame) -> DataFrame:
    """External store id -> store key; unknown ids are new stores (created)."""
    s = stores.select(F.col("store_id").cast("string").alias("_sext"), F.col("store_id").alias("_skey"))
    v = F.trim(F.col("store_id"))
    r = rows.withColumn("_sval", F.when(F.length(v) > 0, v))
    r = r.join(s, F.col("_sval") == F.col("_sext"), "left")
    return r.withColumn("store_created", F.col("_sval").isNotNull() & F.col("_skey").isNull())


def new_stores(sales: DataFrame) -> DataFrame:
    """resolve_or_create_store: distinct unknown store ids of ingested sales rows
    become store rows (named after the id, attached to the lowest warehouse
    seen with them). A partial aggregation on the id."""
    created = sales.where("store_created").groupBy("store_id").agg(F.min("warehouse_id").alias("warehouse_id"))
    return created.select(F.col("store_id").alias("external_store_id"), "warehouse_id",
                          F.col("store_id").alias("store_name"), F.lit(True).alias("generated"))


def ingest_sales(rows: DataFrame, products: DataFrame, warehouses: DataFrame, stores: DataFrame,
                 default_warehouse: str | None = None, earlier: str | None = None) -> DataFrame:
    """Sales rows; ``earlier`` names a column with the reject of an earlier step, which comes first."""
    r = resolve_store(resolve_warehouse(resolve_product(rows, products), warehouses, default_warehouse), stores)
    r, tdate = _parsed(r, "sales", _tdate=parse_date("transaction_date")), F.col("_tdate")
    reject = F.coalesce(
        *([F.col(earlier)] if earlier else []), F.col("_product_reject"), F.col("_warehouse_reject"),
        F.when(tdate.isNull(), F.lit(BAD_DATE.format("transaction_date"))), *_number_rejects("sales"),
        boolean_reject("is_promoted", "is_promoted"),
        F.when(F.col("units_sold").isNull(), F.lit(IS_REQUIRED.format("units_sold"))), *_negative_rejects("sales"),
        F.when(~F.col("_n_discount_pct").between(0, 1), F.lit(BAD_DISCOUNT)))
    return r.select(
        "dataset_id", "source_row_number", F.col("_pkey").alias("product_id"),
        F.coalesce(F.col("_skey").cast("string"), F.col("_sval")).alias("store_id"), "store_created",
        F.col("_wkey").alias("warehouse_id"), tdate.alias("transaction_date"),
        parse_boolean("is_promoted").alias("is_promoted"), *_numbers("sales"), "extras", reject.alias("reject_reason"))


def ingest_inventory(rows: DataFrame, products: DataFrame, warehouses: DataFrame,
                     default_warehouse: str | None = None) -> DataFrame:
    r = resolve_warehouse(resolve_product(rows, products), warehouses, default_warehouse)
    r = _parsed(r, "inventory", _sdate=parse_date("snapshot_date"), _edate=parse_date("expiration_date"))
    sdate, edate = F.col("_sdate"), F.col("_edate")
    reject = F.coalesce(
        F.col("_product_reject"), F.col("_warehouse_reject"),
        F.when(F.col("_wkey").isNull(), F.lit(IS_REQUIRED.format("warehouse_id"))),
        F.when(sdate.isNull(), F.lit(BAD_DATE.format("snapshot_date"))),
        F.when(F.col("expiration_date").isNotNull() & edate.isNull(), F.lit(BAD_DATE.format("expiration_date"))),
        *_number_rejects("inventory"),
        F.when(F.col("current_inventory").isNull(), F.lit(IS_REQUIRED.format("current_inventory"))),
        *_negative_rejects("inventory"), F.when(edate < sdate, F.lit(BAD_EXPIRY)))
    return r.select(
        "dataset_id", "source_row_number", F.col("_pkey").alias("product_id"), F.col("_wkey").alias("warehouse_id"),
        sdate.alias("snapshot_date"), edate.alias("expiration_date"), "batch_id", *_numbers("inventory"), "extras",
        reject.alias("reject_reason"))


def ingest_products(rows: DataFrame, suppliers: DataFrame) -> DataFrame:
    """product rows: required id and name; supplier optional but must exist."""
    s = suppliers.select(F.col("supplier_id").cast("string").alias("_sup_ext"), F.col("supplier_id").alias("_sup_key"))
    sv = F.trim(F.col("supplier_id"))
    r = rows.withColumn("_supv", F.when(F.length(sv) > 0, sv)).join(s, F.col("_supv") == F.col("_sup_ext"), "left")
    r = _parsed(r, "products")
    pid, name = required_text("product_id"), required_text("product_name")
    reject = F.coalesce(
        F.when(pid.isNull(), F.lit(IS_REQUIRED.format("product_id"))),
        F.when(F.col("_supv").isNotNull() & F.col("_sup_key").isNull(), F.lit(UNKNOWN_ID.format("supplier_id"))),
        F.when(name.isNull(), F.lit(IS_REQUIRED.format("product_name"))),
        *_number_rejects("products"), *_negative_rejects("products"))
    return r.select(
        "dataset_id", "source_row_number", pid.alias("external_product_id"), name.alias("product_name"), "category",
        F.col("_sup_key").alias("supplier_id"), *_numbers("products"), "extras", reject.alias("reject_reason"))


def ingest_suppliers(rows: DataFrame) -> DataFrame:
    rows = _parsed(rows, "suppliers")
    sid, name = required_text("supplier_id"), required_text("supplier_name")
    reject = F.coalesce(
        F.when(sid.isNull(), F.lit(IS_REQUIRED.format("supplier_id"))),
        F.when(name.isNull(), F.lit(IS_REQUIRED.format("supplier_name"))),
        *_number_rejects("suppliers"), *_negative_rejects("suppliers"))
    return rows.select(
        "dataset_id", "source_row_number", sid.alias("external_supplier_id"), name.alias("supplier_name"),
        *_numbers("suppliers"), "supplier_country", "extras", reject.alias("reject_reason"))


def ingest_warehouses(rows: DataFrame) -> DataFrame:
    """Warehouse rows; a missing time zone is the default one."""
    rows = _parsed(rows, "warehouse")
    code, name, kind = required_text("warehouse_code"), required_text("warehouse_name"), required_text("warehouse_type")
    zone = F.coalesce(required_text("timezone"), F.lit(DEFAULT_TIMEZONE))
    reject = F.coalesce(
        F.when(code.isNull(), F.lit(IS_REQUIRED.format("warehouse_code"))),
        F.when(name.isNull(), F.lit(IS_REQUIRED.format("warehouse_name"))),
        F.when(kind.isNull(), F.lit(IS_REQUIRED.format("warehouse_type"))),
        F.when(~kind.isin(WAREHOUSE_TYPES), F.lit(BAD_TYPE)),
        *_number_rejects("warehouse"), *_negative_rejects("warehouse"))
    return rows.select(
        "dataset_id", "source_row_number", code.alias("warehouse_code"), name.alias("warehouse_name"),
        kind.alias("warehouse_type"), "country", "region", "city", *_numbers("warehouse"), "capacity_unit",
        zone.alias("timezone"), "extras", reject.alias("reject_reason"))


def row_failures(ingested: DataFrame) -> DataFrame:
    """Per dataset: inserted / failed counts, status, first 20 failures (row, code, message)."""
    bad = ingested.where(F.col("reject_reason").isNotNull())
    w = Window.partitionBy("dataset_id").orderBy("source_row_number")
    sample = (bad.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= FAILURE_SAMPLE_LIMIT)
              .groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct(
                  F.col("source_row_number").alias("row_number"),
                  F.lit("ROW_CONVERSION_FAILED").alias("code"),
                  F.col("reject_reason").alias("message")))).alias("failures")))
    counts = ingested.groupBy("dataset_id").agg(
        F.count_if(F.col("reject_reason").isNull()).alias("inserted_count"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("failed_count"))
    out = counts.join(sample, "dataset_id", "left")
    return out.select("dataset_id",
                      F.when(F.col("failed_count") == 0, "ingested").otherwise("failed").alias("status"),
                      "inserted_count", "failed_count",
                      F.coalesce("failures", F.array().cast(sample.schema["failures"].dataType)).alias("failures"))
