"""Driver tables and the canonical business tables derived from them.

The mapping from the TPC-H-like driver tables onto the canonical tables
(suppliers, warehouses, stores, products, sales_records, inventory_snapshots)
is fixed; the same definitions exist as SQL text in ``plans/oracle_views.py``
so DuckDB can recompute every query from the raw tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.aggregates import arg_max
from larder.operators.rownum import global_row_number
from larder.session import fit_partitions, stored

# Stored tables per (application, folder, name): written once, read by every
# query of the application; entries of ended applications are dropped.
_STORED: dict = {}

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazily built canonical DataFrames for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        fit_partitions(spark, sf_dir)
        self._cache: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return raw(self.spark, self.sf_dir, name)

    def _memo(self, key, build):
        if key not in self._cache:
            self._cache[key] = build()
        return self._cache[key]

    def _stored(self, name, build, file_rows=0):
        """A canonical table as it would sit in storage: built once per session
        and folder, written as Parquet under the shared checkpoint folder
        (lineage cut, survives executor loss, column pruning and filter
        push-down on every later read), then read by every query."""
        return self._kept(name, lambda: stored(build(), name, file_rows))

    def _kept(self, name, build):
        """A table built once per session and folder, of which ``build`` has stored all that is costly."""
        app = self.spark.sparkContext.applicationId
        for old in [k for k in _STORED if k[0] != app]:
            del _STORED[old]
        key = (app, self.sf_dir, name)
        if key not in _STORED:
            _STORED[key] = build()
        return _STORED[key]

    # No broadcast hints here: AQE sees the sizes of the dimension tables.
    def nation_region(self) -> DataFrame:
        return self._memo("nation_region", lambda: self.raw("nation").join(
            self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")))

    def suppliers(self) -> DataFrame:
        def build():
            s = self.raw("supplier")
            n = self.raw("nation").select("n_nationkey", "n_name")
            return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
                F.col("s_suppkey").alias("supplier_id"),
                F.col("s_name").alias("supplier_name"),
                ((F.col("s_acctbal") + 1000) / 110).alias("supplier_score"),
                (F.col("s_suppkey") % 14 + 1).alias("lead_time_days"),
                F.col("n_name").alias("supplier_country"))
        return self._memo("suppliers", build)

    def warehouses(self) -> DataFrame:
        def build():
            k = F.col("n_nationkey") % 4
            wtype = (F.when(k == 0, "ambient").when(k == 1, "chilled")
                     .when(k == 2, "frozen").otherwise("mixed"))
            return self.nation_region().select(
                F.col("n_nationkey").alias("warehouse_id"),
                F.col("n_name").alias("warehouse_code"),
                wtype.alias("warehouse_type"),
                F.col("r_name").alias("region"))
        return self._memo("warehouses", build)

    def stores(self) -> DataFrame:
        def build():
            return self.nation_region().select(
                (F.col("n_nationkey") + 100).alias("store_id"),
                F.col("n_nationkey").alias("warehouse_id"),
                F.col("n_name").alias("store_name"),
                F.when(F.col("n_nationkey") % 3 == 0, F.lit(None).cast("string"))
                 .otherwise(F.col("r_name")).alias("region"))
        return self._memo("stores", build)

    def main_supplier(self) -> DataFrame:
        """Per part, the supplier with the largest total quantity (ties: lowest key).

        Two partial aggregations instead of a ranked window, so a part with a
        huge number of lines is combined map-side first.
        """
        def build():
            li = self.raw("lineitem")
            per_pair = li.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("qty"))
            return per_pair.groupBy("l_partkey").agg(
                arg_max(F.col("l_suppkey"), [F.col("qty"), -F.col("l_suppkey")]).alias("l_suppkey"))
        return self._memo("main_supplier", build)

    def products(self) -> DataFrame:
        def build():
            p = self.raw("part")
            sup = self.main_supplier()
            return p.join(sup, F.col("l_partkey") == F.col("p_partkey"), "left").select(
                F.col("p_partkey").alias("product_id"),
                F.col("p_name").alias("product_name"),
                F.col("p_type").alias("category"),
                F.col("l_suppkey").alias("supplier_id"),
                F.col("p_size").alias("shelf_life_days"),
                (F.col("p_size") % 20 - 5).cast("double").alias("storage_temp"),
                (F.col("p_size").cast("double") / 50).alias("spoilage_sensitivity"),
                F.col("p_retailprice").alias("base_price"),
                (F.col("p_retailprice") * F.lit(0.7).cast("double")).alias("cost_price"))
        return self._stored("products", build)

    def li_numbered(self) -> DataFrame:
        """lineitem with its file position (header = row 1, so data starts at 2)."""
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                 "l_extendedprice", "l_quantity"]
        used = [*order, "l_discount", "l_tax", "l_returnflag"]
        return self._kept("li_numbered", lambda: global_row_number(  # the numbering stores the rows
            self.raw("lineitem").select(*used), order, name="source_row_number", start=2))

    def sales_records(self) -> DataFrame:
        def build():
            li = self.li_numbered().filter(F.col("l_returnflag") != "N")
            o = self.raw("orders").select("o_orderkey", "o_custkey")
            c = self.raw("customer").select("c_custkey", "c_nationkey")
            s = self.raw("supplier").select("s_suppkey", "s_nationkey")
            # The narrow orders meet their customers first: the lines then move once, by order.
            o = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_nationkey")
            j = li.join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(o, F.col("o_orderkey") == F.col("l_orderkey"))
            return j.select(
                F.lit("sales").alias("dataset_id"),
                "source_row_number",
                F.col("l_partkey").alias("product_id"),
                (F.col("c_nationkey") + 100).alias("store_id"),
                F.col("s_nationkey").alias("warehouse_id"),
                F.col("l_shipdate").cast("date").alias("transaction_date"),
                F.col("l_quantity").alias("units_sold"),
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("selling_price"),
                F.col("l_discount").alias("discount_pct"),
                (F.col("l_discount") >= 0.08).alias("is_promoted"),
                F.when(F.col("l_tax") == 0, F.lit(None).cast("double"))
                 .otherwise(F.col("l_tax")).alias("spoilage_risk"))
        return self._stored("sales_records", build)

    def inventory_snapshots(self) -> DataFrame:
        def build():
            li = self.li_numbered().filter(F.col("l_returnflag") == "N")
            s = self.raw("supplier").select("s_suppkey", "s_nationkey")
            j = li.join(s, F.col("s_suppkey") == F.col("l_suppkey"))
            return j.select(
                F.lit("inventory").alias("dataset_id"),
                "source_row_number",
                F.col("l_partkey").alias("product_id"),
                F.col("s_nationkey").alias("warehouse_id"),
                F.col("l_shipdate").cast("date").alias("snapshot_date"),
                (F.col("l_quantity") * 100).alias("current_inventory"),
                (F.col("l_linenumber") * 10).cast("double").alias("reserved_inventory"),
                (F.col("l_tax") * 1000).alias("incoming_inventory"),
                F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                         F.col("l_linenumber").cast("string")).alias("batch_id"),
                F.col("l_discount").alias("spoilage_risk"))
        return self._stored("inventory_snapshots", build)

    def forecast_requests(self) -> DataFrame:
        """One forecast series per (order, part, supplier warehouse).

        The order date is the forecast start; the order priority picks the
        horizon; urgent and high orders also name the customer's store, the
        others leave the store open (optional as-of key). The request table
        has several consumers (both look-ups, the dimension joins), so it is
        materialised once in the shared checkpoint folder, like a stored
        prediction-job table.
        """
        return self._stored("forecast_requests", self._requests)

    def _requests(self) -> DataFrame:
        def build():
            li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
            o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
            c = self.raw("customer").select("c_custkey", "c_nationkey")
            s = self.raw("supplier").select("s_suppkey", "s_nationkey")
            pr = F.col("o_orderpriority")
            horizon = (F.when(pr == "1-URGENT", 14).when(pr == "2-HIGH", 30)
                       .when(pr == "3-MEDIUM", 60).when(pr == "4-NOT SPECIFIED", 90).otherwise(14))
            # Orders meet customers and lines meet suppliers first: the last join leaves the rows
            # dealt by order, so that the rows made distinct need not move again.
            o = o.join(c, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey", "c_custkey")
            j = (li.join(s, F.col("s_suppkey") == F.col("l_suppkey")).select("l_orderkey", "l_partkey", "s_nationkey")
                 .join(o, F.col("o_orderkey") == F.col("l_orderkey")))
            return j.select(
                F.col("o_orderkey").alias("request_id"),
                F.col("l_partkey").alias("product_id"),
                F.col("s_nationkey").alias("warehouse_id"),
                F.when(pr.isin("1-URGENT", "2-HIGH"), F.col("c_nationkey") + 100).alias("store_id"),
                F.col("o_orderdate").cast("date").alias("forecast_start_date"),
                horizon.alias("horizon_days")).distinct()
        return build()

    def request_lines(self) -> DataFrame:
        """The requests' product lines as sent, repeats included, with the dataset a request names."""
        li = self.raw("lineitem").select("l_orderkey", "l_partkey")
        o = self.raw("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
        pr = F.col("o_orderpriority")
        horizon = (F.when(pr == "1-URGENT", 14).when(pr == "2-HIGH", 30)
                   .when(pr == "3-MEDIUM", 60).when(pr == "4-NOT SPECIFIED", 90).otherwise(14))
        dataset = F.when(F.col("o_orderstatus") == "P", "sales_upload")
        return li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(
            F.col("o_orderkey").alias("request_id"), F.col("l_partkey").alias("product_id"),
            horizon.alias("horizon_days"), dataset.alias("dataset_id"))

    def hourly_arrays(self) -> DataFrame:
        """Per (user, day): 24-slot sales and stock-out arrays from ``events``.

        Slot h of ``hours_stock_status`` is 1 when the user had no event in hour
        h; ``hours_sale[h]`` is the summed value in that hour.
        """
        def build():
            e = self.raw("events").select("user_id", "ts", "value")
            per_hour = (e.groupBy("user_id", F.col("ts").cast("date").alias("dt"),
                                  F.hour("ts").alias("hr"))
                        .agg(F.sum("value").alias("v")))
            per_day = per_hour.groupBy("user_id", "dt").agg(
                F.map_from_entries(F.collect_list(F.struct("hr", "v"))).alias("m"))
            slots = F.sequence(F.lit(0), F.lit(23))
            return per_day.select(
                "user_id", "dt",
                F.transform(slots, lambda h: F.round(F.coalesce(F.col("m")[h], F.lit(0.0)), 6)).alias("hours_sale"),
                F.transform(slots, lambda h: F.when(F.col("m")[h].isNull(), 1).otherwise(0)
                            ).alias("hours_stock_status"))
        return self._memo("hourly_arrays", build)

    # ------------------------------------------------------------------
    # Raw uploads: all-string tables as a client would send them, with the
    # original column names and injected faults picked by row number. They
    # carry their file position as ``source_row_number``.
    # ------------------------------------------------------------------
    def sales_upload(self) -> DataFrame:
        def build():
            codes = self.warehouses().select("warehouse_id", "warehouse_code")
            s = self.sales_records().join(codes, "warehouse_id", "left")
            r = F.col("source_row_number")
            d = F.col("transaction_date")
            units = F.col("units_sold").cast("bigint").cast("string")
            cents = F.round(F.col("selling_price") * 100).cast("bigint")
            price = F.concat(F.floor(cents / 100).cast("string"), F.lit("."),
                             F.lpad((cents % 100).cast("string"), 2, "0"))
            return s.select(
                r,
                F.when(r % 97 == 0, F.lit("not-a-date"))
                 .when(r % 89 == 0, F.date_format(d, "MM/dd/yyyy"))
                 .otherwise(F.date_format(d, "yyyy-MM-dd")).alias("Sale Date"),
                F.when(r % 83 == 0, F.lit(None).cast("string"))
                 .when(r % 113 == 0, F.lit("  "))
                 .when(r % 79 == 0, F.concat(F.lit("SKU-"), F.col("product_id").cast("string")))
                 .otherwise(F.col("product_id").cast("string")).alias("sku"),
                F.when(r % 73 == 0, F.concat(F.lit("-"), units))
                 .when(r % 71 == 0, F.lit(None).cast("string"))
                 .when(r % 67 == 0, F.lit("abc"))
                 .when(r % 127 == 0, F.concat(units, F.lit("d")))
                 .otherwise(units).alias("qty_sold"),
                price.alias("unit_price"),
                F.when(r % 61 == 0, F.lit("1.5"))
                 .otherwise(F.col("discount_pct").cast("string")).alias("discount"),
                F.when(r % 59 == 0, F.lit("maybe"))
                 .when(F.col("is_promoted"), F.lit("yes")).otherwise(F.lit("no")).alias("promotion_flag"),
                F.when(r % 101 == 0, F.concat(F.lit("S-"), (r % 3).cast("string")))
                 .otherwise(F.col("store_id").cast("string")).alias("store_code"),
                F.when(r % 107 == 0, F.lit(None).cast("string")).otherwise(F.col("warehouse_code")).alias("warehouse_id"),
                F.col("spoilage_risk").cast("string").alias("spoilage_risk"),
                F.concat(F.lit("note "), (r % 7).cast("string")).alias("receipt_note"))
        return self._memo("sales_upload", build)

    def inventory_upload(self) -> DataFrame:
        def build():
            i = self.inventory_snapshots()
            p = self.products().select("product_id", "shelf_life_days")
            codes = self.warehouses().select("warehouse_id", "warehouse_code")
            j = i.join(p, "product_id", "left").join(codes, "warehouse_id", "left")
            r = F.col("source_row_number")
            snap = F.col("snapshot_date")
            expiry = F.when(r % 53 == 0, F.date_sub(snap, 3)).otherwise(
                F.date_add(snap, F.col("shelf_life_days")))
            return j.select(
                r,
                F.date_format(snap, "yyyy-MM-dd").alias("as_of_date"),
                F.col("product_id").cast("string").alias("item_id"),
                F.when(r % 47 == 0, F.lit("WH-X")).when(r % 109 == 0, F.lit(" "))
                 .otherwise(F.col("warehouse_code")).alias("location_id"),
                F.when(r % 43 == 0, F.concat(F.lit("-"), F.col("current_inventory").cast("bigint").cast("string")))
                 .otherwise(F.col("current_inventory").cast("bigint").cast("string")).alias("on_hand"),
                F.col("reserved_inventory").cast("bigint").cast("string").alias("reserved_inventory"),
                F.round(F.col("incoming_inventory")).cast("bigint").cast("string").alias("incoming_inventory"),
                F.date_format(expiry, "yyyy-MM-dd").alias("expiration_date"),
                F.col("batch_id"),
                F.col("spoilage_risk").cast("string").alias("spoilage_risk"),
                F.concat(F.lit("t"), (r % 11).cast("string")).alias("temperature_log"))
        return self._memo("inventory_upload", build)

    def products_upload(self) -> DataFrame:
        def build():
            p = self.products()
            k = F.col("product_id")
            return p.select(
                (k + 2).alias("source_row_number"),
                k.cast("string").alias("sku"),
                F.when(k % 41 == 0, F.lit(" ")).otherwise(F.col("product_name")).alias("product_name"),
                F.when(k % 29 == 0, F.lit("EXPERIMENTAL")).otherwise(F.col("category")).alias("category"),
                F.when(k % 37 == 0, F.lit("999999"))
                 .otherwise(F.col("supplier_id").cast("string")).alias("vendor_id"),
                F.col("shelf_life_days").cast("string").alias("shelf_life_days"),
                F.col("storage_temp").cast("bigint").cast("string").alias("storage_temp"),
                F.when(k % 31 == 0, F.lit("-1")).otherwise((k % 900 + 100).cast("string")).alias("base_price"),
                F.when(k % 23 == 0, F.lit("5f")).otherwise((k % 700 + 50).cast("string")).alias("cost_price"),
                F.concat(F.lit("brand "), (k % 13).cast("string")).alias("brand_note"))
        return self._memo("products_upload", build)

    def suppliers_upload(self) -> DataFrame:
        def build():
            s = self.suppliers()
            k = F.col("supplier_id")
            return s.select(
                (k + 1).alias("source_row_number"),
                F.when(k % 19 == 0, F.lit("  ")).otherwise(k.cast("string")).alias("supplier_code"),
                F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("supplier_name")).alias("supplier_name"),
                F.when(k % 17 == 0, F.lit("12d")).otherwise((k % 100).cast("string")).alias("supplier_score"),
                F.when(k % 13 == 0, F.lit("-3")).otherwise(F.col("lead_time_days").cast("string")).alias("lead_time_days"),
                (k % 40).cast("string").alias("minimum_order_quantity"),
                F.col("supplier_country"),
                F.concat(F.lit("desk "), (k % 5).cast("string")).alias("contact_note"))
        return self._memo("suppliers_upload", build)

    def warehouse_upload(self) -> DataFrame:
        def build():
            k = F.col("n_nationkey")
            kind = (F.when(k % 9 == 4, "tropical").when(k % 4 == 0, "ambient").when(k % 4 == 1, "chilled")
                    .when(k % 4 == 2, "frozen").otherwise("mixed"))
            return self.nation_region().select(
                (k + 2).cast("bigint").alias("source_row_number"),
                F.when(k % 11 == 3, F.lit(" ")).otherwise(F.col("n_name")).alias("warehouse_code"),
                F.when(k % 13 == 5, F.lit(None).cast("string")).otherwise(F.concat("n_name", F.lit(" DC"))).alias("warehouse_name"),
                kind.alias("warehouse_type"),
                F.col("n_name").alias("country"),
                F.col("r_name").alias("region"),
                F.when(k % 8 == 6, F.lit("n.k.")).otherwise((k * 100 - 500).cast("string")).alias("storage_capacity"),
                F.when(k % 6 == 1, F.lit(None).cast("string")).otherwise(F.lit("Europe/Paris")).alias("timezone"),
                F.concat(F.lit("dock "), (k % 3).cast("string")).alias("dock_note"))
        return self._memo("warehouse_upload", build)

    def orders_upload(self) -> DataFrame:
        """Sales by order with two date columns that both mean the transaction date, and repeated rows."""
        def build():
            d = F.col("o_orderdate").cast("date")
            return self.raw("orders").select(
                (F.col("o_orderkey") + 1).alias("source_row_number"),
                F.date_format(F.trunc(d, "month"), "yyyy-MM-dd").alias("Sale Date"),
                F.date_format(F.trunc(d, "year"), "yyyy-MM-dd").alias("date"),
                F.col("o_orderpriority").alias("sku"),
                F.floor(F.col("o_totalprice") / 100000).cast("string").alias("qty_sold"))
        return self._memo("orders_upload", build)
