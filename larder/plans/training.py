"""Model-training frame and dataset splits.

The perishable-goods training table: one row per sale with product,
supplier and regional context; ``units_sold`` is the target. Splits are
deterministic functions of the row key (md5 bucket), so they do not depend on
partitioning, and the chronological split numbers rows without a
single-partition sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.rownum import global_row_number
from larder.sources.tables import Tables

TARGET = "units_sold"
NUMERIC = ["units_sold", "shelf_life_days", "cost_price", "spoilage_sensitivity", "spoilage_risk", "selling_price",
           "discount_pct", "is_promoted", "supplier_score", "storage_temp"]
FEATURES = [c for c in NUMERIC if c != TARGET]
SEED = 42


def training_frame(t: Tables) -> DataFrame:
    """The training table, stored once: its readers scan it several times and need not join the sales again."""
    return t._stored("training_frame", lambda: _frame(t))


def _frame(t: Tables) -> DataFrame:
    s = t.sales_records()
    p = t.products().select("product_id", "supplier_id", "category", "shelf_life_days", "cost_price",
                            "spoilage_sensitivity", "storage_temp")
    sup = t.suppliers().select("supplier_id", "supplier_score")
    st = t.stores().select("store_id", F.col("region").alias("store_region"))
    wh = t.warehouses().select("warehouse_id", F.col("region").alias("warehouse_region"))
    j = (s.join(p, "product_id", "left").join(sup, "supplier_id", "left")
         .join(st, "store_id", "left").join(wh, "warehouse_id", "left"))
    return j.select(
        F.col("source_row_number").alias("row_id"), "transaction_date", "units_sold",
        F.col("shelf_life_days").cast("double").alias("shelf_life_days"), "cost_price", "spoilage_sensitivity",
        "spoilage_risk", "selling_price", "discount_pct", F.col("is_promoted").cast("double").alias("is_promoted"),
        "supplier_score", "storage_temp", "category",
        F.coalesce("store_region", "warehouse_region").alias("region"))


def hash_unit(key, seed: int = SEED):
    """Uniform [0, 1) from md5(seed:key): same value in any engine, any layout."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def split_random(df: DataFrame, key: str = "row_id", train: float = 0.65) -> DataFrame:
    return df.withColumn("split", F.when(hash_unit(F.col(key)) < train, "train").otherwise("test"))


def split_three_way(df: DataFrame, key: str = "row_id", train: float = 0.70, val: float = 0.15) -> DataFrame:
    u = hash_unit(F.col(key))
    return df.withColumn("split", F.when(u < train, "train").when(u < train + val, "validation").otherwise("test"))


def _cuts(n):
    """Row counts at which validation and test start, from the total."""
    first = F.floor(n * 0.70)
    return first, F.least(first + F.greatest(F.lit(1), F.floor(n * 0.15)), n - 1)


def _split_of(position, n):
    first, second = _cuts(n)
    return F.when(position < first, "train").when(position < second, "validation").otherwise("test")


def chronological_positions(df: DataFrame, date: str = "transaction_date", key: str = "row_id") -> DataFrame:
    """(key, date, position, split): positions in date order (ties by key) of the two narrow columns."""
    numbered = global_row_number(df.select(key, date), [date, key], name="position", start=0)
    n = df.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    j = numbered.withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k")  # one-row side
    return j.withColumn("split", _split_of(F.col("position"), F.col("_n"))).drop("_k", "_n")


def split_chronological(df: DataFrame, date: str = "transaction_date", key: str = "row_id") -> DataFrame:
    """Stable sort by date (ties by key); first int(0.70 n) rows train, the next
    max(1, int(0.15 n)) validation (capped at n - 1), the rest test.

    No wide row is sorted, joined or moved for its split: counts per date (a
    calendar's worth of rows, on the driver) tell which dates lie in one split,
    and those form one range of dates a split. Only rows of a date that a cut
    crosses are ranked, on their key.
    """
    counts = df.groupBy(date).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per calendar day
    total = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = counts.withColumn("_end", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(total))
    begin, end, n = F.col("_end") - F.col("_c"), F.col("_end") - 1, F.col("_n")
    days = days.select(F.col(date).alias("_day"), begin.alias("_begin"), "_c", "_n", _split_of(begin, n).alias("_first"),
                       _split_of(end, n).alias("_last")).orderBy("_begin").collect()

    def on(day):
        return F.col(date).eqNullSafe(F.lit(day).cast(df.schema[date].dataType))

    label = F.lit(None).cast("string")
    for name in ("train", "validation", "test"):
        own = [d["_day"] for d in days if d["_first"] == d["_last"] == name]
        known = [d for d in own if d is not None]
        if known:
            label = F.when(F.col(date).between(F.lit(known[0]), F.lit(known[-1])), F.lit(name)).otherwise(label)
        if len(known) < len(own):
            label = F.when(F.col(date).isNull(), F.lit(name)).otherwise(label)
    whole = df.withColumn("split", label)
    cut = [d for d in days if d["_first"] != d["_last"]]  # two at most
    if not cut:
        return whole
    here = on(cut[0]["_day"])
    for d in cut[1:]:
        here = here | on(d["_day"])
    crossed = df.where(here)
    ranks = global_row_number(crossed.select(key, date), [date, key], name="_rank", start=0)
    place, skipped = F.lit(None).cast("bigint"), 0
    for d in cut:
        place = F.when(on(d["_day"]), F.col("_rank") + F.lit(d["_begin"] - skipped)).otherwise(place)
        skipped += d["_c"]
    placed = ranks.select(key, _split_of(place, F.lit(days[0]["_n"])).alias("split"))
    return whole.where(~here).unionByName(crossed.join(placed, key).select(*df.columns, "split"))


# Columns of the audited training file, target first; all text, with faults by row number.
AUDIT_COLUMNS = ["units_sold", "selling_price", "discount_pct", "spoilage_risk", "constant_input"]
AUDIT_FRAME_SQL = """
select case when row_id % 211 = 0 then '12d' when row_id % 223 = 0 then null else cast(cast(units_sold as bigint) as varchar) end as units_sold,
       case when row_id % 227 = 0 then 'inf' when row_id % 229 = 0 then 'n.k.' else cast(cast(round(selling_price) as bigint) as varchar) end as selling_price,
       cast(cast(round(discount_pct * 100) as bigint) as varchar) as discount_pct,
       cast(cast(round(spoilage_risk * 100) as bigint) as varchar) as spoilage_risk, '1' as constant_input
from training_frame"""


def audit_frame(t: Tables) -> DataFrame:
    """A training file as it would arrive: text columns with bad casts, infinities and gaps."""
    f, r = training_frame(t), F.col("row_id")

    def whole(c):
        return F.round(c).cast("bigint").cast("string")

    return f.select(
        F.when(r % 211 == 0, F.lit("12d")).when(r % 223 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("units_sold").cast("bigint").cast("string")).alias("units_sold"),
        F.when(r % 227 == 0, F.lit("inf")).when(r % 229 == 0, F.lit("n.k.")).otherwise(whole(F.col("selling_price"))).alias("selling_price"),
        whole(F.col("discount_pct") * 100).alias("discount_pct"), whole(F.col("spoilage_risk") * 100).alias("spoilage_risk"),
        F.lit("1").alias("constant_input"))
