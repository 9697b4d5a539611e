"""Steps that must not grow faster than their input: what moves, what is stored, and the same results as plain versions."""

import datetime as dt
import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from larder.operators import models as md
from larder.operators import stats as st
from larder.operators import trees
from larder.operators import validate as vd
from larder.operators.asof import latest_asof
from larder.operators.rownum import global_row_number
from larder.plans import analytics as an

DAY = dt.date(2024, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_asof_moves_rows_once_and_equals_a_plain_search(spark):
    rnd = random.Random(3)
    pick = lambda *v: rnd.choice(v)
    req = [(i, pick(1, 2, None), pick(5, 6, None), pick(None, *[DAY + dt.timedelta(rnd.randrange(12))] * 9)) for i in range(200)]
    facts = [(pick(1, 2, None), pick(5, 6, None), pick(None, *[DAY + dt.timedelta(rnd.randrange(12))] * 9), i) for i in range(150)]
    r = spark.createDataFrame(req, "id long, product long, store long, day date")
    f = spark.createDataFrame(facts, "product long, store long, day date, row long")
    out = latest_asof(r, f, keys=["product"], optional_keys=["store"], request_date="day", fact_date="day", values=["row"], tiebreak=["row"], alias="hit")
    plan = _plan(out)
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    want = {}
    for i, p, s, d in req:
        ok = [(y, n) for q, u, y, n in facts if d and y and p is not None and q == p and (s is None or u == s) and y <= d]
        want[i] = max(ok)[1] if ok else None
    assert {x["id"]: x["hit"] and x["hit"]["row"] for x in out.collect()} == want


def test_row_numbers_store_the_rows_as_a_table(spark):
    out = global_row_number(spark.range(100).withColumnRenamed("id", "k"), ["k"])
    assert "parquet" in _plan(out).lower() and "ExistingRDD" not in _plan(out)


def _series(spark):
    rows = [(1, 1, 1, DAY, 3, 10, 25.0), (2, 1, 1, DAY, 2, 4, None), (2, 1, 1, DAY, 2, 4, 9.0), (3, 1, 1, None, 2, 4, 9.0)]
    df = spark.createDataFrame(rows, "request_id long, product_id long, warehouse_id int, forecast_start_date date, horizon_days int, "
                                     "predicted_units_sold long, current_inventory double")
    return an.daily_units(df)


def test_daily_stock_is_folded_inside_a_series_row_and_across_repeated_ones(spark):
    got = sorted((r["request_id"], r["forecast_date"], r["projected_inventory"]) for r in an.projected_inventory(_series(spark)).collect())
    days = [DAY + dt.timedelta(i) for i in range(3)]
    assert got[:3] == [(1, days[0], 15), (1, days[1], 5), (1, days[2], -5)]
    assert len(got) == 7  # two rows of series 2 with two days each; a series without a start has no day
    runs = sorted(r["_run"] for r in an.projected_inventory(_series(spark).withColumn("current_inventory", F.lit(0.0))).select(
        (-F.col("projected_inventory")).alias("_run"), "request_id").where("request_id = 2").collect())
    assert runs == [4, 8, 12, 16]


def test_demand_status_of_single_and_repeated_series(spark):
    got = an.demand_status(_series(spark)).collect()
    assert len(got) == 7 and {r["demand_status"] for r in got} == {"Peak"}


def test_export_is_written_compressed_and_results_are_ordered(spark, monkeypatch):
    from larder.plans import queries_forecast as qf
    from larder.plans.catalog import QUERIES, load_all
    load_all()
    seen, plain = [], qf.scratch_path
    monkeypatch.setattr(qf, "scratch_path", lambda s, name: seen.append(plain(s, name)) or seen[-1])
    assert QUERIES["write_forecast_csv"](spark, "/root/testdata/sf0.001").count() > 0
    names = [n for n in os.listdir(seen[-1].removeprefix("file:")) if n.startswith("part-")]
    assert names and all(n.endswith(".csv.gz") for n in names)
    out = QUERIES["results_for_job"](spark, "/root/testdata/sf0.001")
    keys = [(r["request_id"], r["forecast_date"]) for r in out.select("request_id", "forecast_date").collect()]
    assert keys == sorted(keys)
    plan = _plan(out)
    assert plan.index("Generate") < plan.index("rangepartitioning")  # a plan is printed from its end: series move, days do not


def test_shuffle_partitions_grow_with_the_input(spark, tmp_path):
    from larder.session import PARTITION_INPUT, fit_partitions
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        with open(tmp_path / "x.parquet", "wb") as f:
            f.truncate(PARTITION_INPUT * 9)
        assert fit_partitions(spark, str(tmp_path)) == max(9, int(before))
        assert fit_partitions(spark, str(tmp_path / "none")) == max(9, int(before))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tokens_are_made_once_a_row(spark):
    df = spark.createDataFrame([(f"Level {i}", "North") for i in range(20)], "category string, region string")
    enc, names = md.encode(df, df)
    assert len(names) == 21 and enc.columns == [*df.columns, *names]
    assert enc._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp") < 21
    assert all(sum(r[2:]) == 2.0 for r in enc.collect())


def test_mutual_information_without_a_row_a_column(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, 0.0, 1.0]), float(rnd.randrange(7)), rnd.choice([None, 3.0]), rnd.choice([None, float(rnd.randrange(4))])) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, flat double, t double").repartition(3)
    out = st.mutual_info(df, ["a", "b", "flat"], "t", 10)
    assert "Generate" not in _plan(out)

    def plain(i):
        v = [(r[i], r[3]) for r in rows if r[i] is not None and r[3] is not None]
        x, t = (np.array(c) for c in zip(*v))
        cut = lambda c: np.zeros(len(c)) if c.min() == c.max() else np.minimum(9, np.floor((c - c.min()) / (c.max() - c.min()) * 10))
        x, t, n = cut(x), cut(t), len(v)
        return round(sum((m := ((x == p) & (t == q)).sum()) / n * np.log(m * n / ((x == p).sum() * (t == q).sum()))
                         for p in set(x) for q in set(t) if ((x == p) & (t == q)).any()), 6)

    assert {r["column"]: r["score"] for r in out.collect()} == {c: plain(i) for i, c in enumerate(["a", "b", "flat"])}


def test_bins_are_read_in_place_also_from_a_slice():
    x = np.arange(40, dtype=np.uint8).reshape(10, 4)
    packed = trees._packed(x)
    assert packed.to_pylist() == [r.tobytes() for r in x]
    assert (trees._bins(packed.slice(3, 5), 4) == x[3:8]).all()


def test_histograms_count_bin_0_by_what_is_left(spark):
    rnd = np.random.default_rng(1)
    x, y = rnd.integers(0, 3, (300, 5)).astype(np.uint8), rnd.integers(0, 1000, 300)
    rows = spark.createDataFrame([(i, bytearray(x[i].tobytes()), int(y[i]), 0.0) for i in range(300)], "key bigint, bins binary, y bigint, pred double").repartition(3)
    s = trees.Settings(5, 4, 2, 1, trees.share(2.0), lambda tree, node: np.arange(5))
    got = {(r["feature"], r["bin"]): (r["w"], r["sum"]) for r in trees.histograms(rows, [(0, 0)], {0: trees.Tree()}, [], 1.0, s).collect() if r["slot"] == 0}
    assert got == {(f, b): (int((x[:, f] == b).sum()), int(y[x[:, f] == b].sum())) for f in range(5) for b in range(3)}


def test_repeated_rows_are_counted_by_narrow_hashes(spark):
    rows = [(1, None, "a"), (2, "a", None), (3, "a", None), (4, "", "a"), (5, "a", ""), (6, "ab", "c"), (7, "a", "bc"), (8, None, "a")]
    df = spark.createDataFrame(rows, "source_row_number long, x string, y string")
    out = vd.duplicate_counts_from_wide([("d", df)])
    assert [r["value"] for r in out.collect()] == ["2"]
    assert "xxhash64" in _plan(out)
