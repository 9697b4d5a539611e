"""Steps of this round's findings: what they move and keep, with the same results as plain versions."""
import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from larder.operators import features as fe
from larder.operators import kendall
from larder.operators import stats as st
from larder.operators import trees
from larder.operators.asof import Facts, latest_asof, latest_asof_each
from larder.operators.keyed_store import KeyedTable
from larder.plans import analytics as an
from larder.plans import training as tr
from larder.session import SHUFFLE_CLEANUP, stored
from larder.sources import csv as cs
from larder.streaming import ingest as si


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) - 1) / 2.0 for v in values]


def _spearman(rows, i, j):
    both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
    a, b = _ranks([x for x, _ in both]), _ranks([y for _, y in both])
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))


def test_spearman_ranks_stay_in_the_row(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.random(), float(rnd.randrange(4)), rnd.choice([None, 1.0, 2.0, -0.0]), rnd.choice([None, rnd.random()])) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    for few in (0, 1000):
        out = st.corr_spearman(df, cols, "row_id", few)
        got = {(r["col_a"], r["col_b"]): r["corr"] for r in out.collect()}
        assert len(got) == 6
        for (a, b), v in got.items():
            assert abs(v - _spearman(rows, cols.index(a) + 1, cols.index(b) + 1)) < 1e-6
    twice = df.unionByName(df.where("row_id % 2 = 0"))  # ranks over all rows, an id counts once
    ranks = {c: _ranks([r[c] for r in twice.collect()]) for c in ("a", "b")}
    at = {r["row_id"]: i for i, r in enumerate(twice.collect())}
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in st.corr_spearman(twice, ["a", "b"], "row_id").collect()}
    assert abs(got["a", "b"] - np.corrcoef(*[[ranks[c][i] for i in at.values()] for c in ("a", "b")])[0, 1]) < 1e-6
    plan = _plan(st.corr_spearman(df, cols, "row_id"))
    assert "Exchange hashpartitioning" not in plan and "Generate inline" not in plan  # no row is multiplied, dealt by value or by id


def test_chronological_split_moves_no_row(spark):
    rnd = random.Random(7)
    days = [None, *[dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(9)]]
    for n in (0, 1, 2, 5, 60, 200):
        rows = [(i, rnd.choice(days), i * 2) for i in range(n)]
        out = tr.split_chronological(spark.createDataFrame(rows, "row_id long, transaction_date date, v long"))
        order = sorted(rows, key=lambda r: (r[1] or dt.date(1, 1, 1), r[0]))
        first = math.floor(n * 0.70)
        second = min(first + max(1, math.floor(n * 0.15)), n - 1)
        want = {r[0]: "train" if k < first else "validation" if k < second else "test" for k, r in enumerate(order)}
        assert {r["row_id"]: r["split"] for r in out.collect()} == want
        assert out.columns == ["row_id", "transaction_date", "v", "split"] and out.count() == n
    even = spark.range(100).select(F.col("id").alias("row_id"), F.expr("date_add(date'2024-01-01', cast(id / 5 as int))").alias("transaction_date"))
    plan = _plan(tr.split_chronological(even))  # 70, 15 and 15 days: no date is cut
    assert "Join" not in plan and "Exchange" not in plan


def test_a_token_is_made_once_a_value(spark):
    df = spark.createDataFrame([("A b",), ("a_b",), (None,), ("C",)] * 5, "category string")
    out = fe.one_hot_vocabulary(df, ["category"])
    assert sorted(r["level"] for r in out.collect()) == sorted(r["level"] for r in df.select(fe.group_token("category").alias("level")).distinct().collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("aggregate") == 2 and plan.rindex("aggregate") > plan.rindex("regexp")  # distinct values below the tokens


def test_daily_figures_move_only_repeated_series(spark):
    day = dt.date(2024, 1, 1)
    rows = [(1, 1, 1, day, 3, 10, 25.0, [10, 10, 10]), (2, 1, 1, day, 3, 4, None, [4, 1, 7]), (3, None, 1, day, 2, 5, 9.0, [5, 5]),
            (4, 1, 1, day, 2, None, 9.0, [None, None]), (5, 1, 1, day, 2, 3, 1.0, [3, None]), (6, 1, 1, None, 2, 3, 1.0, [3, 3]), (7, 1, 1, day, 2, 3, 1.0, None)]
    kind = ("request_id long, product_id long, warehouse_id int, forecast_start_date date, horizon_days int, predicted_units_sold long, "
            "current_inventory double, units array<bigint>")
    single = spark.createDataFrame(rows, kind)
    out = an.projected_inventory(single)
    plan = _plan(out)
    assert "Exchange" not in plan and "Window" not in plan
    got = {(r["request_id"], r["day_index"]): (r["forecast_date"], r["projected_inventory"]) for r in out.collect()}
    want = {1: [15, 5, -5], 2: [-4, -5, -12], 3: [4, -1], 4: [None, None], 5: [-2, None]}
    assert got == {(k, i): (day + dt.timedelta(i), v) for k, run in want.items() for i, v in enumerate(run)}
    states = {(r["request_id"], r["forecast_date"].day): (r["predicted_units_sold"], r["demand_status"]) for r in an.demand_status(single).collect()}
    assert states[1, 1] == (10, "Peak") and [states[2, i] for i in (1, 2, 3)] == [(4, "Normal"), (1, "Low"), (7, "Peak")]
    twice = single.where("request_id in (1, 3)").unionByName(single.where("request_id = 3"))
    assert sorted((r["request_id"], r["projected_inventory"]) for r in an.projected_inventory(twice).collect()) == [
        (1, -5), (1, 5), (1, 15), (3, -11), (3, -6), (3, -1), (3, 4)]


def test_two_lookups_move_the_requests_once(spark):
    rnd = random.Random(11)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(9))
    req = spark.createDataFrame([(i, rnd.choice([1, 2, None]), rnd.choice([5, 6, None]), rnd.choice([None, day()])) for i in range(120)],
                                "id long, product long, store long, day date")
    sales = spark.createDataFrame([(rnd.choice([1, 2, None]), rnd.choice([5, 6]), day(), i) for i in range(80)], "product long, store long, day date, row long")
    stock = spark.createDataFrame([(rnd.choice([1, 2, None]), rnd.choice([None, day()]), i) for i in range(80)], "product long, at date, row long")
    both = latest_asof_each(req, [Facts(sales, "day", ["row"], ["row"], ["store"], alias="sale"), Facts(stock, "at", ["row"], ["row"], alias="inv")],
                            keys=["product"], request_date="day")
    one = latest_asof(req, sales, keys=["product"], optional_keys=["store"], request_date="day", fact_date="day", values=["row"], tiebreak=["row"], alias="sale")
    other = latest_asof(req, stock, keys=["product"], request_date="day", fact_date="at", values=["row"], tiebreak=["row"], alias="inv")
    assert _plan(both).count("Exchange hashpartitioning") == 1
    sale, inv = ({r["id"]: r[c] for r in df.collect()} for df, c in ((one, "sale"), (other, "inv")))
    got = {r["id"]: (r["sale"], r["inv"]) for r in both.collect()}
    assert got == {i: (sale[i], inv[i]) for i in sale} and any(a and b for a, b in got.values())


def test_stored_tables_leave_no_shuffle(spark, monkeypatch):
    inside = []
    keep = type(spark.conf).set
    monkeypatch.setattr(type(spark.conf), "set", lambda self, k, v: inside.append((k, str(v))) or keep(self, k, v))
    before = spark.conf.get(SHUFFLE_CLEANUP)
    assert stored(spark.range(50).repartition(3, "id"), "probe").count() == 50
    assert (SHUFFLE_CLEANUP, "true") in inside and spark.conf.get(SHUFFLE_CLEANUP) == before


def test_stream_holds_no_batch_and_bounds_its_bytes(spark, tmp_path, monkeypatch):
    header = ["product_id", "units_sold", "transaction_date"]
    rows = spark.range(300).select((F.col("id") % 110).cast("string").alias("product_id"), F.lit("2").alias("units_sold"), F.lit("2024-01-02").alias("transaction_date"))
    cs.write_csv(rows.repartition(3), str(tmp_path / "in"))
    mappings = [{"source_column": c, "target_field": c, "mapping_type": "exact", "is_confirmed": True, "default_value": None} for c in header]

    def refused(self, *a):
        raise AssertionError("the batch is held")

    monkeypatch.setattr(type(spark.range(1)), "persist", refused)
    monkeypatch.setattr(type(spark.range(1)), "cache", refused)
    results = []
    for name, limit in (("one", {}), ("many", {"max_bytes_per_trigger": 1})):
        si.stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / name), str(tmp_path / f"ckpt-{name}"), header, mappings,
                         spark.range(100).withColumnRenamed("id", "product_id"),
                         spark.createDataFrame([(7, "W7")], "warehouse_id int, warehouse_code string"), spark.createDataFrame([(100,)], "store_id int"), **limit)
        table = si.ingested(spark, str(tmp_path / name))
        results.append(sorted(tuple(map(str, r)) for r in table.collect()))
        assert len(KeyedTable(spark, str(tmp_path / name)).manifest()[2]) == (3 if limit else 1)  # epochs that were published
    assert results[0] == results[1] and len(results[0]) == 300


def test_bins_above_zero_are_found_in_row_order():
    bins = np.random.default_rng(3).integers(0, 4, (50, 11)).astype(np.uint8) * np.random.default_rng(4).integers(0, 2, (50, 11)).astype(np.uint8)
    for x in (bins, bins[::2], np.zeros((3, 11), np.uint8), bins[:0]):
        row, column = np.nonzero(x)
        got = trees._entries(x)
        assert all((a == b).all() for a, b in zip(got, (row, column, x[row, column])))


def test_kendall_points_are_dealt_without_a_table_in_the_mapping_task(spark, monkeypatch):
    plans, keep = [], kendall.stored
    monkeypatch.setattr(kendall, "stored", lambda df, name: plans.append((name, _plan(df))) or keep(df, name))
    df = spark.createDataFrame([(float(i % 7), float(i * i % 5), float(i)) for i in range(60)], "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in kendall.corr_kendall(df, ["a", "b", "c"]).collect()}
    rows = [(i % 7, i * i % 5, i) for i in range(60)]
    sign = lambda x: (x > 0) - (x < 0)
    for (a, b), v in got.items():
        at = ["abc".index(a), "abc".index(b)]
        pairs = [[sign(r[k] - q[k]) for k in at] for i, r in enumerate(rows) for q in rows[:i]]
        want = sum(x * y for x, y in pairs) / math.sqrt(sum(x * x for x, _ in pairs) * sum(y * y for _, y in pairs))
        assert abs(v - want) < 1e-6
    plan = dict(plans)["kendall-points"]
    assert plan.count("Exchange") == 1 and plan.index("HashAggregate") < plan.index("Exchange") < plan.index("MapInArrow")
    assert "HashAggregate" not in plan[plan.index("Exchange"):]
