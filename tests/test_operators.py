import datetime as dt

from pyspark.sql import functions as F

from larder.operators.asof import flatten, latest_asof
from larder.operators.rownum import global_row_number
from larder.operators import stats as st


def d(s):
    return dt.date.fromisoformat(s)


def test_global_row_number_matches_sort(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).alias("k"))
    out = global_row_number(df, ["k"], name="rn", num_partitions=7).collect()
    assert sorted((r["k"], r["rn"]) for r in out) == [(k, k + 1) for k in range(5000)]


def test_asof_no_match_tie_same_day_and_optional_key(spark):
    req = spark.createDataFrame([
        (1, 10, None, d("2024-01-10")),   # latest before: day 9 (two rows tie -> higher row wins)
        (2, 10, 5, d("2024-01-10")),      # store given: only store 5 rows
        (3, 10, None, d("2024-01-01")),   # nothing on or before
        (4, 10, None, d("2024-01-09")),   # same day counts
        (5, None, None, d("2024-01-10")), # missing key -> no match
    ], "req long, product long, store long, day date")
    facts = spark.createDataFrame([
        (10, 5, d("2024-01-05"), 100, 1.0),
        (10, 6, d("2024-01-09"), 101, 2.0),
        (10, 6, d("2024-01-09"), 102, 3.0),
        (10, 5, d("2024-01-11"), 103, 4.0),
    ], "product long, store long, day date, row long, v double")
    out = latest_asof(req, facts, keys=["product"], optional_keys=["store"], request_date="day",
                      fact_date="day", values=["row", "v"], tiebreak=["row"], alias="hit")
    got = {r["req"]: r["hit_row"] for r in flatten(out, "hit", "hit_").collect()}
    assert got == {1: 102, 2: 100, 3: None, 4: 102, 5: None}


def test_asof_strict(spark):
    req = spark.createDataFrame([(1, 10, d("2024-01-09"))], "req long, product long, day date")
    facts = spark.createDataFrame([(10, d("2024-01-09"), 1), (10, d("2024-01-08"), 2)], "product long, day date, row long")
    out = latest_asof(req, facts, keys=["product"], request_date="day", fact_date="day", values=["row"],
                      strict=True, alias="hit")
    assert out.first()["hit"]["row"] == 2


def test_exact_quantiles_linear(spark):
    import numpy as np
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 7.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = st.exact_quantiles(st.long_numeric(df, ["x"]), ["column"], {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert [round(q[k], 9) for k in "abc"] == [round(float(np.quantile(vals, p)), 9) for p in (0.25, 0.5, 0.9)]


def test_regression_metrics_skip_rules(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 1.0), (4.0, 5.0)], "actual double, predicted double")
    m = st.regression_metrics(df).first()
    assert m["mae"] == round(2 / 3, 6) and m["mape"] == round((0.5 + 0.25) / 2 * 100, 6)
    assert m["smape"] == round((2 * 1 / 3 + 2 * 1 / 9) / 2 * 100, 6)
