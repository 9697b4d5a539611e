from pyspark.sql import functions as F

from larder.functions import forecast as ff


def test_placeholder_score_is_deterministic(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "a double, b double")
    out = [r[0] for r in df.select(ff.placeholder_score(["a", "b"])).collect()]
    assert out == [15.0, 15.0]   # 10 + |1*1 + 2*2| mod 490


def test_round_units_clips_after_rounding(spark):
    df = spark.createDataFrame([(-5.0,), (12.0,), (2.5,), (3.5,)], "x double")
    out = [r[0] for r in df.select(ff.round_units("x")).collect()]
    assert out == [0, 12, 2, 4]   # half to even, then >= 0


def test_bounds_and_status(spark):
    df = spark.createDataFrame([(350,)], "p long")
    r = df.select(ff.lower_bound("p"), ff.upper_bound("p")).first()
    assert (r[0], r[1]) == (280, 420)   # spread = round(42 + 0.08 * 350) = 70
    st = spark.createDataFrame([(120, 100, 120), (115, 100, 120), (85, 100, 120), (100, 100, 120)], "v long, m long, p long")
    assert [x[0] for x in st.select(ff.demand_status("v", "m", "p")).collect()] == ["Peak", "High", "Low", "Normal"]


def test_planned_price_window(spark):
    df = spark.createDataFrame([(i,) for i in range(14)], "i int").withColumn("h", F.lit(14))
    out = [r[0] for r in df.select(ff.planned_price(F.lit(31500.0), F.lit(10.0), F.lit(True), "i", "h")).collect()]
    assert out[3:7] == [28350.0] * 4 and out[2] == 31500.0 and out[7] == 31500.0
