from pyspark.sql import functions as F

from larder.functions import names as nm
from larder.functions import parsing as ps


def col_values(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_normalize_name_variants(spark):
    out = col_values(spark, ["Units Sold", "units-sold", "units sold", "UNITS_SOLD", "  __Units  Sold__ "],
                     nm.normalize_name)
    assert out == ["units_sold"] * 5


def test_sanitize_filename(spark):
    out = col_values(spark, ["../../July Sales (final).CSV", "sales.xlsx", "", "a\x00b.csv", ".csv"],
                     nm.sanitize_filename)
    assert out == ["July_Sales_final.csv", None, None, None, None]


def test_category_token_keeps_case_and_unicode(spark):
    out = col_values(spark, ["Fresh produce", "Café & Bar", "  ", "--"], nm.category_token)
    assert out == ["Fresh_produce", "Café_Bar", "EMPTY", "EMPTY"]


def test_feature_token(spark):
    out = col_values(spark, ["Fresh Produce", "Dairy", "__Mid-West__"], nm.feature_token)
    assert out == ["fresh_produce", "dairy", "mid_west"]


def test_parse_boolean(spark):
    out = col_values(spark, ["true", " YES ", "0", "n", "maybe", None], ps.parse_boolean)
    assert out == [True, True, False, False, None, None]


def test_parse_date_formats(spark):
    out = col_values(spark, ["2026-01-02", "01/02/2026", "02-01-2026", "2026-01-02 10:00:00", "invalid", None],
                     ps.parse_date)
    assert [str(x) if x else None for x in out] == ["2026-01-02"] * 4 + [None, None]


def test_parse_array(spark):
    out = col_values(spark, ["[1 0, 1]", "[]", None], ps.parse_array)
    assert out == [[1.0, 0.0, 1.0], [], []]
