from larder.operators.serving import check_schema, serving_features


def test_one_hot_serving_row(spark):
    df = spark.createDataFrame([(1, 20.0, "Dairy")], "id long, selling_price double, category string")
    row = serving_features(df, ["id"], ["selling_price", "category_Dairy", "category_Produce"]).first()
    assert [row["selling_price"], row["category_Dairy"], row["category_Produce"]] == [20.0, 1.0, 0.0]
    assert row["missing_features"] == []


def test_bad_schema_rejected():
    assert check_schema({"feature_count": 3, "feature_order": ["a", "b"]})
    assert check_schema({"feature_count": 1, "feature_order": ["units_sold"]})
    assert not check_schema({"feature_count": 2, "feature_order": ["a", "b"]})
