import pytest

from tillroll.functions.classify import category, service_type


@pytest.mark.parametrize("item_type,cat,sub,name,expected", [
    ("Product", "Hair Color", None, None, "Product"),
    ("Service", "Hair Color", None, None, "Hair"),
    ("Service", None, None, "Blowdry", "Hair"),
    ("Service", None, "Cleanup", None, "Skin"),
    ("Service", "face care", None, None, "Skin"),
    ("Service", None, None, "Face pack", "Other Services"),
    ("Service", None, None, "Massage", "SPA"),
    (None, None, None, None, "Other Services"),
    ("Service", "Spa", "Haircut", None, "Hair"),
])
def test_service_type(spark, item_type, cat, sub, name, expected):
    df = spark.createDataFrame([(item_type, cat, sub, name)],
                               "item_type string, item_category string, item_subcategory string, item_name string")
    out = df.select(service_type().alias("s"), category("item_type").alias("c")).first()
    assert out["s"] == expected
    assert out["c"] == ("Product" if item_type == "Product" else "Service")


def test_keywords_are_data(spark):
    df = spark.createDataFrame([("Service", None, None, "gear box")],
                               "item_type string, item_category string, item_subcategory string, item_name string")
    kw = [("Tools", [], [], ["gear"])]
    assert df.select(service_type(keywords=kw).alias("s")).first()["s"] == "Tools"
