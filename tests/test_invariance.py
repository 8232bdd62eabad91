"""Results do not depend on partitioning, AQE or join strategy."""

import math

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["q_monthly_outlet", "q_kpis", "q_axis_order", "q_center_growth", "q_holiday_sales",
         "q_festival_performance_by_center", "q_festival_traffic", "q_center_business_top10",
         "q_service_mart", "q_column_profile", "q_upsert_latest", "q_center_year_dense"]


def canon(df):
    cols = sorted(df.columns)
    def norm(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)
    return sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_same_result_under_other_physical_settings(spark, name):
    base = canon(E.queries()[name](spark, SF))
    settings = {"spark.sql.shuffle.partitions": "3", "spark.sql.adaptive.enabled": "false",
                "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        other = canon(E.queries()[name](spark, SF))
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert other == base
