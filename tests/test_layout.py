from tillroll.session import scratch_path
from tillroll.operators.sales import as_double, monthly_outlet
from tillroll.sources.layout import (bucket_lines_and_orders, co_located_lines,
                                     co_located_sales_lines)
from tillroll.sources.testbed import table

SF = "/root/testdata/sf0.001"


def test_bucketed_join_has_no_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        lines, dims = bucket_lines_and_orders(spark, SF, 4, prefix="t_layout",
                                              location=scratch_path(spark, "layout"))
        joined = co_located_lines(spark, lines, dims)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        assert joined.count() == table(spark, SF, "lineitem").count()
        from tillroll.sources.testbed import sales_lines
        a = as_double(monthly_outlet(co_located_sales_lines(spark, lines, dims, SF, items=False)))
        b = as_double(monthly_outlet(sales_lines(spark, SF, items=False)))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        plan = a._jdf.queryExecution().executedPlan().toString()
        # only the aggregation's own (partial-count) exchange remains
        assert plan.count("Exchange hashpartitioning") == 1, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
