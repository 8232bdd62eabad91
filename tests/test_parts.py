"""Large tables are joined and grouped in parts by their bytes."""

import pytest
from pyspark.sql import functions as F

from tillroll.operators import lattice as L
from tillroll.session import scratch_path
from tillroll.sources import files, testbed


@pytest.fixture(scope="module")
def tables(spark):
    at = scratch_path(spark, "parts")
    made = {
        "lineitem": spark.range(4000).selectExpr("id DIV 4 l_orderkey", "id % 90 l_partkey", "100.0D + id l_extendedprice",
                                                 "0.05D l_discount", "0.1D l_tax"),
        "orders": spark.range(1000).selectExpr("id o_orderkey", "id % 40 o_custkey",
                                               "CAST(date_add(DATE'1996-01-01', CAST(id AS INT)) AS TIMESTAMP_NTZ) o_orderdate"),
        "customer": spark.range(40).selectExpr("id c_custkey", "CAST(id % 3 AS INT) c_nationkey", "concat('S', id % 2) c_mktsegment"),
        "nation": spark.range(3).selectExpr("CAST(id AS INT) n_nationkey", "concat('N', id) n_name"),
        "part": spark.range(80).selectExpr("id p_partkey", "concat('a b', id % 5) p_name", "concat('B', id % 4) p_brand",
                                           "concat('T', id % 3) p_type")}
    for name, df in made.items():
        df.coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


def test_large_side_is_dealt_in_parts_by_bytes(spark, tables):
    lines, orders = (testbed.table(spark, tables, n) for n in ("lineitem", "orders"))
    size = files.leaf_bytes(lines)[0]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert files.spread_large(lines, "l_orderkey", orders, at_least=0, part_bytes=size // 7) is lines  # orders are broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = files.spread_large(lines, "l_orderkey", orders, at_least=0, part_bytes=size // 7)
        assert dealt.rdd.getNumPartitions() in (7, 8)
        assert dealt.exceptAll(lines).count() == 0 and dealt.count() == 4000
        assert files.spread_large(lines, "l_orderkey", orders) is lines  # not large
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_joins_of_large_lines_keep_parts_and_lines(spark, tables, monkeypatch):
    """The join with the orders and the one with the items: 12 parts each,
    whatever the session's number, and the same lines."""
    def lines():
        return testbed._build_sales_lines(spark, tables, True, True, True)
    want = sorted(map(str, lines().collect()))
    size = files.leaf_bytes(testbed.table(spark, tables, "lineitem"))[0]
    monkeypatch.setattr(files.spread_large, "__defaults__", (0, -(-size // 12)))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = lines()
        plan = dealt._jdf.queryExecution().toString()
        assert "RepartitionByExpression [l_orderkey" in plan and "RepartitionByExpression [l_partkey" in plan
        assert dealt.rdd.getNumPartitions() == 12
        assert sorted(map(str, dealt.collect())) == want and len(want) == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_lattice_groups_in_partitions_by_bytes(spark, tables):
    kept, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    lines = testbed._build_sales_lines(spark, tables, True, True, True)
    total = sum(files.leaf_bytes(lines))
    with files.partitions_for(lines, total // 50):
        seen.append(int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert seen[0] in (50, 51) and spark.conf.get("spark.sql.shuffle.partitions") == kept
    with files.partitions_for(lines):  # small: as it is
        assert spark.conf.get("spark.sql.shuffle.partitions") == kept
    lattice = L.build_lattice(lines, scratch_path(spark, "lattice"), ["year", "center_name", "item_type"], tables=2)
    got = lattice.lines_for(["center_name"]).groupBy("center_name").agg(F.sum("lines").alias("n")).collect()
    assert sum(r["n"] for r in got) == 4000


def test_unknown_sizes_are_left_out(spark):
    assert files.leaf_bytes(spark.range(5).select(F.rand().alias("x")).rdd.toDF("x double")) == []


def test_every_lattice_query_reads_the_tables(spark, tables, monkeypatch):
    from tillroll.plans import catalog
    built = []
    monkeypatch.setattr(catalog, "build_lattice", lambda *a, **k: built.append(1) or L.build_lattice(*a, **k))
    first = catalog.q_lattice_hierarchy(spark, tables).collect()
    second = catalog.q_lattice_center_year(spark, tables).collect()
    assert len(built) == 2 and first and second
