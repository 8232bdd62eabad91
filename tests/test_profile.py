"""Profiles from states by file."""

import time

from pyspark.sql import functions as F

from tillroll.operators import profile as P
from tillroll.operators.sales import column_profile
from tillroll.session import scratch_path

COLUMNS = ["center_name", "item_name", "year", "no_such_column"]


def test_states_add_up_and_only_new_files_are_read(spark, lines, monkeypatch):
    base = scratch_path(spark, "profile one")  # a blank in the path
    data, states = f"{base}/data", f"{base}/states"
    some = lines.select("center_name", "item_name", "year").withColumn(
        "center_name", F.when(F.col("year") != "1996", F.col("center_name")))
    some.where("year < '1997'").repartition(3).write.parquet(data)
    assert P.refresh_states(spark, data, states, COLUMNS) == len(spark.read.parquet(data).inputFiles())
    assert P.refresh_states(spark, data, states, COLUMNS) == 0
    some.where("year >= '1997'").repartition(2).write.mode("append").parquet(data)
    read, load = [], spark.read.format("parquet").__class__.load
    monkeypatch.setattr(spark.read.__class__, "load", lambda self, path=None, *a, **k: read.append(path) or load(self, path, *a, **k))
    assert P.refresh_states(spark, data, states, COLUMNS) == 2
    assert [len(p) for p in read if isinstance(p, list)] == [2]
    got = {r["column_name"]: r for r in P.profile_of(P.read_states(spark, states)).collect()}
    want = {r["column_name"]: r for r in column_profile(some, COLUMNS[:3]).collect()}
    assert got.keys() == want.keys()
    for c, w in want.items():
        assert got[c]["rows"] == w["rows"] and got[c]["low_cardinality"] == w["low_cardinality"]
        assert abs(got[c]["distinct_values"] - w["distinct_values"]) <= 0.05 * w["distinct_values"]
        low = some.agg(F.min(c), F.max(c), F.count_if(F.col(c).isNull())).first()
        assert (got[c]["min_value"], got[c]["max_value"], got[c]["nulls"]) == tuple(low)


def test_error_bound_of_many_values(spark):
    df = spark.range(200_000).select(F.concat(F.lit("v"), "id").alias("v"), F.lit("f").alias("src"), F.lit(None).cast("string").alias("none"))
    halves = df.where("v < 'v5'").withColumn("src", F.lit("a")).unionByName(df.where("v >= 'v3'").withColumn("src", F.lit("b")))
    got = {r["column_name"]: r for r in P.profile_of(P.file_states(halves, ["v", "none"], "src")).collect()}
    # five standard errors; values that both files have count once
    assert abs(got["v"]["distinct_values"] - 200_000) <= 5 * 1.04 / 2 ** (P.LOG_K / 2) * 200_000
    assert (got["none"]["distinct_values"], got["none"]["nulls"], got["none"]["min_value"]) == (0, got["none"]["rows"], None)


def test_a_changed_file_and_an_empty_one(spark):
    base = scratch_path(spark, "profile")
    data, states = f"{base}/data", f"{base}/states"
    at = data.replace("file:", "")
    one = lambda v: spark.createDataFrame([(x,) for x in v], "v string")
    one("abc").coalesce(1).write.parquet(data)
    assert P.refresh_states(spark, data, states, ["v"]) == 1
    one([]).coalesce(1).write.mode("append").parquet(data)
    assert P.refresh_states(spark, data, states, ["v"]) == 1 and P.refresh_states(spark, data, states, ["v"]) == 0
    import glob
    import shutil
    other = f"{base}/other"
    one(["x", "y", "y", None]).coalesce(1).write.parquet(other)
    old = next(f for f in glob.glob(f"{at}/*.parquet") if spark.read.parquet(f).count() == 3)
    time.sleep(1.1)
    shutil.copyfile(glob.glob(other.replace("file:", "") + "/*.parquet")[0], old)
    crc = glob.glob(f"{at}/.{old.rsplit('/', 1)[1]}.crc")
    for c in crc:  # the checksum of the file that was replaced
        shutil.copyfile(glob.glob(other.replace("file:", "") + "/.part*.crc")[0], c)
    assert P.refresh_states(spark, data, states, ["v"]) == 1
    got = P.profile_of(P.read_states(spark, states)).first()
    assert (got["rows"], got["nulls"], got["min_value"], got["max_value"], got["distinct_values"]) == (4, 1, "x", "y", 2)
