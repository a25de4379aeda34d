"""Joins of bucketed tables need no shuffle of either side, and the tables are written once."""

import os

from quarry.cases.c_sources import order_lines
from quarry.sources import readers as RD
from quarry.sources.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


def test_join_of_bucketed_tables_has_no_exchange(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = order_lines(Fixtures(spark, SF), 8)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_table_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(100).withColumnRenamed("id", "k")
    for _ in range(2):
        t = RD.bucketed_table(spark, "quarry_once", build, "k", 4, str(tmp_path / "once"))
    assert len(calls) == 1 and t.count() == 100
    assert len([f for f in os.listdir(tmp_path / "once") if f.endswith(".parquet")]) <= 4
    spark.sql("DROP TABLE quarry_once")
