"""Ranks and exact quantiles over sorted runs: ties, null groups, a group that spans many runs."""

import random

import numpy as np
from pyspark.sql import functions as F

from quarry.operators.aggs import quartile_cutoff
from quarry.operators.ranks import global_rank, grouped_quantiles, rows_before, sorted_runs


def test_global_rank_equals_row_number(spark):
    rng = random.Random(4)
    rows = [(f"m{i:04d}", rng.choice([None, 0.0, 1.0, rng.random()])) for i in range(1500)]
    df = spark.createDataFrame(rows, "mun string, sales double").repartition(7)
    got = {r.mun: r["rank"] for r in global_rank(df, [F.col("sales").desc_nulls_last(), F.col("mun")]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    assert got == {m: i for i, (m, _) in enumerate(want, 1)}


def test_runs_are_several_and_offsets_add_up(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"))
    runs = sorted_runs(df.repartition(8), [F.col("x")])
    before = {r["_run"]: r["_before"] for r in rows_before(runs).collect()}
    sizes = {r["_run"]: r["count"] for r in runs.groupBy("_run").count().collect()}
    assert sum(sizes.values()) == 5000 and before == {k: sum(n for j, n in sizes.items() if j < k) for k in sizes}


def groups(spark):
    rng = random.Random(9)
    data = [("hot", rng.choice([0.25, rng.random()])) for _ in range(4000)] + [("a", 0.5), ("b", 0.1), ("b", 0.4), (None, 0.2), (None, 0.9), ("nul", None), ("c", 0.3), ("c", None), ("c", 0.3), ("c", 0.7)]
    return data, spark.createDataFrame(data, "state string, share double").repartition(6)


def test_quantiles_equal_percentile(spark):
    data, df = groups(spark)
    got = {r["_g"]: (r.q0, r.q1, r.q2) for r in grouped_quantiles(df, "state", "share", (0.25, 0.5, 0.75)).collect()}
    want = {}
    for g, v in data:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert set(got) == set(want)
    for g, v in want.items():
        np.testing.assert_allclose(got[g], np.percentile(v, [25, 50, 75]), rtol=1e-12)
    exact = {r.state: (r.a, r.b, r.c) for r in df.groupBy("state").agg(*[F.percentile("share", p).alias(n) for p, n in ((0.25, "a"), (0.5, "b"), (0.75, "c"))]).filter("a is not null").collect()}
    assert got == exact  # bit for bit


def test_cutoff_is_the_same_both_ways(spark):
    _, df = groups(spark)
    def key(d):
        return sorted(map(str, d.collect()))
    one, runs = quartile_cutoff(df, "state", "share"), quartile_cutoff(df, "state", "share", one_pass_bytes=0)
    assert key(one) == key(runs)
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


def test_empty(spark):
    none = spark.createDataFrame([], "state string, share double")
    assert global_rank(none, [F.col("share")]).count() == 0
    assert grouped_quantiles(none, "state", "share", (0.5,)).count() == 0
