"""Streaming scenario feed: objectives from a file stream equal the batch computation."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from quarry.plans.valuation import plan_objective
from quarry.sources.readers import read_scenarios, scratch_path
from quarry.streaming import start_objectives
from tests.conftest import SCENARIOS


@pytest.mark.skipif(not os.path.isdir(SCENARIOS), reason="scenario data not present")
def test_stream_objectives_match_batch(spark):
    base = scratch_path(spark, "stream").replace("file:", "")
    src = os.path.join(base, "in")
    os.makedirs(src)
    folder = os.path.join(SCENARIOS, "optimal", "production")
    for f in sorted(os.listdir(folder))[:6]:
        shutil.copy(os.path.join(folder, f), src)
    q = start_objectives(spark, src, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    got = {r.file: r.objective for r in spark.read.parquet(os.path.join(base, "out")).collect()}
    prod = read_scenarios(spark, os.path.join(SCENARIOS, "optimal"))["production"]
    want = {r.file: r.objective for r in plan_objective(prod, 0.10).collect()}
    assert len(got) == 6
    for k, v in got.items():
        assert abs(v / want[k] - 1) < 1e-12


@pytest.mark.skipif(not os.path.isdir(SCENARIOS), reason="scenario data not present")
def test_stream_restart_processes_only_new_files(spark):
    base = scratch_path(spark, "stream2").replace("file:", "")
    src = os.path.join(base, "in")
    os.makedirs(src)
    folder = os.path.join(SCENARIOS, "baseline", "production")
    files = sorted(os.listdir(folder))
    for f in files[:3]:
        shutil.copy(os.path.join(folder, f), src)
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "ckpt")
    start_objectives(spark, src, out, ckpt).awaitTermination(120)
    for f in files[3:5]:
        shutil.copy(os.path.join(folder, f), src)
    start_objectives(spark, src, out, ckpt).awaitTermination(120)  # same checkpoint: resumes
    got = spark.read.parquet(out)
    assert got.count() == 5 and got.select("file").distinct().count() == 5
