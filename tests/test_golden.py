"""Golden values from the shipped scenario results (read as plain data; skipped when absent).

"""

import os

import pytest
from pyspark.sql import functions as F

from quarry.plans import valuation as V
from quarry.sources.readers import read_scenarios
from tests.conftest import SCENARIOS

pytestmark = pytest.mark.skipif(not os.path.isdir(SCENARIOS), reason="scenario data not present")


@pytest.fixture(scope="module")
def runs(spark):
    return {m: read_scenarios(spark, os.path.join(SCENARIOS, m)) for m in ("baseline", "optimal")}


def test_reader_shapes(runs):
    prod = runs["optimal"]["production"]
    assert prod.count() == 20 * 99
    assert prod.select("file").distinct().count() == 20
    assert runs["optimal"]["market"] is None
    # utilisation: inf kept through positiveInf, empty cells NULL
    assert prod.filter(F.col("utilization").isNotNull()).count() > 0


@pytest.mark.parametrize("mode", ["baseline", "optimal"])
def test_objective_recomputed(runs, mode):
    prod, obj = runs[mode]["production"], runs[mode]["objective"]
    mine = V.plan_objective(prod, 0.10).withColumnRenamed("objective", "mine")
    j = mine.join(obj, "file").select(F.max(F.abs(F.col("mine") / F.col("objective") - 1)).alias("d")).first()
    assert j.d < 1e-12


@pytest.mark.parametrize("mode,mean", [("baseline", 1582912099314.231), ("optimal", 2238063763043.784)])
def test_objective_mean(runs, mode, mean):
    m = runs[mode]["objective"].agg(F.avg("objective")).first()[0]
    assert abs(m / mean - 1) < 1e-12


def test_npv_stats_optimal(runs):
    s = V.npv_stats(runs["optimal"]["production"], runs["optimal"]["periods"], 0.10, "Refinery")
    got = {r.plant: r for r in s.collect()}
    assert abs(got["Dos Bocas Refinery"].NPV_ebitda_mean / 1.883909e12 - 1) < 1e-6
    assert abs(got["Tula Refinery"].NPV_fcf_mean / 2.789235e11 - 1) < 1e-6
    assert abs(got["Madero Refinery"].NPV_ebitda_std / 3.319627e10 - 1) < 1e-6
    assert got["Cangrejera Refinery"].NPV_fcf_mean == 0
    assert "Imports" not in got


def test_uplift_j11(runs):
    keys = ["file", "T", "plant"]
    meas = ["revenues", "costs", "capex", "depreciation", "ebitda", "fcf_wo_nwc"]
    up = V.scenario_difference(runs["optimal"]["production"], runs["baseline"]["production"], keys, meas)
    s = V.npv_stats(up, runs["optimal"]["periods"], 0.10, "Refinery")
    got = {r.plant: r for r in s.collect()}
    assert abs(got["Cadereyta Refinery"].NPV_ebitda_mean / 1.639432e11 - 1) < 1e-6
    assert abs(got["Salina Cruz Refinery"].NPV_fcf_std / 2.339961e09 - 1) < 1e-6


def test_volatility(runs):
    v = {r.plant: r.vol for r in V.ebitda_volatility(runs["optimal"]["production"]).collect()}
    assert abs(v["Minatitlan Refinery"] - 0.144597) < 1e-6
    assert abs(v["Imports"] - 0.022924) < 1e-6
    assert v["Cangrejera Refinery"] == 0


def test_identities(runs):
    p = runs["optimal"]["production"].unionByName(runs["baseline"]["production"])
    d = p.select(
        F.max(F.abs(F.col("nopat") - 0.65 * (F.col("ebitda") - F.col("depreciation")))).alias("a"),
        F.max(F.abs(F.col("fcf_wo_nwc") - (F.col("nopat") + F.col("depreciation") - F.col("capex")))).alias("b"),
    ).first()
    assert d.a < 1e-3 and d.b < 1e-3


def test_objective_uplift_j11(runs):
    d = V.scenario_difference(runs["optimal"]["objective"], runs["baseline"]["objective"], ["file", "step"],
                              ["objective"])
    row = d.agg(F.avg("objective").alias("m"), F.stddev_samp("objective").alias("s"),
                F.count("objective").alias("n")).first()
    assert row.n == 20
    assert abs(row.m / 655151663729.553 - 1) < 1e-12
    assert abs(row.s / 185720209609.0243 - 1) < 1e-9


@pytest.mark.parametrize("mode,sd,lo,hi", [
    ("baseline", 604362187272.4336, 1049231112533.411, 2574362027970.0635),
    ("optimal", 418684859032.437, 1863521723466.1855, 2929675597075.921)])
def test_objective_spread(runs, mode, sd, lo, hi):
    r = runs[mode]["objective"].agg(F.stddev_samp("objective").alias("s"), F.min("objective").alias("lo"),
                                    F.max("objective").alias("hi")).first()
    assert abs(r.s / sd - 1) < 1e-9 and r.lo == lo and r.hi == hi


def test_volatility_all_plants(runs):
    want = {"Cadereyta Refinery": 0.095437, "Cangrejera Refinery": 0.0, "Dos Bocas Refinery": 0.07037,
            "Imports": 0.022924, "Madero Refinery": 0.079879, "Minatitlan Refinery": 0.144597,
            "Salamanca Refinery": 0.136214, "Salina Cruz Refinery": 0.091129, "Tula Refinery": 0.123921}
    got = {r.plant: r.vol for r in V.ebitda_volatility(runs["optimal"]["production"]).collect()}
    for k, v in want.items():
        assert abs(got[k] - v) < 5e-6, k


NPV_OPTIMAL = {
    "Cadereyta Refinery": (7.670358e+11, 9.304511e+09, 4.867981e+11, 6.047932e+09),
    "Dos Bocas Refinery": (1.883909e+12, 1.474560e+10, 1.084808e+12, 9.584638e+09),
    "Madero Refinery": (3.666031e+11, 3.319627e+10, 2.249468e+11, 1.585625e+10),
    "Minatitlan Refinery": (4.625562e+11, 1.450605e+10, 2.928114e+11, 9.428930e+09),
    "Salamanca Refinery": (3.874549e+11, 5.112288e+09, 2.439956e+11, 3.322987e+09),
    "Salina Cruz Refinery": (5.634743e+11, 2.674602e+09, 3.584082e+11, 1.738491e+09),
    "Tula Refinery": (4.532673e+11, 6.655194e+09, 2.789235e+11, 4.325876e+09),
}
NPV_UPLIFT = {
    "Cadereyta Refinery": (1.639432e+11, 8.714163e+09, 9.478787e+10, 5.664206e+09),
    "Dos Bocas Refinery": (1.883909e+12, 1.474560e+10, 1.084808e+12, 9.584638e+09),
    "Madero Refinery": (6.153647e+10, 3.280668e+10, 2.665349e+10, 1.561346e+10),
    "Minatitlan Refinery": (1.401178e+11, 1.473813e+10, 8.322647e+10, 9.579785e+09),
    "Salamanca Refinery": (7.672785e+10, 5.375285e+09, 4.202297e+10, 3.493936e+09),
    "Salina Cruz Refinery": (8.702730e+10, 3.599939e+09, 4.871762e+10, 2.339961e+09),
    "Tula Refinery": (8.284246e+10, 6.767927e+09, 3.814734e+10, 4.399152e+09),
}


@pytest.mark.parametrize("which", ["optimal", "uplift"])
def test_npv_table(runs, which):
    prod = runs["optimal"]["production"]
    if which == "uplift":
        meas = ["revenues", "costs", "capex", "depreciation"]
        prod = V.scenario_difference(prod, runs["baseline"]["production"], ["file", "T", "plant"], meas)
    want = NPV_OPTIMAL if which == "optimal" else NPV_UPLIFT
    got = {r.plant: r for r in V.npv_stats(prod, runs["optimal"]["periods"], 0.10, "Refinery").collect()}
    for plant, (em, es, fm, fs) in want.items():
        r = got[plant]
        for g, w in ((r.NPV_ebitda_mean, em), (r.NPV_ebitda_std, es), (r.NPV_fcf_mean, fm), (r.NPV_fcf_std, fs)):
            assert abs(g / w - 1) < 1e-6, (plant, g, w)
