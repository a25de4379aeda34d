"""Facade smoke test: file-based entry points on small synthetic files, DataFrame ones on driver views."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.cases.c_panel import prices
from quarry.plans.project import Paths, Project
from quarry.sources.fixtures import CENSUS_SHORT, Fixtures
from quarry.sources.readers import scratch_path
from tests.conftest import SCENARIOS, SF_SMALL


@pytest.fixture(scope="module")
def files(spark):
    base = scratch_path(spark, "facade").replace("file:", "")
    os.makedirs(base)
    # price sheet with a two-row (year, month) header and a national row
    with open(os.path.join(base, "regular.csv"), "w") as f:
        f.write("ENTIDAD,2020,,2021\n,ENE,FEB,ENE\nNacional,20.0,21.0,22.0\nA,19.0,20.5,21.0\nB,21.0,22.0,23.0\n")
    with open(os.path.join(base, "daily.csv"), "w") as f:
        f.write("date,regular\n01/01/2020,19.5\n15/01/2020,20.5\n01/02/2020,21.0\n10/01/2021,22.5\n")
    with open(os.path.join(base, "demand.csv"), "w") as f:
        f.write("Estado,2020,2021\nA,100.0,110.0\nB,,90.0\n")
    return base


def test_price_sheet_and_daily_prices(spark, files):
    p = Project(spark, Paths(prices={"regular": os.path.join(files, "regular.csv")}))
    sheet = p.get_prices("regular")
    assert sheet.count() == 9
    daily = spark.read.option("header", True).csv(os.path.join(files, "daily.csv")) \
        .withColumn("regular", F.col("regular").cast("double"))
    out = {(str(r.date), r.state): r.price for r in p.retrieve_daily_avg_prices("regular", daily).collect()}
    # reference curve: national monthly / national daily
    assert abs(out[("2020-01-01", "A")] - 19.0 * 20.0 / 19.5) < 1e-12
    assert len(p.get_price_dataframe(daily).collect()) == len(out)


def test_demand_wide_to_long(spark, files):
    p = Project(spark, Paths(demand=os.path.join(files, "demand.csv")))
    d = {(r.state, r.year): r.BBL for r in p.get_demand([2020, 2021]).collect()}
    assert d[("A", 2020)] == 100000.0 and d[("B", 2020)] is None


def test_panel_methods(spark):
    fx = Fixtures(spark, SF_SMALL)
    p = Project(spark, Paths())
    panel = p.create_fuel_dataframe(fx.population, fx.demand, prices(fx), 1998)
    assert panel.columns == ["state", "mun", "lat", "lon", "date", "price", "litres"]
    assert Project.plot_monthly_data(panel).count() > 0
    assert Project.get_timeseries(fx.panel).count() == fx.panel.count()
    assert Project.window_generator(fx.panel, 5).count() > 0
    assert Project.test_df(fx.panel, 10).filter("price is not null").count() > 0
    fc = Project.forecast(fx.panel, 10, 5)
    assert fc.count() > 0
    out, periods = Project.annual_data(fx.panel, 3)
    assert out.count() > 0 and periods.count() > 0


@pytest.mark.skipif(not os.path.isdir(SCENARIOS), reason="scenario data not present")
def test_valuation_methods(spark):
    p = Project(spark, Paths(results=os.path.join(SCENARIOS, "optimal")))
    runs = p.load_opt_info()
    prod, per = runs["production"], runs["periods"]
    assert Project.get_NPV_stats(prod, per, 0.1).count() == 8
    assert Project.sensitivity_diagram(prod, per, 0.1).count() > 0
    sims = Project.mc_simulation(prod, per, 0.1, 50)
    capex = prod.filter(F.col("T") == 0).select("plant", "capex")
    assert Project.real_opt_valuation(prod, sims, capex).count() == 8
    up = p.load_opt_valuation(os.path.join(SCENARIOS, "optimal"), os.path.join(SCENARIOS, "baseline"))
    assert up["production"].count() == 20 * 99 and up["objective"].count() == 20 and up["market"] is None
    obj = runs["objective"]
    assert Project.plot_objective_hist(obj, 5).agg(F.sum("n")).first()[0] == 20
