"""Facade: one object exposing the project's table-valued operations by name.

``Project(spark, paths)`` mirrors the session object of the original
project: every table-valued attribute becomes a method returning a lazy
DataFrame (charts become the tables behind them).  ``paths`` names the input
files; nothing is read until a method is called, and nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.exprs import calendar_features
from quarry.operators import clean as C
from quarry.operators import forecast as FC
from quarry.operators import windows as W
from quarry.operators.aggs import histogram, market_view, two_stage_stats
from quarry.operators.reshape import wide_to_long
from quarry.plans import audit as AU
from quarry.plans import census as CE
from quarry.plans import costing as CO
from quarry.plans import panel as PN
from quarry.plans import valuation as V
from quarry.sources import readers as RD


@dataclass
class Paths:
    census: str | None = None          # census block CSVs (glob)
    coords: str | None = None          # '|' separated, windows-1252
    economy: str | None = None         # economic census CSVs
    demand: str | None = None          # wide demand by year
    prices: dict = field(default_factory=dict)   # product -> two-row-header sheet
    daily_prices: str | None = None    # national daily prices (date dd/MM/yyyy, one column per product)
    sites: str | None = None           # plant sites
    results: str | None = None         # scenario result folder of one mode


class Project:
    def __init__(self, spark: SparkSession, paths: Paths, measures=None, economy_schema=None,
                 coords_schema=None, sites_schema=None):
        self.spark, self.paths = spark, paths
        self.measures = list(measures or [])
        self.economy_schema, self.coords_schema, self.sites_schema = economy_schema, coords_schema, sites_schema

    # ------------------------------------------------------------ census and demography
    def deomgraphics(self, short: bool = True) -> DataFrame:  # (sic) name kept for drop-in use
        df = RD.read_census(self.spark, self.paths.census, self.measures)
        df = C.clean_sentinels(df, self.measures)
        return C.label_missing(df, ["NOM_ENT", "NOM_MUN", "NOM_LOC"])

    demographics = deomgraphics

    def coords(self) -> DataFrame:
        return RD.read_delimited(self.spark, self.paths.coords, self.coords_schema, "|", "windows-1252")

    def economics(self) -> DataFrame:
        return RD.read_delimited(self.spark, self.paths.economy, self.economy_schema, ",", "UTF-8")

    def get_inegi(self, catalogue: DataFrame | None = None, economy_measures=()) -> DataFrame:
        """V05; with the activity catalogue and the measures' names, the economy side is joined on.  The
        activity labels become columns and are listed by a distinct query over the rolled-up table."""
        economy = None
        if catalogue is not None:
            roll = CE.activity_rollup(CE.economic_normaliser(self.economics(), catalogue, economy_measures), economy_measures)
            labels = [r[0] for r in roll.select("ACTIVIDAD").distinct().orderBy("ACTIVIDAD").collect()]
            economy = CE.activity_wide(roll, economy_measures, labels)
        return CE.municipal_indicators(self.deomgraphics(), self.coords(), economy=economy)

    def get_pop(self) -> DataFrame:
        return self.get_inegi().select(*CE.MUN_KEYS, F.col("POBTOT").alias("pop"),
                                       F.col("TVIVPARHAB").alias("hab_houses"),
                                       F.col("VPH_AUTOM").alias("cars"), "lat", "lon")

    # ------------------------------------------------------------ demand and prices
    def get_demand(self, years) -> DataFrame:
        schema = "Estado string, " + ", ".join(f"`{y}` double" for y in years)  # DDL schema string
        wide = RD.read_delimited(self.spark, self.paths.demand, schema, ",", "UTF-8")
        long = wide_to_long(wide.withColumnRenamed("Estado", "state"), ["state"], [str(y) for y in years],
                            "year", "volume", "int")
        return long.withColumn("BBL", F.col("volume") * C.BARRELS_PER_THOUSAND)

    def get_prices(self, product: str) -> DataFrame:
        return RD.read_two_row_header(self.spark, self.paths.prices[product])

    def retrieve_daily_avg_prices(self, product: str, daily: DataFrame, mode: str = "reference") -> DataFrame:
        sheet = self.get_prices(product).withColumn("month", C.month_number(F.col("month_str")))
        nat = sheet.filter(F.col("ENTIDAD") == "Nacional").select("year", "month", "price")
        st = sheet.filter(F.col("ENTIDAD") != "Nacional").select(F.col("ENTIDAD").alias("state"), "year", "month",
                                                                  "price")
        nd = daily.select(C.parse_dmy(F.col("date")).alias("date"), F.col(product).alias("price"))
        return PN.daily_state_prices(st, nat, nd, mode)

    def get_price_dataframe(self, daily: DataFrame) -> DataFrame:
        return PN.mean_price([self.retrieve_daily_avg_prices(p, daily) for p in self.paths.prices])

    def calc_fpc(self, pop: DataFrame, demand: DataFrame, year: int, inputs=("pop", "cars", "hab_houses")):
        filled, model = PN.fill_by_regression(PN.state_rollup(pop, demand, year), list(inputs))
        return PN.per_head_fuel(pop, filled), model

    def calc_consumption_data(self, pop, demand, prices, year, min_share=0.1, keep_above=0.9, aggregated=True):
        return PN.consumption_table(pop, demand, prices, year, min_share=min_share, keep_above=keep_above,
                                    aggregated=aggregated)

    def create_fuel_dataframe(self, pop, demand, prices, year, min_share=0.1, keep_above=0.9) -> DataFrame:
        loc, model, _ = self.calc_consumption_data(pop, demand, prices, year, min_share, keep_above)
        return PN.fuel_panel(loc, model, prices)

    @staticmethod
    def plot_monthly_data(panel: DataFrame) -> DataFrame:
        return panel.groupBy(F.trunc("date", "MM").alias("month")).agg(F.avg("price").alias("price"),
                                                                        F.sum("litres").alias("litres"))

    # ------------------------------------------------------------ time series
    @staticmethod
    def get_timeseries(panel: DataFrame, mode: str = "default") -> DataFrame:
        """Panel in long form with the cyclic calendar features (the wide pivot is left to the output edge)."""
        return panel.select("*", *calendar_features(F.col("date"), mode))

    @staticmethod
    def window_generator(panel: DataFrame, length: int, label_width: int = 1, test_size: float = 0.2):
        split = W.chronological_split(panel, "date", test_size)
        return W.sliding_windows(split, ["state", "mun", "split"], "date", ["price", "litres"], length, label_width)

    @staticmethod
    def forecast(panel: DataFrame, width: int, horizon: int | None = None, model: str = "drift", saturate: bool = True,
                 normalize_target=None, init_date=None, final_date=None) -> DataFrame:
        """M06.  ``init_date`` / ``final_date``: the same calendar for every location.  ``normalize_target``:
        a function of the forecast-date column giving the national total of the day."""
        if normalize_target is not None or init_date is not None or final_date is not None:
            return FC.forecast_calendar(panel, ["state", "mun"], width, horizon, target=normalize_target, saturate=saturate,
                                        init_date=init_date, final_date=final_date, model=model)
        return FC.forecast(panel, ["state", "mun"], "date", ["price", "litres"], width, horizon, model, saturate)

    @staticmethod
    def test_df(panel: DataFrame, width: int = 28, test_size: float = 0.2) -> DataFrame:
        """M06 one step ahead over the held-out tail of the panel: predicted price and volume per location and day."""
        tail = W.chronological_split(panel, "date", test_size).filter(F.col("split") == "test").select("state", "mun", "date")
        return tail.join(FC.one_step_drift(panel, ["state", "mun"], "date", ["price", "litres"], width), ["state", "mun", "date"])

    @staticmethod
    def run_backtest(obs: DataFrame, pred: DataFrame, history: DataFrame) -> DataFrame:
        return FC.revenue_mape(obs, pred, history, ["state", "mun"])

    @staticmethod
    def annual_data(panel: DataFrame, n_scenarios: int, seed: int = 0, final_date=None, init_date=None, width: int = 56):
        """M08 by year; with ``final_date`` from shocked forecasts up to that day, else from the panel's own days."""
        return Project._periods(panel, n_scenarios, seed, "year", final_date, init_date, width)

    @staticmethod
    def monthly_data(panel: DataFrame, n_scenarios: int, seed: int = 0, final_date=None, init_date=None, width: int = 56):
        return Project._periods(panel, n_scenarios, seed, "month", final_date, init_date, width)

    @staticmethod
    def _periods(panel, n_scenarios, seed, grain, final_date, init_date, width):
        if final_date is None:
            return FC.scenario_panels(panel, n_scenarios, seed, grain)
        return FC.forecast_scenarios(panel, ["state", "mun"], width, n_scenarios, seed=seed, grain=grain, init_date=init_date, final_date=final_date)

    # ------------------------------------------------------------ costing
    def get_refinery_data(self) -> DataFrame:
        return RD.read_delimited(self.spark, self.paths.sites, self.sites_schema, ",", "UTF-8")

    @staticmethod
    def get_distances(sites: DataFrame, markets: DataFrame) -> DataFrame:
        return CO.lane_distances(sites, markets)

    @staticmethod
    def build_freight_costs(sites, markets, mxn_per_ton_km, pair_rates=None, state_rates=None) -> DataFrame:
        lanes = CO.lane_distances(sites, markets)
        return CO.freight_costs(lanes, CO.base_rate(mxn_per_ton_km), pair_rates, state_rates, markets, sites)

    fix_freight = staticmethod(CO.freight_costs)
    production_timeseries = staticmethod(CO.site_costs)
    market_block_rule = staticmethod(CO.market_sourcing)
    plant_block_rule = staticmethod(CO.plant_waterfall)
    audit_plan = staticmethod(AU.audit_plan)
    audit_markets = staticmethod(AU.audit_markets)

    @staticmethod
    def retrieve_opt_info(sales, sourcing, site_cost, demand, decisions=None, projects=None):
        margins, unmet = CO.market_margin(sales, sourcing, demand)
        return margins, unmet, CO.plant_waterfall(site_cost, margins, decisions, projects), CO.lane_summary(sourcing)

    def load_opt_info(self, base: str | None = None) -> dict:
        return RD.read_scenarios(self.spark, base or self.paths.results)

    def load_opt_valuation(self, optimal: str, baseline: str) -> dict:
        """J11 for every result kind that both sets have: ``market``, ``production`` and ``objective`` as
        optimal minus baseline; ``demand`` and ``periods`` are the optimal set's own."""
        a, b = RD.read_scenarios(self.spark, optimal), RD.read_scenarios(self.spark, baseline)
        keys = {"market": ["file", "T", "mun", "plant"], "production": ["file", "T", "plant"], "objective": ["file", "step"]}
        out = {"demand": a["demand"], "periods": a["periods"]}
        for kind, key in keys.items():
            both = a[kind] is not None and b[kind] is not None
            out[kind] = V.scenario_difference(a[kind], b[kind], key, [c for c in a[kind].columns if c not in key]) if both else None
        return out

    # ------------------------------------------------------------ valuation (chart tables included)
    plot_objective_hist = staticmethod(lambda objective, bins=20: histogram(objective, "objective", bins))
    plot_plant_production_plan = staticmethod(V.mean_plan)
    plot_plant_capex_plan = staticmethod(V.mean_capex_plan)
    plot_market_consumption = staticmethod(market_view)
    plot_plant_performance = staticmethod(V.plant_performance)
    get_NPV_stats = staticmethod(V.npv_stats)
    get_NPV_sensitivity = staticmethod(V.npv_sensitivity)
    sensitivity_diagram = staticmethod(lambda production, periods, wacc: V.sensitivity_deltas(
        V.npv_sensitivity(production, periods, wacc)))
    mc_simulation = staticmethod(V.mc_simulation)
    real_opt_valuation = staticmethod(V.real_option_valuation)
    scenario_stats = staticmethod(two_stage_stats)
