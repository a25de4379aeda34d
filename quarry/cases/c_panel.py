"""Cases for the price / volume panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.cases import case, r
from quarry.operators.aggs import collapse_small, quartile_cutoff
from quarry.plans import panel as PN
from quarry.sources.fixtures import with_views

YEAR = 1998
FLAGS = ("A", "N", "R")  # the three products: one per return flag


def prices(fx):
    # all three products priced in one pass (product = flag column), then averaged
    return fx.memo("prices", lambda: PN.mean_price(PN.daily_state_prices(*fx.product_prices(), keys=["flag"])))


def consumption(fx, aggregated=True):
    return fx.memo(f"consumption-{aggregated}", lambda: PN.consumption_table(
        fx.population, fx.demand, prices(fx), YEAR, aggregated=aggregated))


# ------------------------------------------------------------------ SQL chain (named CTEs, in order)
def _product_sql(f: str) -> dict[str, str]:
    px = "sum(e) / NULLIF(sum(q), 0) AS price"
    return {
        f"nd_{f}": f"SELECT date, {px} FROM price_base WHERE flag = '{f}' GROUP BY date",
        f"nm_{f}": f"SELECT year(date) AS year, month(date) AS month, {px} FROM price_base WHERE flag = '{f}' "
                   "GROUP BY 1, 2",
        f"sm_{f}": f"SELECT state, year(date) AS year, month(date) AS month, {px} FROM price_base "
                   f"WHERE flag = '{f}' GROUP BY 1, 2, 3",
        f"v01_{f}": f"SELECT nd.date, sm.state, sm.price * (nm.price / NULLIF(nd.price, 0)) AS price "
                    f"FROM nd_{f} nd JOIN nm_{f} nm ON year(nd.date) = nm.year AND month(nd.date) = nm.month "
                    f"JOIN sm_{f} sm ON sm.year = nm.year AND sm.month = nm.month",
    }


CHAIN: dict[str, str] = {}
for _f in FLAGS:
    CHAIN.update(_product_sql(_f))
CHAIN["prices"] = ("SELECT date, state, avg(price) AS price FROM (" +
                   " UNION ALL ".join(f"SELECT date, state, price FROM v01_{f}" for f in FLAGS) +
                   ") u GROUP BY date, state")
CHAIN["sd"] = (f"SELECT d.state, d.volume * 1000.0 AS BBL, p.pop, p.hab_houses, p.cars FROM demand d JOIN "
               "(SELECT state, sum(pop) AS pop, sum(hab_houses) AS hab_houses, sum(cars) AS cars FROM population "
               f"WHERE state IS NOT NULL GROUP BY state) p USING (state) WHERE d.year = {YEAR}")
CHAIN["filled1"] = ("SELECT state, coalesce(BBL, regr_intercept(BBL, pop) OVER () + regr_slope(BBL, pop) OVER () "
                    "* pop) AS BBL, pop, hab_houses, cars, regr_r2(BBL, pop) OVER () AS r2 FROM sd")
# three inputs: Cramer's rule on the centred normal equations of the complete states
_X = PN.FUEL_INPUTS
CHAIN["nrm"] = ("SELECT avg(BBL) AS ym, var_pop(BBL) AS yv, " + ", ".join(f"avg({x}) AS m{i}" for i, x in enumerate(_X)) + ", "
                + ", ".join(f"covar_pop({x}, {y}) AS a{i}{j}" for i, x in enumerate(_X) for j, y in enumerate(_X)) + ", "
                + ", ".join(f"covar_pop({x}, BBL) AS c{i}" for i, x in enumerate(_X))
                + " FROM sd WHERE BBL IS NOT NULL AND " + " AND ".join(f"{x} IS NOT NULL" for x in _X))


def _det(m):
    return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
            f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")


_A = [[f"a{i}{j}" for j in range(3)] for i in range(3)]
CHAIN["fit"] = ("SELECT *, ym - b0 * m0 - b1 * m1 - b2 * m2 AS b, (b0 * c0 + b1 * c1 + b2 * c2) / NULLIF(yv, 0) AS r2 FROM (SELECT *, "
                + ", ".join(f"{_det([[f'c{i}' if j == k else _A[i][j] for j in range(3)] for i in range(3)])} / NULLIF({_det(_A)}, 0) AS b{k}"
                            for k in range(3)) + " FROM nrm) n")
CHAIN["filled"] = ("SELECT s.state, coalesce(s.BBL, f.b + " + " + ".join(f"f.b{i} * s.{x}" for i, x in enumerate(_X))
                   + ") AS BBL, s.pop, s.hab_houses, s.cars, f.r2 FROM sd s, fit f")
CHAIN["loc"] = ("SELECT p.*, f.BBL / NULLIF(f.pop, 0) * p.pop AS MUN_FUEL FROM population p "
                "LEFT JOIN filled f USING (state)")
CHAIN["shares"] = ("SELECT state, fuel / NULLIF(sum(fuel) OVER (), 0) AS share FROM "
                   "(SELECT state, sum(MUN_FUEL) AS fuel FROM loc GROUP BY state) g")
CHAIN["dem"] = ("SELECT d.state, d.year, coalesce(d.volume, sum(d.volume) OVER (PARTITION BY d.year) * s.share * "
                "exp(coalesce(sum(CASE WHEN d.volume IS NULL THEN ln(1.0 + s.share) END) OVER (PARTITION BY d.year "
                "ORDER BY d.state ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))) AS volume, "
                "d.volume IS NULL AS synthetic FROM demand d LEFT JOIN shares s USING (state)")
CHAIN["yearly_price"] = "SELECT CAST(year(date) AS INTEGER) AS year, state, avg(price) AS price FROM prices GROUP BY 1, 2"
CHAIN["el"] = ("SELECT * FROM (SELECT d.year, d.state, d.volume * 1000.0 AS BBL, y.price FROM dem d "
               "JOIN yearly_price y USING (year, state)) x WHERE BBL IS NOT NULL AND price IS NOT NULL")
CHAIN["model"] = ("SELECT state, regr_intercept(BBL, price) AS intercept, regr_slope(BBL, price) AS slope, "
                  "regr_r2(BBL, price) AS r2, count(*) AS n FROM el GROUP BY state")
CHAIN["loc2"] = "SELECT *, MUN_FUEL / NULLIF(sum(MUN_FUEL) OVER (PARTITION BY state), 0) AS state_share FROM loc"
CHAIN["cut"] = ("SELECT *, greatest(least(quantile_cont(state_share, 0.5) OVER w + 1.5 * "
                "(quantile_cont(state_share, 0.75) OVER w - quantile_cont(state_share, 0.25) OVER w), 0.9), 0.1) "
                "AS cutoff FROM loc2 WINDOW w AS (PARTITION BY state)")
CHAIN["flagged"] = "SELECT *, CAST(state_share >= cutoff AS INTEGER) AS flag FROM cut"
CHAIN["ranked"] = ("SELECT *, CAST(CASE WHEN flag = 1 THEN row_number() OVER (PARTITION BY state, flag ORDER BY mun) "
                   "ELSE 0 END AS INTEGER) AS aggregate FROM flagged")
CHAIN["v03"] = ("SELECT state, sum(CASE WHEN lat IS NOT NULL THEN lat * MUN_FUEL END) / "
                "NULLIF(sum(CASE WHEN lat IS NOT NULL THEN MUN_FUEL END), 0) AS lat, "
                "sum(CASE WHEN lon IS NOT NULL THEN lon * MUN_FUEL END) / "
                "NULLIF(sum(CASE WHEN lon IS NOT NULL THEN MUN_FUEL END), 0) AS lon, sum(MUN_FUEL) AS MUN_FUEL, "
                "CASE WHEN count(*) = 1 THEN first(mun) ELSE state || '_aggregate(' || CAST(count(*) AS VARCHAR) "
                "|| ')' END AS mun FROM ranked GROUP BY state, aggregate")
CHAIN["curve"] = ("SELECT date, state, price, coalesce(pred / NULLIF(avg(pred) OVER (PARTITION BY year(date), state),"
                  " 0), 1.0) AS curve FROM (SELECT pr.date, pr.state, pr.price, m.intercept + m.slope * pr.price "
                  "AS pred FROM prices pr LEFT JOIN model m USING (state)) p")
CHAIN["v04"] = ("SELECT l.state, l.mun, l.lat, l.lon, c.date, c.price, l.MUN_FUEL * c.curve * 158.9873027281 "
                "AS litres FROM (SELECT DISTINCT state, mun, lat, lon, MUN_FUEL FROM v03) l JOIN curve c USING (state)")

BASE = ("price_base", "population", "demand")


def chain_sql(select: str, upto: str) -> str:
    names = list(CHAIN)
    extra = {k: CHAIN[k] for k in names[: names.index(upto) + 1]}
    return with_views(select, *BASE, extra=extra)


# ------------------------------------------------------------------ V01 / V02 / A11
@case("v01_daily_state_prices", chain_sql("SELECT date, state, price FROM v01_A", "v01_A"), rounding=r(4, "price"))
def v01(fx):
    return PN.daily_state_prices(*fx.product_prices("A"))


@case("v02_mean_price", chain_sql("SELECT * FROM prices", "prices"), rounding=r(4, "price"))
def v02(fx):
    return prices(fx)


@case("a11_yearly_state_price", chain_sql("SELECT * FROM yearly_price", "yearly_price"), rounding=r(4, "price"))
def a11(fx):
    return prices(fx).groupBy(F.year("date").alias("year"), "state").agg(F.avg("price").alias("price"))


# ------------------------------------------------------------------ J01 / M01 / M03
@case("j01_state_rollup", chain_sql("SELECT * FROM sd", "sd"), rounding=r(2, "BBL", "cars"))
def j01(fx):
    return PN.state_rollup(fx.population, fx.demand, YEAR)


@case("m01_fill_regression", chain_sql("SELECT state, BBL, pop, r2 FROM filled1", "filled1"),
      rounding={"BBL": 0, "r2": 9})
def m01(fx):
    f, _ = PN.fill_by_regression(PN.state_rollup(fx.population, fx.demand, YEAR), ["pop"])
    return f.select("state", "BBL", "pop", "r2")


@case("m01_fill_regression_multi", chain_sql("SELECT state, BBL, pop, r2 FROM filled", "filled"), rounding={"BBL": 0, "r2": 9})
def m01m(fx):
    f, _ = PN.fill_by_regression(PN.state_rollup(fx.population, fx.demand, YEAR), PN.FUEL_INPUTS)
    return f.select("state", "BBL", "pop", "r2")


@case("m01_per_head_fuel", chain_sql("SELECT state, mun, pop, MUN_FUEL FROM loc", "loc"), rounding=r(0, "MUN_FUEL"))
def m01t(fx):
    f, _ = PN.fill_by_regression(PN.state_rollup(fx.population, fx.demand, YEAR), PN.FUEL_INPUTS)
    return PN.per_head_fuel(fx.population, f).select("state", "mun", "pop", "MUN_FUEL")


# ------------------------------------------------------------------ A05 / W11 / J06 / M02
@case("a05_state_share", chain_sql("SELECT * FROM shares", "shares"), rounding=r(10, "share"))
def a05(fx):
    return consumption(fx)[2]["shares"]


@case("w11_fill_demand", chain_sql("SELECT * FROM dem", "dem"), rounding=r(0, "volume"))
def w11(fx):
    return consumption(fx)[2]["demand_filled"]


@case("j06_elasticity_input", chain_sql("SELECT * FROM el", "el"), rounding={"BBL": 0, "price": 4})
def j06(fx):
    return consumption(fx)[2]["elasticity"]


@case("m02_price_response", chain_sql("SELECT * FROM model", "model"),
      rounding={"intercept": 0, "slope": 3, "r2": 9})
def m02(fx):
    return consumption(fx)[1]


# ------------------------------------------------------------------ A06 / A07 / P24 / W01 / A08
@case("a06_location_share",
      chain_sql("SELECT state, mun, MUN_FUEL, state_share FROM loc2", "loc2"), rounding={"MUN_FUEL": 0, "state_share": 10})
def a06(fx):
    loc = consumption(fx, aggregated=False)[0]
    return loc.select("state", "mun", "MUN_FUEL", "state_share")


@case("a07_quartile_cutoff", chain_sql("SELECT state, mun, state_share, cutoff FROM cut", "cut"),
      rounding=r(10, "state_share", "cutoff"))
def a07(fx):
    loc = consumption(fx, aggregated=False)[0]
    return loc.select("state", "mun", "state_share", "cutoff")


@case("a07_quartile_cutoff_sorted_runs", chain_sql("SELECT state, mun, state_share, cutoff FROM cut", "cut"),
      rounding=r(10, "state_share", "cutoff"))
def a07_runs(fx):
    """The way of tables above the one-pass size."""
    loc = consumption(fx, aggregated=False)[0].select("state", "mun", "state_share")
    return quartile_cutoff(loc, "state", one_pass_bytes=0)


@case("p24_flag_ge", chain_sql("SELECT state, mun, flag FROM flagged", "flagged"))
def p24(fx):
    return consumption(fx, aggregated=False)[0].select("state", "mun", "flag")


@case("w01_location_rank", chain_sql("SELECT state, mun, aggregate FROM ranked", "ranked"))
def w01(fx):
    return consumption(fx, aggregated=False)[0].select("state", "mun", "aggregate")


@case("a08_collapse_small", chain_sql("SELECT * FROM v03", "v03"), rounding={"lat": 6, "lon": 6, "MUN_FUEL": 0})
def a08(fx):
    loc = consumption(fx, aggregated=False)[0]
    return collapse_small(loc.select("state", "mun", "lat", "lon", "MUN_FUEL", "aggregate"), weight="MUN_FUEL")


@case("v03_consumption_table", chain_sql("SELECT * FROM v03", "v03"), rounding={"lat": 6, "lon": 6, "MUN_FUEL": 0})
def v03(fx):
    return consumption(fx)[0]


# ------------------------------------------------------------------ W07 / J08 / V04
@case("w07_seasonal_curve", chain_sql("SELECT * FROM curve", "curve"), rounding={"price": 4, "curve": 6})
def w07(fx):
    loc, model, _ = consumption(fx)
    p = prices(fx).join(model.select("state", "intercept", "slope"), "state", "left")
    pred = F.col("intercept") + F.col("slope") * F.col("price")
    wy = Window.partitionBy(F.year("date"), "state")
    curve = F.coalesce(F.try_divide(pred, F.avg(pred).over(wy)), F.lit(1.0))
    return p.select("date", "state", "price", curve.alias("curve"))


@case("v04_fuel_panel", chain_sql("SELECT * FROM v04", "v04"),
      rounding={"lat": 6, "lon": 6, "price": 4, "litres": -4})
def v04(fx):
    loc, model, _ = consumption(fx)
    return PN.fuel_panel(loc, model, prices(fx))


@case("j08_locations_by_day", chain_sql("SELECT count(*) AS n, count(DISTINCT state || mun) AS locations, "
                                        "count(DISTINCT date) AS dates FROM v04", "v04"))
def j08(fx):
    loc, model, _ = consumption(fx)
    p = PN.fuel_panel(loc, model, prices(fx))
    return p.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.concat("state", "mun")).alias("locations"),
                 F.countDistinct("date").alias("dates"))


@case("v01_daily_state_prices_proportional",
      chain_sql("SELECT nd.date, sm.state, sm.price * (nd.price / NULLIF(nm.price, 0)) AS price "
                "FROM nd_A nd JOIN nm_A nm ON year(nd.date) = nm.year AND month(nd.date) = nm.month "
                "JOIN sm_A sm ON sm.year = nm.year AND sm.month = nm.month", "v01_A"), rounding=r(4, "price"))
def v01p(fx):
    return PN.daily_state_prices(*fx.product_prices("A"), mode="proportional")
