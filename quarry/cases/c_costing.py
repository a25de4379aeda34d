"""Cases for freight lanes, site costs and market sourcing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.cases import case, r
from quarry.functions.exprs import haversine_sql
from quarry.plans import costing as CO
from quarry.sources.fixtures import with_views

RATE = CO.base_rate(0.2)
SITE_PARAMS = dict(fixed_base=1e6, fixed_ratio=2.0, variable_base=1.5, variable_ratio=0.5,
                   storage_base=1e5, storage_ratio=10.0, safety_base=1e4, safety_ratio=3.0)
IMPORTS = ("Imports", "Imports", 29.749907, -95.358421)  # fixed value: import terminal site


# ------------------------------------------------------------------ fixtures: sites, overrides
def sites(fx):
    return fx.memo("sites", lambda: _sites(fx))


def _sites(fx):
    """One plant per state: its lowest-keyed supplier; capacity from the supplier's balance."""
    dim = fx.supplier_dim
    first = dim.groupBy("n_name").agg(F.min("s_suppkey").alias("s_suppkey"))
    sup = fx.table("supplier").select("s_suppkey", "s_name", "s_acctbal")
    s = first.join(sup, "s_suppkey")
    return s.select(F.col("n_name").alias("state"), F.col("s_name").alias("name"),
                    ((F.col("s_suppkey") * 37) % 180 - 90).cast("double").alias("lat"),
                    ((F.col("s_suppkey") * 73) % 360 - 180).cast("double").alias("lon"),
                    ((F.col("s_acctbal") + 2000.0) * 40.0 / 365.0).alias("daily_capacity"),
                    (F.lit(1.0) + F.col("s_acctbal") / 10000.0).alias("profile"))


def state_rates(fx):
    n = fx.table("nation")
    return n.filter(F.col("n_regionkey").isin(2, 4)).select(
        F.col("n_name").alias("state"),
        F.when(F.col("n_regionkey") == 2, F.lit(RATE * 1.3)).otherwise(F.lit(RATE * 0.85)).alias("rate"))


def pair_rates(fx):
    n = fx.table("nation")
    a = n.filter(F.col("n_regionkey") == 1).select(F.col("n_name").alias("source_state"))
    b = n.filter(F.col("n_regionkey") == 3).select(F.col("n_name").alias("destination_state"))
    return CO.attach_bounded(a, b, "_d").withColumn("rate", F.lit(RATE / 20))


def lanes(fx):
    return fx.memo("lanes", lambda: _lanes(fx))


def _lanes(fx):
    return CO.lane_distances(sites(fx), fx.coords)


def freight(fx):
    return fx.memo("freight", lambda: _freight(fx))


def _freight(fx):
    return CO.freight_costs(lanes(fx), RATE, pair_rates(fx), state_rates(fx), fx.coords, sites(fx))


def site_table(fx):
    return fx.memo("site_table", lambda: _site_table(fx))


def _site_table(fx):
    s = sites(fx).select("state", F.col("name").alias("mun"), "lat", "lon", "daily_capacity", "profile")
    schema = T.StructType([T.StructField(c, t) for c, t in (
        ("state", T.StringType()), ("mun", T.StringType()), ("lat", T.DoubleType()), ("lon", T.DoubleType()),
        ("daily_capacity", T.DoubleType()), ("profile", T.DoubleType()))])
    imp = fx.spark.createDataFrame([(*IMPORTS, float("inf"), 0.0)], schema)  # S10
    return s.unionByName(imp)


def sourcing(fx):
    return fx.memo("sourcing", lambda: _sourcing(fx))


def _sourcing(fx):
    return CO.market_sourcing(markets(fx), freight(fx))


def markets(fx):
    return fx.memo("markets", lambda: CO.markets_by_period(fx.panel, fx.periods))


def sales(fx):
    return fx.memo("sales", lambda: _sales(fx))


def _sales(fx):
    """The cheapest source of each market sells 90 % of its demand; suppliers' numbers ending in 7 sell nothing."""
    best = CO.cheapest_source(sourcing(fx))
    return best.join(markets(fx), CO.MARKET).filter("market not like '%7'") \
        .select(*CO.MARKET, "source", (F.col("demand") * 0.9).alias("sales"))


# ------------------------------------------------------------------ SQL twins
SQL = {}
SQL["sites"] = """
SELECT n.n_name AS state, s.s_name AS name, CAST((s.s_suppkey * 37) % 180 - 90 AS DOUBLE) AS lat,
       CAST((s.s_suppkey * 73) % 360 - 180 AS DOUBLE) AS lon, (s.s_acctbal + 2000.0) * 40.0 / 365.0 AS daily_capacity,
       1.0 + s.s_acctbal / 10000.0 AS profile
FROM (SELECT n_name, min(s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name) f
JOIN supplier s ON s.s_suppkey = f.k JOIN nation n ON n.n_nationkey = s.s_nationkey"""
SQL["lanes"] = (f"SELECT s.state AS source_state, s.name AS source, m.state AS destination_state, "
                f"m.name AS destination, {haversine_sql('s.lon', 's.lat', 'm.lon', 'm.lat')} AS kms "
                "FROM coords m, sites s")
SQL["pr"] = (f"SELECT a.n_name AS source_state, b.n_name AS destination_state, {RATE / 20!r} AS rate "
             "FROM nation a, nation b WHERE a.n_regionkey = 1 AND b.n_regionkey = 3")
SQL["sr"] = (f"SELECT n_name AS state, CASE WHEN n_regionkey = 2 THEN {RATE * 1.3!r} ELSE {RATE * 0.85!r} END "
             "AS rate FROM nation WHERE n_regionkey IN (2, 4)")
SQL["ords"] = ("SELECT state, name, min(ord) AS ord FROM (SELECT state, name, row_number() OVER (ORDER BY g, name, "
               "state) AS ord FROM (SELECT state, name, 0 AS g FROM coords UNION ALL SELECT state, name, 1 FROM sites) u"
               ") x GROUP BY state, name")
SQL["freight"] = f"""
SELECT source_state, source, destination_state, destination, kms, rate1 AS freightxkms, kms * rate1 AS freight FROM (
  SELECT l.*, CASE WHEN coalesce(pr.rate, {RATE!r}) = {RATE!r} AND
                        (CASE WHEN so.ord IS NULL THEN dd.rate WHEN dd.ord IS NULL THEN so.rate
                              WHEN so.ord <= dd.ord THEN so.rate ELSE dd.rate END) IS NOT NULL
                   THEN (CASE WHEN so.ord IS NULL THEN dd.rate WHEN dd.ord IS NULL THEN so.rate
                              WHEN so.ord <= dd.ord THEN so.rate ELSE dd.rate END)
                   ELSE coalesce(pr.rate, {RATE!r}) END AS rate1
  FROM lanes l LEFT JOIN pr USING (source_state, destination_state)
  LEFT JOIN (SELECT o.state AS source_state, o.name AS source, o.ord, sr.rate FROM ords o JOIN sr USING (state)) so
    USING (source_state, source)
  LEFT JOIN (SELECT o.state AS destination_state, o.name AS destination, o.ord, sr.rate FROM ords o JOIN sr USING (state)) dd
    USING (destination_state, destination)) x"""
SQL["dem"] = ("SELECT p.T, m.state, m.market, m.demand, m.price FROM (SELECT CAST(year(date) AS INTEGER) AS date, state, mun AS market, "
              "sum(litres) AS demand, sum(price * litres) / NULLIF(sum(litres), 0) AS price FROM panel GROUP BY 1, 2, 3) m "
              "JOIN periods p USING (date)")
SQL["sourcing"] = """
SELECT d.T, d.state, d.market, l.source, d.demand, d.price,
       coalesce(l.freight, 30.0 + 10.0 * mx.m) * pow(1.06, d.T) AS cost
FROM dem d JOIN freight l ON l.destination = d.market AND l.destination_state = d.state, (SELECT max(freight) AS m FROM freight) mx
UNION ALL
SELECT T, state, market, 'Imports' AS source, demand, price, price * 0.9 AS cost FROM dem"""
SQL["best"] = ("SELECT T, state, market, arg_min(source, (cost, source)) AS source, min(cost) AS cost FROM sourcing "
               "GROUP BY T, state, market")
SQL["sales"] = ("SELECT b.T, b.state, b.market, b.source, d.demand * 0.9 AS sales FROM best b JOIN dem d "
                "USING (T, state, market) WHERE b.market NOT LIKE '%7'")
SQL["margin"] = ("SELECT s.T, s.state, s.market, s.source, s.sales, s.sales * c.cost AS freight, s.sales * d.price AS revenue, "
                 "s.sales * d.price - s.sales * c.cost AS margin FROM sales s LEFT JOIN dem d USING (T, state, market) "
                 "LEFT JOIN sourcing c USING (T, state, market, source)")
_site_rows = ("SELECT state, name AS mun, lat, lon, daily_capacity, profile FROM sites UNION ALL "
              f"SELECT '{IMPORTS[0]}', '{IMPORTS[1]}', {IMPORTS[2]!r}, {IMPORTS[3]!r}, 'inf'::DOUBLE, 0.0")
P = SITE_PARAMS


def _pol(x: str) -> str:
    return (f"(CASE WHEN isnan(coalesce({x}, 0.0)) THEN 0.0 WHEN coalesce({x}, 0.0) = 'inf'::DOUBLE THEN 1e25 "
            f"ELSE coalesce({x}, 0.0) END)")


SQL["site_cost"] = f"""
SELECT state, mun, {_pol('lat')} AS lat, {_pol('lon')} AS lon, {_pol('daily_capacity')} AS daily_capacity,
       {_pol('fixed * pow(1.05, T)')} AS fixed, {_pol('variable * pow(1.09, T)')} AS variable,
       {_pol('storage')} AS storage, {_pol('safety_inventory')} AS safety_inventory, T, days,
       {_pol('daily_capacity * days')} AS capacity
FROM (
  SELECT state, mun, lat, lon, daily_capacity,
         (CASE WHEN mun = 'Imports' AND profile = 0 THEN 'nan'::DOUBLE
               ELSE daily_capacity * {P['fixed_ratio']!r} * profile * 30 END) + {P['fixed_base']!r} AS fixed,
         CASE WHEN mun = 'Imports' THEN 0.0
              ELSE {P['variable_base']!r} + {P['variable_ratio']!r} * profile * exp(-daily_capacity / 1e7) END AS variable,
         daily_capacity * {P['storage_ratio']!r} + {P['storage_base']!r} AS storage,
         daily_capacity * {P['safety_ratio']!r} + {P['safety_base']!r} AS safety_inventory
  FROM ({_site_rows}) s) b, (SELECT T, days FROM periods) p"""
SQL["projects"] = ("SELECT name AS mun, 'INITIAL' AS type, (profile * 1e6) AS capex, 0.0 AS increment FROM sites "
                   "UNION ALL SELECT name, 'STRATEGIC', profile * 5e5, 1.0 + profile / 10.0 FROM sites")
SQL["waterfall"] = """
SELECT T, plant, capacity, production, revenues, freight, capex, costs, depreciation, expansion_capacity, ebitda,
       (ebitda - depreciation) * 0.65 AS nopat, (ebitda - depreciation) * 0.65 + depreciation - capex AS fcf_wo_nwc,
       production / NULLIF(capacity, 0) AS utilization
FROM (
  SELECT *, revenues - costs - freight AS ebitda FROM (
    SELECT sc.T, sc.mun AS plant, sc.capacity, coalesce(r.production, 0.0) AS production,
           coalesce(r.revenues, 0.0) AS revenues, coalesce(r.freight, 0.0) AS freight,
           coalesce(pc.ci, 0.0) * 0 + coalesce(pc.cs, 0.0) * 0 AS capex,
           sc.safety_inventory * 0 + sc.fixed * 0 * 0.25 + sc.fixed * 1 + sc.variable * coalesce(r.production, 0.0) AS costs,
           (1 * coalesce(pc.ci, 0.0) + 0 * coalesce(pc.cs, 0.0)) / 20.0 AS depreciation,
           sc.capacity * greatest(0.0, coalesce(pc.inc, 0.0) - 1) AS expansion_capacity
    FROM site_cost sc
    LEFT JOIN (SELECT T, source AS plant, sum(sales) AS production, sum(revenue) AS revenues,
                      sum(freight) AS freight FROM margin GROUP BY T, source) r ON r.T = sc.T AND r.plant = sc.mun
    LEFT JOIN (SELECT mun AS plant, coalesce(sum(CASE WHEN type = 'INITIAL' THEN capex END), 0.0) AS ci,
                      coalesce(sum(CASE WHEN type = 'STRATEGIC' THEN capex END), 0.0) AS cs,
                      coalesce(max(CASE WHEN type = 'STRATEGIC' THEN increment END), 0.0) AS inc
               FROM projects GROUP BY mun) pc ON pc.plant = sc.mun) a) b"""

ORDER = ["sites", "lanes", "pr", "sr", "ords", "freight", "dem", "sourcing", "best", "sales", "margin", "site_cost",
         "projects", "waterfall"]


def csql(select: str, upto: str) -> str:
    extra = {k: SQL[k] for k in ORDER[: ORDER.index(upto) + 1]}
    return with_views(select, "coords", "periods", "panel", extra=extra)


# ------------------------------------------------------------------ J09 / J14 / J15 / V06
@case("j09_lane_distances", csql("SELECT * FROM lanes", "lanes"), rounding=r(6, "kms"))
def j09(fx):
    return lanes(fx)


@case("j14_locations_in_override_states",
      csql("SELECT * FROM coords WHERE state IN (SELECT state FROM sr)", "sr"))
def j14(fx):
    return CO.in_states(fx.coords, state_rates(fx))


@case("j15_freight_overrides", csql("SELECT * FROM freight", "freight"),
      rounding={"kms": 6, "freightxkms": 12, "freight": 8})
def j15(fx):
    return freight(fx)


@case("v06_freight_costs",
      csql("SELECT source, destination, kms, freightxkms, freight FROM freight", "freight"),
      rounding={"kms": 6, "freightxkms": 12, "freight": 8})
def v06(fx):
    return freight(fx).select("source", "destination", "kms", "freightxkms", "freight")


# ------------------------------------------------------------------ V08 / J13 / U06 / S10
@case("v08_site_costs", csql("SELECT * FROM site_cost", "site_cost"),
      rounding={"lat": 6, "lon": 6, "daily_capacity": 6, "fixed": 4, "variable": 8, "storage": 4,
                "safety_inventory": 4, "capacity": 4})
def v08(fx):
    return CO.site_costs(site_table(fx), fx.periods, **SITE_PARAMS)


@case("u06_period_expansion",
      csql("SELECT mun, T, days FROM site_cost", "site_cost"))
def u06(fx):
    return CO.site_costs(site_table(fx), fx.periods, **SITE_PARAMS).select("mun", "T", "days")


@case("s10_literal_rows", csql("SELECT * FROM (" + _site_rows + ") s", "sites"),
      rounding={"daily_capacity": 6, "profile": 6})
def s10(fx):
    return site_table(fx)


# ------------------------------------------------------------------ V09 / O02 / A14
@case("v09_market_sourcing", csql("SELECT * FROM sourcing", "sourcing"),
      rounding={"demand": 4, "price": 4, "cost": 6})
def v09(fx):
    return sourcing(fx)


@case("o02_cheapest_source", csql("SELECT * FROM best", "best"), rounding={"cost": 6})
def o02(fx):
    return CO.cheapest_source(sourcing(fx))


@case("a14_lane_cost_summary",
      csql("SELECT T, state, market, min(cost) AS freight_min, avg(cost) AS freight_mean, median(cost) AS freight_median, "
           "max(cost) AS freight_max FROM sourcing GROUP BY T, state, market", "sourcing"),
      rounding=r(6, "freight_min", "freight_mean", "freight_median", "freight_max"))
def a14(fx):
    return CO.lane_summary(sourcing(fx))


# ------------------------------------------------------------------ V10 / V11
@case("v10_market_margin", csql("SELECT * FROM margin", "margin"),
      rounding=r(2, "sales", "freight", "revenue", "margin"))
def v10(fx):
    return CO.market_margin(sales(fx), sourcing(fx), markets(fx))[0]


@case("v10_unmet_demand",
      csql("SELECT d.T, d.state, d.market, d.demand - coalesce((SELECT sum(s.sales) FROM sales s WHERE s.T = d.T AND "
           "s.state = d.state AND s.market = d.market), 0) AS unmet FROM dem d", "margin"), rounding=r(3, "unmet"))
def v10u(fx):
    return CO.market_margin(sales(fx), sourcing(fx), markets(fx))[1]


def projects(fx):
    """INITIAL and STRATEGIC projects per site (capex from the site profile)."""
    s = sites(fx)
    ini = s.select(F.col("name").alias("mun"), F.lit("INITIAL").alias("type"), (F.col("profile") * 1e6).alias("capex"),
                   F.lit(0.0).alias("increment"))
    strat = s.select(F.col("name").alias("mun"), F.lit("STRATEGIC").alias("type"),
                     (F.col("profile") * 5e5).alias("capex"), (F.lit(1.0) + F.col("profile") / 10.0).alias("increment"))
    return ini.unionByName(strat)


@case("v11_plant_waterfall", csql("SELECT * FROM waterfall", "waterfall"),
      rounding={"capacity": 2, "production": 3, "revenues": 2, "freight": 2, "capex": 2, "costs": 2,
                "depreciation": 2, "expansion_capacity": 2, "ebitda": 2, "nopat": 2, "fcf_wo_nwc": 2,
                "utilization": 9})
def v11(fx):
    site = CO.site_costs(site_table(fx), fx.periods, **SITE_PARAMS)
    m, _ = CO.market_margin(sales(fx), sourcing(fx), markets(fx))
    return CO.plant_waterfall(site, m, projects=projects(fx))


SQL_SPARSE = """
SELECT d.T, d.state, d.market, s.name AS source, d.demand, d.price,
       CASE WHEN l.source IS NULL THEN 2.0 * mx.m ELSE coalesce(l.freight, 30.0 + 10.0 * mx.m) END
         * pow(1.06, d.T) AS cost
FROM dem d CROSS JOIN sites s
LEFT JOIN (SELECT * FROM freight WHERE kms <= 10000) l ON l.destination = d.market
  AND l.destination_state = d.state AND l.source = s.name,
     (SELECT max(freight) AS m FROM freight WHERE kms <= 10000) mx
UNION ALL
SELECT T, state, market, 'Imports' AS source, demand, price, price * 0.9 AS cost FROM dem"""


@case("v09_market_sourcing_sparse_lanes", csql(SQL_SPARSE, "dem"), rounding={"demand": 4, "price": 4, "cost": 6})
def v09s(fx):
    """Plants reach markets within 10,000 km only; markets without a lane price the plant at 2 x max."""
    ln = freight(fx).filter(F.col("kms") <= 10000)
    return CO.market_sourcing(markets(fx), ln, sources=sites(fx))


def decisions(fx):
    """Plant decisions per (T, plant), folded over all runs of the plan fixture."""
    from quarry.cases.c_plan import plan_state
    ps = plan_state(fx)
    return ps.groupBy("T", "plant").agg(
        F.min("s1").alias("STATE"), F.max("SWITCH").alias("SWITCH"), F.max("LAYOFF").alias("LAYOFF"),
        F.min("a0").alias("a0"), F.max("c0").alias("c0"), F.max("INITIAL_CAPEX").alias("INITIAL_CAPEX"),
        F.max("STRATEGIC_CAPEX").alias("STRATEGIC_CAPEX"))


def _waterfall_dec_sql():
    from quarry.cases.c_plan import PS_SQL
    dec = ("SELECT T, plant, min(s1) AS STATE, max(SWITCH) AS SWITCH, max(LAYOFF) AS LAYOFF, min(a0) AS a0, "
           "max(c0) AS c0, max(INITIAL_CAPEX) AS INITIAL_CAPEX, max(STRATEGIC_CAPEX) AS STRATEGIC_CAPEX FROM ps "
           "GROUP BY T, plant")
    body = """
SELECT T, plant, capacity, production, revenues, freight, capex, costs, depreciation, expansion_capacity, ebitda,
       (ebitda - depreciation) * 0.65 AS nopat, (ebitda - depreciation) * 0.65 + depreciation - capex AS fcf_wo_nwc,
       production / NULLIF(capacity, 0) AS utilization
FROM (
  SELECT *, revenues - costs - freight AS ebitda FROM (
    SELECT sc.T, sc.mun AS plant, sc.capacity, coalesce(r.production, 0.0) AS production,
           coalesce(r.revenues, 0.0) AS revenues, coalesce(r.freight, 0.0) AS freight,
           coalesce(pc.ci, 0.0) * coalesce(d.INITIAL_CAPEX, 0) + coalesce(pc.cs, 0.0) * coalesce(d.STRATEGIC_CAPEX, 0)
             AS capex,
           sc.safety_inventory * coalesce(d.SWITCH, 0) + sc.fixed * coalesce(d.LAYOFF, 0) * 0.25
             + sc.fixed * coalesce(d.STATE, 1) + sc.variable * coalesce(r.production, 0.0) AS costs,
           (coalesce(d.a0, 1) * coalesce(pc.ci, 0.0) + coalesce(d.c0, 0) * coalesce(pc.cs, 0.0)) / 20.0 AS depreciation,
           sc.capacity * greatest(0.0, coalesce(pc.inc, 0.0) - 1) AS expansion_capacity
    FROM site_cost sc
    LEFT JOIN (SELECT T, source AS plant, sum(sales) AS production, sum(revenue) AS revenues,
                      sum(freight) AS freight FROM margin GROUP BY T, source) r ON r.T = sc.T AND r.plant = sc.mun
    LEFT JOIN dec d ON d.T = sc.T AND d.plant = sc.mun
    LEFT JOIN (SELECT mun AS plant, coalesce(sum(CASE WHEN type = 'INITIAL' THEN capex END), 0.0) AS ci,
                      coalesce(sum(CASE WHEN type = 'STRATEGIC' THEN capex END), 0.0) AS cs,
                      coalesce(max(CASE WHEN type = 'STRATEGIC' THEN increment END), 0.0) AS inc
               FROM projects GROUP BY mun) pc ON pc.plant = sc.mun) a) b"""
    extra = {k: SQL[k] for k in ORDER[: ORDER.index("projects") + 1]}
    extra.update(ps=PS_SQL, dec=dec)
    return with_views(body, "coords", "periods", "panel", "plan", extra=extra)


@case("v11_plant_waterfall_decisions", _waterfall_dec_sql(),
      rounding={"capacity": 2, "production": 3, "revenues": 2, "freight": 2, "capex": 2, "costs": 2,
                "depreciation": 2, "expansion_capacity": 2, "ebitda": 2, "nopat": 2, "fcf_wo_nwc": 2,
                "utilization": 9})
def v11d(fx):
    site = CO.site_costs(site_table(fx), fx.periods, **SITE_PARAMS)
    m, _ = CO.market_margin(sales(fx), sourcing(fx), markets(fx))
    return CO.plant_waterfall(site, m, decisions=decisions(fx), projects=projects(fx))
