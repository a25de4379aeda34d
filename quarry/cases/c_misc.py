"""Cases for the remaining joins, aggregates, reshapes and slices (J02, J04, J07, J10, J13, J16, A15, A17, A18,
O01, O03, O04, U01, U02, U05, U07, M03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.cases import case, r
from quarry.cases.c_panel import chain_sql, consumption
from quarry.cases.c_valuation import SENS_SQL, SENS_VIEWS
from quarry.operators import aggs as AG
from quarry.operators import reshape as RS
from quarry.plans import census as CE
from quarry.plans import valuation as V
from quarry.plans import panel as PN
from quarry.session import broadcast_if_small
from quarry.sources.fixtures import with_views

PX = "sum(e) / NULLIF(sum(q), 0)"


# ------------------------------------------------------------------ J02
@case("j02_computed_key_join",
      with_views(f"SELECT nd.date, nd.daily, nm.monthly FROM (SELECT date, {PX} AS daily FROM price_base "
                 f"WHERE flag = 'A' GROUP BY date) nd JOIN (SELECT year(date) AS y, month(date) AS m, {PX} AS monthly "
                 "FROM price_base WHERE flag = 'A' GROUP BY 1, 2) nm ON year(nd.date) = nm.y AND month(nd.date) = nm.m",
                 "price_base"), rounding=r(4, "daily", "monthly"))
def j02(fx):
    _, nm, nd = fx.product_prices("A")
    return PN.daily_with_month(nd, nm).select("date", "daily", "monthly")


# ------------------------------------------------------------------ J04 / V22
def _loc_dims(fx):
    b = fx.census_blocks
    keys = b.select(F.col("ENTIDAD").cast("string").alias("state_key"), F.col("MUN").cast("string").alias("mun_key"),
                    F.col("LOC").cast("string").alias("loc_key"), "AGEB", "MZA", "NOM_MUN", "NOM_LOC")
    loc = keys.select("state_key", "mun_key", "loc_key", F.col("NOM_LOC").alias("name")).distinct()
    mun = keys.select("state_key", "mun_key", F.col("NOM_MUN").alias("name")).distinct()
    st = fx.table("nation").select((F.col("n_nationkey") + 1).cast("string").alias("state_key"),
                                   F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return keys.select("state_key", "mun_key", "loc_key", "AGEB", "MZA"), loc, mun, st


V22_SQL = """
SELECT k.state_key, k.mun_key, k.loc_key, k.AGEB, k.MZA, l.name AS loc_name, m.name AS mun_name, s.name AS state_name,
       s.region AS state_region
FROM keys k
LEFT JOIN (SELECT DISTINCT state_key, mun_key, loc_key, NOM_LOC AS name FROM keys0) l USING (state_key, mun_key, loc_key)
LEFT JOIN (SELECT DISTINCT state_key, mun_key, NOM_MUN AS name FROM keys0) m USING (state_key, mun_key)
LEFT JOIN (SELECT CAST(n_nationkey + 1 AS VARCHAR) AS state_key, n_name AS name, n_regionkey AS region FROM nation) s
  USING (state_key)"""
KEYS0 = ("SELECT CAST(ENTIDAD AS VARCHAR) AS state_key, CAST(MUN AS VARCHAR) AS mun_key, CAST(LOC AS VARCHAR) AS loc_key, "
         "AGEB, MZA, NOM_MUN, NOM_LOC FROM census_blocks")


@case("v22_location_hierarchy",
      with_views(V22_SQL, "census_blocks", extra=dict(keys0=KEYS0, keys="SELECT state_key, mun_key, loc_key, AGEB, MZA "
                                                                       "FROM keys0")))
def v22(fx):
    keys, loc, mun, st = _loc_dims(fx)
    return CE.location_hierarchy(keys, loc, mun, st)


@case("j04_hierarchy_enrichment",
      with_views("SELECT state_key, mun_key, loc_key, loc_name, mun_name, state_name FROM (" + V22_SQL + ") v",
                 "census_blocks", extra=dict(keys0=KEYS0, keys="SELECT state_key, mun_key, loc_key, AGEB, MZA "
                                                               "FROM keys0")))
def j04(fx):
    keys, loc, mun, st = _loc_dims(fx)
    return CE.location_hierarchy(keys, loc, mun, st).select("state_key", "mun_key", "loc_key", "loc_name",
                                                            "mun_name", "state_name")


# ------------------------------------------------------------------ J07
@case("j07_group_stat_back",
      with_views("SELECT p.state, p.mun, p.date, p.price, g.state_mean_price FROM panel p JOIN (SELECT state, "
                 "avg(price) AS state_mean_price FROM panel GROUP BY state) g USING (state)", "panel"),
      rounding=r(4, "price", "state_mean_price"))
def j07(fx):
    p = fx.panel.select("state", "mun", "date", "price")
    return AG.attach_group_stat(p, ["state"], [F.avg("price")], ["state_mean_price"])


# ------------------------------------------------------------------ J10
@case("j10_align_measures",
      with_views("""
SELECT state, max(CASE WHEN m = 'volume' THEN v END) AS volume, max(CASE WHEN m = 'pop' THEN v END) AS pop,
       max(CASE WHEN m = 'price' THEN v END) AS price FROM (
  SELECT state, 'volume' AS m, sum(volume) AS v FROM demand GROUP BY state
  UNION ALL SELECT state, 'pop', sum(pop) FROM population GROUP BY state
  UNION ALL SELECT state, 'price', avg(price) FROM panel GROUP BY state) u GROUP BY state""",
                 "demand", "population", "panel"), rounding=r(4, "volume", "pop", "price"))
def j10(fx):
    vol = fx.demand.groupBy("state").agg(F.sum("volume").alias("value"))
    pop = fx.population.groupBy("state").agg(F.sum("pop").alias("value"))
    px = fx.panel.groupBy("state").agg(F.avg("price").alias("value"))
    return AG.align_measures([("volume", vol), ("pop", pop), ("price", px)], ["state"])


# ------------------------------------------------------------------ J13
@case("j13_attach_parameters",
      with_views("SELECT p.file, p.plant, p.T, p.production, k.fixed_ratio, k.variable_ratio FROM plan p JOIN (SELECT "
                 "s_name AS plant, 1.0 + s_acctbal / 10000.0 AS fixed_ratio, 0.5 + s_nationkey / 50.0 AS variable_ratio "
                 "FROM supplier) k USING (plant)", "plan"), rounding=r(6, "fixed_ratio", "variable_ratio"))
def j13(fx):
    s = fx.table("supplier").select(F.col("s_name").alias("plant"),
                                    (F.lit(1.0) + F.col("s_acctbal") / 10000.0).alias("fixed_ratio"),
                                    (F.lit(0.5) + F.col("s_nationkey") / 50.0).alias("variable_ratio"))
    p = fx.plan.select("file", "plant", "T", "production")
    return p.join(broadcast_if_small(s), "plant")


# ------------------------------------------------------------------ J16
@case("j16_difference_from_base",
      with_views("SELECT plant, shock, mean - max(CASE WHEN shock = 'NPV_revenues_down_50pct' THEN mean END) "
                 "OVER (PARTITION BY plant) AS delta FROM sens QUALIFY shock <> 'NPV_revenues_down_50pct'",
                 "plan", "periods", extra=SENS_VIEWS | {"sens": SENS_SQL}),
      rounding=r(2, "delta"))
def j16(fx):
    s = V.npv_sensitivity(fx.plan, fx.periods, 0.10)
    return V.sensitivity_deltas(s, "NPV_revenues_down_50pct").withColumnRenamed("case", "shock")


# ------------------------------------------------------------------ A15 / A17 / A18 / O01
@case("a15_distinct_locations", with_views("SELECT DISTINCT state, mun FROM panel", "panel"))
def a15(fx):
    return fx.panel.select("state", "mun").distinct()


@case("a17_monthly_price_volume",
      with_views("SELECT CAST(date_trunc('month', date) AS DATE) AS month, avg(price) AS price, sum(litres) AS litres "
                 "FROM panel GROUP BY 1", "panel"), rounding=r(4, "price", "litres"))
def a17(fx):
    return fx.panel.groupBy(F.trunc("date", "MM").alias("month")).agg(F.avg("price").alias("price"),
                                                                      F.sum("litres").alias("litres"))


A18_VIEWS = dict(
    sales="SELECT file, T, plant AS mun, production AS sales FROM plan",
    dmd="SELECT file, T, plant AS mun, production * 1.1 AS demand, revenues / NULLIF(production, 0) AS price FROM plan")
A18_SQL = """
SELECT mun, sales, demand, price, CAST(row_number() OVER (ORDER BY sales DESC NULLS LAST, mun) AS INTEGER) AS rank FROM (
  SELECT * FROM (SELECT mun, avg(s) AS sales FROM (SELECT file, mun, sum(sales) AS s FROM sales GROUP BY 1, 2) a GROUP BY mun) s
  FULL OUTER JOIN (SELECT mun, avg(d) AS demand FROM (SELECT file, mun, sum(demand) AS d FROM dmd GROUP BY 1, 2) b
                   GROUP BY mun) d USING (mun)
  FULL OUTER JOIN (SELECT mun, avg(price) AS price FROM dmd GROUP BY mun) p USING (mun)) x"""


def _a18(fx):
    p = fx.plan
    sales = p.select("file", "T", F.col("plant").alias("mun"), F.col("production").alias("sales"))
    dem = p.select("file", "T", F.col("plant").alias("mun"), (F.col("production") * 1.1).alias("demand"),
                   F.try_divide(F.col("revenues"), F.col("production")).alias("price"))
    return AG.market_view(sales, dem)


@case("a18_market_view", with_views(A18_SQL, "plan", extra=A18_VIEWS), rounding=r(4, "sales", "demand", "price"))
def a18(fx):
    return _a18(fx)


@case("o01_market_order", with_views("SELECT mun, rank FROM (" + A18_SQL + ") x", "plan",
                                     extra=A18_VIEWS))
def o01(fx):
    return _a18(fx).select("mun", "rank")


# ------------------------------------------------------------------ O03 / O04
@case("o03_last_period", with_views("SELECT file, T, plant, fcf_wo_nwc FROM plan WHERE T = (SELECT max(T) FROM plan)",
                                    "plan"), rounding=r(2, "fcf_wo_nwc"))
def o03(fx):
    return RS.first_last(fx.plan.select("file", "T", "plant", "fcf_wo_nwc"), "T", "last")


@case("o03_first_period", with_views("SELECT file, T, plant, capex FROM plan WHERE T = (SELECT min(T) FROM plan)",
                                     "plan"), rounding=r(2, "capex"))
def o03f(fx):
    return RS.first_last(fx.plan.select("file", "T", "plant", "capex"), "T", "first")


@case("o04_date_slice",
      with_views("SELECT state, mun, date, litres FROM panel WHERE date BETWEEN DATE '1996-03-01' AND DATE '1996-06-30'",
                 "panel"), rounding=r(4, "litres"))
def o04(fx):
    return RS.date_slice(fx.panel.select("state", "mun", "date", "litres"), "date", "1996-03-01", "1996-06-30")


# ------------------------------------------------------------------ U01 / U02 / U05 / U07
@case("u01_union_tagged",
      "SELECT s_name AS name, s_nationkey AS nationkey, NULL::VARCHAR AS segment, 'supplier' AS source FROM supplier "
      "UNION ALL SELECT c_name, c_nationkey, c_mktsegment, 'customer' FROM customer")
def u01(fx):
    s = fx.table("supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"))
    c = fx.table("customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"),
                                    F.col("c_mktsegment").alias("segment"))
    return RS.union_tagged([("supplier", s), ("customer", c)])


@case("u02_wide_to_long",
      with_views("UNPIVOT (SELECT state, mun, pop, hab_houses, cars FROM population) ON pop, hab_houses, cars "
                 "INTO NAME measure VALUE value", "population"), rounding=r(2, "value"))
def u02(fx):
    return RS.wide_to_long(fx.population.select("state", "mun", "pop", "hab_houses", "cars"), ["state", "mun"],
                           ["pop", "hab_houses", "cars"], "measure", "value")


@case("u05_calendar_spine",
      with_views("SELECT state, mun, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM "
                 "(SELECT state, mun, min(date) AS lo, max(date) AS hi FROM panel GROUP BY 1, 2) x", "panel"))
def u05(fx):
    g = fx.panel.groupBy("state", "mun").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return g.select("state", "mun", RS.calendar_spine(F.col("lo"), F.col("hi")))


@case("u07_upsert",
      with_views("""
SELECT coalesce(n.state, b.state) AS state, coalesce(n.mun, b.mun) AS mun, coalesce(n.date, b.date) AS date,
       CASE WHEN n.litres IS NOT NULL OR b.litres IS NULL THEN n.litres ELSE b.litres END AS litres
FROM (SELECT state, mun, date, litres FROM panel) b
FULL OUTER JOIN (SELECT state, mun, CAST(date + INTERVAL 30 DAY AS DATE) AS date, litres * 2 AS litres FROM panel
                 WHERE year(date) = 2001) n
  ON b.state = n.state AND b.mun = n.mun AND b.date = n.date""", "panel"), rounding=r(4, "litres"))
def u07(fx):
    base = fx.panel.select("state", "mun", "date", "litres")
    new = base.filter(F.year("date") == 2001).select("state", "mun", F.date_add("date", 30).alias("date"),
                                                     (F.col("litres") * 2).alias("litres"))
    return RS.upsert(base, new, ["state", "mun", "date"], ["litres"])


# ------------------------------------------------------------------ M03
@case("m03_fit_quality",
      chain_sql("SELECT state, r2, n FROM model", "model"),
      rounding=r(9, "r2"))
def m03(fx):
    return consumption(fx)[1].select("state", "r2", "n")


# ------------------------------------------------------------------ U03 (pivot API with explicit values)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")  # the segment dimension


@case("u03_pivot_segments",
      with_views("SELECT state, " + ", ".join(f"coalesce(max(CASE WHEN mun = '{s}' THEN pop END), 0.0) AS {s}"
                                              for s in SEGMENTS) + " FROM population GROUP BY state", "population"))
def u03p(fx):
    # explicit values: the segment list comes from a small distinct query on the customer dimension
    segs = sorted(r[0] for r in fx.table("customer").select("c_mktsegment").distinct().collect())
    return RS.long_to_wide(fx.population, ["state"], "mun", "pop", segs, fill=0.0)


# ------------------------------------------------------------------ A16 (objective histogram)
@case("a16_objective_bins",
      with_views("""
SELECT bin, lo + (hi - lo) * bin / 4 AS bin_lo, count(*) AS n FROM (
  SELECT CAST(least(floor(coalesce((objective - lo) / NULLIF(hi - lo, 0), 0.0) * 4), 3) AS INTEGER) AS bin, lo, hi
  FROM (SELECT file, sum(fcf_wo_nwc / pow(1.1, T)) AS objective FROM plan GROUP BY file) o,
       (SELECT min(objective) AS lo, max(objective) AS hi FROM
          (SELECT file, sum(fcf_wo_nwc / pow(1.1, T)) AS objective FROM plan GROUP BY file) x) g) b
GROUP BY bin, lo, hi""", "plan"), rounding=r(0, "bin_lo"))
def a16o(fx):
    from quarry.operators.aggs import histogram
    return histogram(V.plan_objective(fx.plan, 0.10), "objective", 4)


# ------------------------------------------------------------------ M01 without regression
@case("m01_per_head_fuel_no_fill",
      with_views("SELECT p.state, p.mun, p.pop, s.BBL / NULLIF(s.pop, 0) * p.pop AS MUN_FUEL FROM population p "
                 "LEFT JOIN (SELECT d.state, d.volume * 1000.0 AS BBL, q.pop FROM demand d JOIN (SELECT state, "
                 "sum(pop) AS pop FROM population WHERE state IS NOT NULL GROUP BY state) q USING (state) "
                 "WHERE d.year = 1998) s USING (state)", "population", "demand"), rounding=r(0, "MUN_FUEL"))
def m01n(fx):
    from quarry.plans import panel as PN
    sd = PN.state_rollup(fx.population, fx.demand, 1998)
    return PN.per_head_fuel(fx.population, sd).select("state", "mun", "pop", "MUN_FUEL")
