"""Cases for the valuation family."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.cases import case, r
from quarry.functions.exprs import norm_cdf_sql, seeded_normal_sql
from quarry.operators.aggs import histogram, two_stage_stats
from quarry.plans import valuation as V
from quarry.sources.fixtures import with_views

WACC = 0.10
PATTERN = "Supplier#"  # plant-name filter (matches every plant of the fixture)
D1 = (1.0 + WACC) ** (1.0 / 365) - 1.0
D2 = (1.0 + WACC * 1.2) ** (1.0 / 365) - 1.0


def dfs_sql(name: str, d: float) -> str:
    return (f"SELECT T, date, pow({1.0 + d!r}, -(sum(days) OVER (ORDER BY T ROWS BETWEEN UNBOUNDED PRECEDING "
            f"AND CURRENT ROW) - 365)) AS DF FROM periods")


NPV_RUN_SQL = f"""
SELECT file, plant,
       sum(DF * revenues) AS NPV_revenues, sum(DF * costs) AS NPV_costs,
       sum(DF * (revenues - costs)) AS NPV_ebitda,
       sum(DF * ((revenues - costs - depreciation) * 0.65 + depreciation - capex)) AS NPV_fcf,
       sum(capex) AS capex, sum(depreciation) AS depreciation
FROM plan JOIN dfs USING (T) WHERE contains(plant, '{PATTERN}') GROUP BY file, plant"""

STATS_SQL = "SELECT plant, " + ", ".join(
    f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in V.NPV_MEASURES) + " FROM npv_run GROUP BY plant"

NPV_VIEWS = dict(dfs=dfs_sql("dfs", D1), npv_run=NPV_RUN_SQL)


# ---------------------------------------------------------------- W03
@case("w03_discount_factors",
      with_views("SELECT T, date, days, accum_days, pow(" + repr(1.0 + D1) + ", -accum_days) AS DF FROM ("
                 "SELECT T, date, days, CAST(sum(days) OVER (ORDER BY T ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
                 " - 365 AS BIGINT) AS accum_days FROM periods) x", "periods"),
      rounding=r(12, "DF"))
def w03(fx):
    return V.discount_table(fx.periods, WACC).select(
        "T", "date", "days", F.col("accum_days").cast("bigint").alias("accum_days"), "DF")


# ---------------------------------------------------------------- V12
@case("v12_plan_objective",
      with_views("SELECT file, sum(fcf_wo_nwc / pow(1.1, T)) AS objective FROM plan GROUP BY file", "plan"),
      rounding=r(2, "objective"))
def v12(fx):
    return V.plan_objective(fx.plan, WACC)


# ---------------------------------------------------------------- V13 / J12 / A12
@case("v13_npv_stats", with_views(STATS_SQL, "plan", "periods", extra=NPV_VIEWS),
      rounding=r(2, *[f"{m}_{s}" for m in V.NPV_MEASURES for s in ("mean", "std")]))
def v13(fx):
    return V.npv_stats(fx.plan, fx.periods, WACC, PATTERN)


@case("j12_period_lookup",
      with_views("SELECT p.file, p.T, p.plant, d.date AS period_date, p.revenues * d.DF AS npv_revenues "
                 "FROM plan p JOIN dfs d USING (T)", "plan", "periods", extra=dict(dfs=dfs_sql("dfs", D1))),
      rounding=r(4, "npv_revenues"))
def j12(fx):
    j = V._attach_df(fx.plan, fx.periods, WACC)
    return j.select("file", "T", "plant", "period_date", (F.col("revenues") * F.col("DF")).alias("npv_revenues"))


@case("a12_two_stage_stats",
      with_views("SELECT plant, avg(revenues) AS revenues_mean, stddev_samp(revenues) AS revenues_std, "
                 "count(revenues) AS revenues_count, avg(capex) AS capex_mean, stddev_samp(capex) AS capex_std, "
                 "count(capex) AS capex_count FROM (SELECT file, plant, sum(revenues) AS revenues, "
                 "sum(capex) AS capex FROM plan GROUP BY file, plant) g GROUP BY plant", "plan"),
      rounding=r(3, "revenues_mean", "revenues_std", "capex_mean", "capex_std"))
def a12(fx):
    return two_stage_stats(fx.plan, ["file"], ["plant"], ["revenues", "capex"], ("mean", "std", "count"))


# ---------------------------------------------------------------- V16
@case("v16_plant_performance",
      with_views("SELECT plant, NPV_ebitda_mean, NPV_fcf_mean, capex_mean FROM (" + STATS_SQL + ") s",
                 "plan", "periods", extra=NPV_VIEWS),
      rounding=r(2, "NPV_ebitda_mean", "NPV_fcf_mean", "capex_mean"))
def v16(fx):
    return V.plant_performance(fx.plan, fx.periods, WACC, PATTERN)


# ---------------------------------------------------------------- V14 / V15 / J16
CASES_SQL = "VALUES " + ", ".join(
    f"('{n}', {k}, {cm}, {'true' if wm != 1.0 else 'false'})" for n, k, cm, wm in V.SENSITIVITY_CASES)
SENS_SQL = f"""
SELECT plant, shock, avg(npv) AS mean, stddev_samp(npv) AS std, count(npv) AS count FROM (
  SELECT p.file, p.plant, c.shock,
         sum(CASE WHEN c.alt THEN d2.DF ELSE d1.DF END
             * (((p.revenues + c.k * abs(p.revenues)) - p.costs - p.depreciation) * 0.65
                + p.depreciation - p.capex * c.cm)) AS npv
  FROM plan p JOIN d1 USING (T) JOIN d2 USING (T)
  CROSS JOIN ({CASES_SQL}) AS c(shock, k, cm, alt)
  GROUP BY p.file, p.plant, c.shock) x
GROUP BY plant, shock"""
SENS_VIEWS = dict(d1=dfs_sql("d1", D1), d2=dfs_sql("d2", D2))


@case("v14_npv_sensitivity", with_views(SENS_SQL, "plan", "periods", extra=SENS_VIEWS),
      rounding=r(2, "mean", "std"))
def v14(fx):
    return V.npv_sensitivity(fx.plan, fx.periods, WACC).withColumnRenamed("case", "shock")


@case("v15_sensitivity_deltas",
      with_views("SELECT plant, shock, mean - max(CASE WHEN shock = 'NPV_fcf' THEN mean END) "
                 "OVER (PARTITION BY plant) AS delta FROM sens QUALIFY shock <> 'NPV_fcf'",
                 "plan", "periods", extra=dict(**SENS_VIEWS, sens=SENS_SQL)),
      rounding=r(2, "delta"))
def v15(fx):
    return V.sensitivity_deltas(V.npv_sensitivity(fx.plan, fx.periods, WACC)).withColumnRenamed("case", "shock")


# ---------------------------------------------------------------- V17 / M09
N_SAMPLES = 500


def _draw_sql(metric: str, rel_only: bool) -> str:
    z = seeded_normal_sql("0", "plant", f"'{metric}'", "sample")
    mu = f"{metric}_mean"
    sd = f"abs({mu} * 0.2)" if rel_only else \
        f"(CASE WHEN coalesce({metric}_std, 0) = 0 THEN abs({mu} * 0.2) ELSE {metric}_std END)"
    return f"({mu} + {sd} * {z})"


MC_SQL = f"""
SELECT plant, sample, (rev - cost) * 0.65 AS benefits, capex - dep * 0.35 AS costs,
       (rev - cost - dep) * 0.65 + dep - capex AS npv
FROM (
  SELECT plant, sample, rev, cost, capex, capex * dep_factor AS dep FROM (
    SELECT plant, sample, {_draw_sql('NPV_revenues', False)} AS rev, {_draw_sql('NPV_costs', False)} AS cost,
           {_draw_sql('capex', True)} AS capex, dep_factor
    FROM (SELECT *, avg(depreciation_mean / NULLIF(capex_mean, 0)) OVER () AS dep_factor FROM stats) s,
         range(0, {N_SAMPLES}) AS g(sample)) a) b"""
MC_VIEWS = dict(**NPV_VIEWS, stats=STATS_SQL)


@case("v17_monte_carlo", with_views(MC_SQL, "plan", "periods", extra=MC_VIEWS),
      rounding=r(1, "benefits", "costs", "npv"))
def v17(fx):
    return V.mc_simulation(fx.plan, fx.periods, WACC, N_SAMPLES, 0, PATTERN).select(
        "plant", F.col("sample").cast("bigint").alias("sample"), "benefits", "costs", "npv")


@case("m09_seeded_normal",
      with_views("SELECT plant, sample, " + seeded_normal_sql("7", "plant", "sample") + " AS z FROM "
                 "(SELECT DISTINCT plant FROM plan) p, range(0, 50) AS g(sample)", "plan"),
      rounding=r(9, "z"))
def m09(fx):
    from quarry.functions.exprs import seeded_normal
    p = fx.plan.select("plant").distinct()
    x = p.select("plant", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("s"))
    return x.select("plant", F.col("s").cast("bigint").alias("sample"), seeded_normal(F.lit(7), F.col("plant"), F.col("s")).alias("z"))


# ---------------------------------------------------------------- A16
@case("a16_objective_histogram",
      with_views("""
SELECT plant, bin, lo + (hi - lo) * bin / 20 AS bin_lo, count(*) AS n FROM (
  SELECT m.plant, CAST(least(floor(coalesce((npv - lo) / NULLIF(hi - lo, 0), 0.0) * 20), 19) AS INTEGER) AS bin,
         lo, hi
  FROM mc m JOIN (SELECT plant, min(npv) AS lo, max(npv) AS hi FROM mc GROUP BY plant) g USING (plant)) x
GROUP BY plant, bin, lo, hi""", "plan", "periods", extra=dict(**MC_VIEWS, mc=MC_SQL)),
      rounding=r(1, "bin_lo"))
def a16(fx):
    sims = V.mc_simulation(fx.plan, fx.periods, WACC, N_SAMPLES, 0, PATTERN)
    return histogram(sims, "npv", 20, ["plant"])


# ---------------------------------------------------------------- W09
VOL_SQL = """
SELECT plant, coalesce(avg(vol), 0) AS vol FROM (
  SELECT file, plant, stddev_pop(CASE WHEN r > 0 THEN ln(r) END) AS vol FROM (
    SELECT file, plant, ebitda / NULLIF(lag(ebitda) OVER (PARTITION BY file, plant ORDER BY T), 0) AS r
    FROM plan WHERE T <> 0) a GROUP BY file, plant) b
GROUP BY plant"""


@case("w09_ebitda_volatility", with_views(VOL_SQL, "plan"), rounding=r(9, "vol"))
def w09(fx):
    return V.ebitda_volatility(fx.plan)


# ---------------------------------------------------------------- V18 / M10
def _bs_sql() -> str:
    var = "pow(coalesce(vol, 0), 2)"
    sq = f"sqrt({var} * 10.0)"
    d1 = (f"((CASE WHEN S > 0 AND K > 0 THEN ln(S / K) END) + (0.05 + {var} / 2) * 10.0) / "
          f"NULLIF({sq}, 0)")
    d2 = f"({d1} - {sq})"
    return f"coalesce(S * {norm_cdf_sql(d1)} - K * exp(-0.5) * {norm_cdf_sql(d2)}, 0)"


V18_SQL = f"""
SELECT plant, S - K * (CASE WHEN abs(S) > 1e-5 THEN 1 ELSE 0 END) AS DCF, MC, {_bs_sql()} AS BS FROM (
  SELECT m.plant, m.S, m.MC, coalesce(k.K, 0) AS K, v.vol FROM
    (SELECT plant, avg(benefits) AS S, avg(npv) AS MC FROM mc GROUP BY plant) m
    LEFT JOIN (SELECT plant, sum(capex) AS K FROM capex_t GROUP BY plant) k USING (plant)
    LEFT JOIN vol v USING (plant)) x"""


@case("v18_real_option",
      with_views(V18_SQL, "plan", "periods",
                 extra=dict(**MC_VIEWS, mc=MC_SQL, vol=VOL_SQL,
                            capex_t="SELECT plant, capex FROM plan WHERE T = 0")),
      rounding=r(1, "DCF", "MC", "BS"))
def v18(fx):
    sims = V.mc_simulation(fx.plan, fx.periods, WACC, N_SAMPLES, 0, PATTERN)
    capex = fx.plan.filter(F.col("T") == 0).select("plant", "capex")
    return V.real_option_valuation(fx.plan, sims, capex, rf=0.05, t=10.0)


@case("m10_normal_cdf",
      with_views("SELECT plant, T, " + norm_cdf_sql("(ebitda - 500000.0) / 250000.0") + " AS p FROM plan", "plan"),
      rounding=r(9, "p"))
def m10(fx):
    from quarry.functions.exprs import norm_cdf
    return fx.plan.select("plant", "T", norm_cdf((F.col("ebitda") - 500000.0) / 250000.0).alias("p"))


# ---------------------------------------------------------------- V19 / A17
@case("v19_mean_production_plan",
      with_views("SELECT plant, date, avg(production) AS production FROM plan JOIN periods USING (T) "
                 f"WHERE contains(plant, '{PATTERN}') GROUP BY plant, date", "plan", "periods"),
      rounding=r(6, "production"))
def v19(fx):
    return V.mean_plan(fx.plan, fx.periods, "production", PATTERN)


@case("v19_mean_capex_plan",
      with_views("SELECT plant, avg(capex) AS capex FROM (SELECT file, plant, sum(capex) AS capex FROM plan "
                 f"WHERE contains(plant, '{PATTERN}') GROUP BY file, plant) g GROUP BY plant", "plan"),
      rounding=r(4, "capex"))
def v19c(fx):
    return V.mean_capex_plan(fx.plan, PATTERN)


# ---------------------------------------------------------------- J11
J11_MEASURES = ("revenues", "costs", "ebitda", "capex", "fcf_wo_nwc")
J11_SQL = "SELECT coalesce(a.T, b.T) AS T, coalesce(a.plant, b.plant) AS plant, " + ", ".join(
    f"a.{m} - b.{m} AS {m}" for m in J11_MEASURES) + ", a.production AS production " + \
    "FROM (SELECT * FROM plan WHERE file = '1-URGENT') a FULL OUTER JOIN " \
    "(SELECT * FROM plan WHERE file = '2-HIGH') b ON a.T = b.T AND a.plant = b.plant"


@case("j11_scenario_difference", with_views(J11_SQL, "plan"), rounding=r(3, *J11_MEASURES, "production"))
def j11(fx):
    a = fx.plan.filter(F.col("file") == "1-URGENT")
    b = fx.plan.filter(F.col("file") == "2-HIGH")
    return V.scenario_difference(a, b, ["T", "plant"], J11_MEASURES, keep=["production"])


# the other two key sets: markets by run, period, market and plant; objectives by run and step
J11_MARKET = ("SELECT file, T, state AS mun, plant, production AS sales, revenues AS revenue, ebitda FROM plan")
J11_STEPS = "SELECT file, CAST(T AS INTEGER) AS step, sum(fcf_wo_nwc) AS objective FROM plan GROUP BY 1, 2"


@case("j11_market_difference", with_views(
    f"SELECT file, T, mun, plant, a.sales - b.sales AS sales, a.revenue - b.revenue AS revenue, a.ebitda - b.ebitda AS ebitda FROM (SELECT * FROM ({J11_MARKET}) m WHERE T > 0) a "
    f"FULL JOIN (SELECT * REPLACE (sales * 0.9 AS sales, revenue * 0.8 AS revenue) FROM ({J11_MARKET}) m WHERE T < 5) b USING (file, T, mun, plant)", "plan"),
    rounding=r(3, "sales", "revenue", "ebitda"))
def j11_market(fx):
    m = fx.plan.select("file", "T", F.col("state").alias("mun"), "plant", F.col("production").alias("sales"), F.col("revenues").alias("revenue"), "ebitda")
    other = m.filter("T < 5").withColumns({"sales": F.col("sales") * 0.9, "revenue": F.col("revenue") * 0.8})
    return V.scenario_difference(m.filter("T > 0"), other, ["file", "T", "mun", "plant"], ["sales", "revenue", "ebitda"])


@case("j11_objective_difference", with_views(
    f"SELECT file, step, a.objective - b.objective AS objective FROM ({J11_STEPS}) a FULL JOIN (SELECT file, step, objective / 2 AS objective FROM ({J11_STEPS}) s WHERE step <> 2) b "
    "USING (file, step)", "plan"), rounding=r(2, "objective"))
def j11_objective(fx):
    o = fx.plan.groupBy("file", F.col("T").cast("int").alias("step")).agg(F.sum("fcf_wo_nwc").alias("objective"))
    return V.scenario_difference(o, o.filter("step <> 2").withColumn("objective", F.col("objective") / 2), ["file", "step"], ["objective"])
