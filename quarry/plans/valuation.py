"""Valuation of scenario plans: V12-V19, W03, W09, J11, J16.

Inputs are the long result tables of many runs (``file`` = run tag):
``production(file, T, plant, revenues, costs, depreciation, capex, ebitda, ...)``
and the period table ``periods(T, date, days)``.  The period table has one row
per period, so it is broadcast by design; everything else is grouped by
(run, plant) and then by plant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exprs import delta_flag, ln_pos, norm_cdf, safe_div, seeded_normal

TAX = 0.35            # fixed value: tax rate in NOPAT = 0.65 (EBITDA - dep)
DAYS_IN_YEAR = 365    # fixed value: discounting base


def fcf(rev: Column, costs: Column, dep: Column, capex: Column) -> Column:
    """Free cash flow without working capital: (rev - costs - dep) 0.65 + dep - capex."""
    return (rev - costs - dep) * (1 - TAX) + dep - capex


# --------------------------------------------------------------------- W03
def discount_table(periods: DataFrame, wacc: float, t: str = "T", days: str = "days") -> DataFrame:
    """Running days - 365 and discount factor (1+d)^-n, d = (1+w)^(1/365) - 1.

    Runs on the period table only (a handful of rows), never on fact rows.
    """
    d = (1.0 + wacc) ** (1.0 / DAYS_IN_YEAR) - 1.0
    w = Window.orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    acc = F.sum(days).over(w) - DAYS_IN_YEAR
    return periods.select(*periods.columns, acc.alias("accum_days"),
                          F.pow(F.lit(1.0 + d), -acc).alias("DF"))


def _attach_df(production: DataFrame, periods: DataFrame, wacc: float) -> DataFrame:
    """Period lookup by ``T`` (the period table is bounded: broadcast)."""
    dt = discount_table(periods, wacc).select("T", F.col("date").alias("period_date"), "DF")
    return production.join(F.broadcast(dt), "T")


def name_filter(df: DataFrame, col: str, pattern: str | None, regex: bool = False) -> DataFrame:
    """Keep rows whose ``col`` contains ``pattern`` (substring or regex)."""
    if not pattern:
        return df
    return df.filter(F.col(col).rlike(pattern) if regex else F.col(col).contains(pattern))


# --------------------------------------------------------------------- V12
def plan_objective(production: DataFrame, wacc: float = 0.10, monthly: bool = False,
                   run: str = "file") -> DataFrame:
    """Sum over periods of fcf / (1 + w)^T  (w / 12 for monthly plans)."""
    rate = wacc / 12.0 if monthly else wacc
    return production.groupBy(run).agg(
        F.sum(F.col("fcf_wo_nwc") / F.pow(F.lit(1.0 + rate), F.col("T"))).alias("objective"))


# --------------------------------------------------------------------- V13
NPV_MEASURES = ("NPV_revenues", "NPV_costs", "NPV_ebitda", "NPV_fcf", "capex", "depreciation")


def npv_per_run(production: DataFrame, periods: DataFrame, wacc: float = 0.10,
                plant_pattern: str | None = "Refinery") -> DataFrame:
    """V13 first stage: discounted sums per (run, plant)."""
    p = _attach_df(name_filter(production, "plant", plant_pattern), periods, wacc)
    DF = F.col("DF")
    rev, cost, dep, capex = (F.col(x) for x in ("revenues", "costs", "depreciation", "capex"))
    return p.groupBy("file", "plant").agg(
        F.sum(DF * rev).alias("NPV_revenues"),
        F.sum(DF * cost).alias("NPV_costs"),
        F.sum(DF * (rev - cost)).alias("NPV_ebitda"),
        F.sum(DF * fcf(rev, cost, dep, capex)).alias("NPV_fcf"),
        F.sum(capex).alias("capex"),
        F.sum(dep).alias("depreciation"))


def npv_stats(production: DataFrame, periods: DataFrame, wacc: float = 0.10,
              plant_pattern: str | None = "Refinery") -> DataFrame:
    """Mean and sample std over runs of the per-run NPV sums, per plant."""
    per_run = npv_per_run(production, periods, wacc, plant_pattern)
    return per_run.groupBy("plant").agg(
        *[f(m).alias(f"{m}_{s}") for m in NPV_MEASURES for s, f in (("mean", F.avg), ("std", F.stddev_samp))])


def plant_performance(production: DataFrame, periods: DataFrame, wacc: float = 0.10,
                      plant_pattern: str | None = "Refinery") -> DataFrame:
    """NPV EBITDA, NPV FCF and capex means per plant."""
    s = npv_stats(production, periods, wacc, plant_pattern)
    return s.select("plant", "NPV_ebitda_mean", "NPV_fcf_mean", "capex_mean")


# --------------------------------------------------------------------- V14 / V15
# The six sensitivity cases (revenue shock k |rev|, capex and rate multipliers).
SENSITIVITY_CASES = (
    ("NPV_fcf", 0.0, 1.0, 1.0),
    ("NPV_revenues_up_50pct", 0.5, 1.0, 1.0),
    ("NPV_revenues_down_50pct", -0.5, 1.0, 1.0),
    ("NPV_capex_up50pct", 0.0, 1.5, 1.0),
    ("NPV_capex_up20pct", 0.0, 1.2, 1.0),
    ("NPV_WACC_up20pct", 0.0, 1.0, 1.2),
)


def npv_sensitivity(production: DataFrame, periods: DataFrame, wacc: float = 0.10,
                    cases=SENSITIVITY_CASES) -> DataFrame:
    """V14 (long form): one row per (plant, case) with mean, std, count over runs.

    Every case is linear in a few discounted sums, so the fact rows are
    reduced once per (run, plant) to those sums, one set for each distinct rate
    multiplier, and the cases are expanded on that small table with ``explode``
    of a literal array: the fact rows are never multiplied by the case count.
    """
    rates = sorted({float(c[3]) for c in cases})
    disc = None
    for i, m in enumerate(rates):
        d = discount_table(periods, wacc * m).select("T", F.col("DF").alias(f"DF{i}"))
        disc = d if disc is None else disc.join(d, "T")
    p = production.join(F.broadcast(disc), "T")
    parts = {"rev": F.col("revenues"), "arev": F.abs(F.col("revenues")), "cost": F.col("costs"),
             "dep": F.col("depreciation"), "capex": F.col("capex")}
    sums = [F.sum(F.col(f"DF{i}") * e).alias(f"{k}_{i}") for i in range(len(rates)) for k, e in parts.items()]
    per_run = p.groupBy("file", "plant").agg(*sums)
    case_arr = F.array(*[F.struct(F.lit(n).alias("case"), F.lit(float(k)).alias("k"), F.lit(float(cm)).alias("cm"),
                                  F.lit(rates.index(float(wm))).alias("rate")) for n, k, cm, wm in cases])
    x = per_run.select("*", F.explode(case_arr).alias("cs"))

    def pick(k):
        return F.coalesce(*[F.when(F.col("cs.rate") == i, F.col(f"{k}_{i}")) for i in range(len(rates))])

    npv = ((pick("rev") + F.col("cs.k") * pick("arev") - pick("cost") - pick("dep")) * (1 - TAX)
           + pick("dep") - F.col("cs.cm") * pick("capex"))
    y = x.select("file", "plant", F.col("cs.case").alias("case"), npv.alias("npv"))
    return y.groupBy("plant", "case").agg(
        F.avg("npv").alias("mean"), F.stddev_samp("npv").alias("std"), F.count("npv").alias("count"))


def sensitivity_deltas(sens: DataFrame, base_case: str = "NPV_fcf") -> DataFrame:
    """V15 + J16: mean of each case minus the base case mean, per plant; base row dropped."""
    w = Window.partitionBy("plant")
    base = F.max(F.when(F.col("case") == base_case, F.col("mean"))).over(w)
    return (sens.select("plant", "case", (F.col("mean") - base).alias("delta"))
            .filter(F.col("case") != base_case))


# --------------------------------------------------------------------- V17
def mc_simulation(production: DataFrame, periods: DataFrame, wacc: float = 0.10, n_samples: int = 500,
                  seed: int = 0, plant_pattern: str | None = "Refinery") -> DataFrame:
    """Per plant and sample, draw each NPV component and combine.

    Draws are keyed by (seed, plant, metric, sample) through md5, so they do
    not depend on partitioning or retries.  Samples are generated with
    ``explode(sequence(...))`` from the per-plant statistics row (one row per
    plant), i.e. the output is plants x n_samples rows.
    """
    s = npv_stats(production, periods, wacc, plant_pattern)
    ratio = safe_div("depreciation_mean", "capex_mean")
    # f = mean over plants of mean(dep) / mean(capex), undefined skipped: one scalar aggregate
    factor = s.agg(F.avg(ratio)).scalar()
    base = s.select("plant", "NPV_revenues_mean", "NPV_revenues_std", "NPV_costs_mean", "NPV_costs_std",
                    "capex_mean", factor.alias("dep_factor"))
    x = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("sample"))

    def draw(metric: str, force_rel: bool = False) -> Column:
        mu = F.col(f"{metric}_mean")
        rel = F.abs(mu * 0.2)
        if force_rel:
            sd_used = rel
        else:
            sd = F.col(f"{metric}_std")
            sd_used = F.when(F.coalesce(sd, F.lit(0.0)) == 0, rel).otherwise(sd)
        return mu + sd_used * seeded_normal(F.lit(seed), F.col("plant"), F.lit(metric), F.col("sample"))

    rev = draw("NPV_revenues")
    cost = draw("NPV_costs")
    capex = draw("capex", force_rel=True)
    y = x.select("plant", "sample", rev.alias("rev"), cost.alias("cost"), capex.alias("capex"),
                 F.col("dep_factor"))
    y = y.withColumn("dep", F.col("capex") * F.col("dep_factor"))
    npv = (F.col("rev") - F.col("cost") - F.col("dep")) * (1 - TAX) + F.col("dep") - F.col("capex")
    return y.select("plant", "sample",
                    ((F.col("rev") - F.col("cost")) * (1 - TAX)).alias("benefits"),
                    (F.col("capex") - F.col("dep") * TAX).alias("costs"),
                    npv.alias("npv"))


# --------------------------------------------------------------------- W09 / V18
def ebitda_volatility(production: DataFrame, run: str = "file", value: str = "ebitda") -> DataFrame:
    """Log change of EBITDA between periods per (run, plant), population std, mean over runs.

    Period 0 is dropped first; non-positive ratios give NULL and are skipped;
    plants with no defined change get 0.
    """
    p = production.filter(F.col("T") != 0).select(run, "plant", "T", value)
    w = Window.partitionBy(run, "plant").orderBy("T")
    lc = ln_pos(safe_div(F.col(value), F.lag(value).over(w)))
    per_run = p.select(run, "plant", lc.alias("lc")).groupBy(run, "plant").agg(F.stddev_pop("lc").alias("vol"))
    return per_run.groupBy("plant").agg(F.coalesce(F.avg("vol"), F.lit(0.0)).alias("vol"))


def black_scholes(S: Column, K: Column, rf: float, var: Column, t: float) -> Column:
    """Call value with variance ``var`` (= vol^2); undefined inputs give NULL."""
    sq = F.sqrt(var * t)
    d1 = F.try_divide(F.when((S > 0) & (K > 0), F.ln(S / K)) + (F.lit(rf) + var / 2) * t,
                      F.when(sq > 0, sq))
    d2 = d1 - sq
    return S * norm_cdf(d1) - K * F.exp(F.lit(-rf * t)) * norm_cdf(d2)


def real_option_valuation(production: DataFrame, sims: DataFrame, capex: DataFrame, rf: float = 0.05,
                          t: float = 10.0) -> DataFrame:
    """DCF, Monte Carlo and Black-Scholes value per plant.

    ``sims``: V17 output; ``capex``: (plant, capex) investment per site.
    """
    vol = ebitda_volatility(production)
    sim = sims.groupBy("plant").agg(F.avg("benefits").alias("S"), F.avg("npv").alias("MC"))
    k = capex.groupBy("plant").agg(F.sum("capex").alias("K"))
    j = sim.join(k, "plant", "left").join(vol, "plant", "left")
    S, K = F.col("S"), F.coalesce(F.col("K"), F.lit(0.0))
    var = F.pow(F.coalesce(F.col("vol"), F.lit(0.0)), 2)
    bs = F.coalesce(F.nanvl(black_scholes(S, K, rf, var, t), F.lit(None).cast("double")), F.lit(0.0))
    return j.select("plant", (S - K * delta_flag(S)).alias("DCF"), F.col("MC"), bs.alias("BS"))


# --------------------------------------------------------------------- V19 / A17
def mean_plan(production: DataFrame, periods: DataFrame, value: str = "production",
              plant_pattern: str | None = "Refinery") -> DataFrame:
    """Mean of ``value`` per (plant, period date) over runs."""
    p = name_filter(production, "plant", plant_pattern)
    p = p.join(F.broadcast(periods.select("T", "date")), "T")
    return p.groupBy("plant", "date").agg(F.avg(value).alias(value))


def mean_capex_plan(production: DataFrame, plant_pattern: str | None = "Refinery") -> DataFrame:
    """Per plant, mean over runs of the summed capex."""
    p = name_filter(production, "plant", plant_pattern)
    return (p.groupBy("file", "plant").agg(F.sum("capex").alias("capex"))
            .groupBy("plant").agg(F.avg("capex").alias("capex")))


# --------------------------------------------------------------------- J11
def scenario_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], measures: Sequence[str],
                        keep: Sequence[str] = ()) -> DataFrame:
    """``a - b`` per measure on a full outer join of the keys; unmatched give NULL.

    ``keep`` columns (e.g. demand) are taken from ``a`` without differencing.
    """
    la = a.select(*keys, *[F.col(m).alias(f"a_{m}") for m in measures], *keep)
    lb = b.select(*keys, *[F.col(m).alias(f"b_{m}") for m in measures])
    j = la.join(lb, list(keys), "full_outer")
    return j.select(*keys, *[(F.col(f"a_{m}") - F.col(f"b_{m}")).alias(m) for m in measures], *keep)
