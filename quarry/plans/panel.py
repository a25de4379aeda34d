"""Price and volume panel by location: V01-V04 with M01, M02, M03, W11, J01, J06, J08.

Shapes (long form throughout):
    population(state, mun, pop, hab_houses, cars, lat, lon)
    demand(state, year, volume)                      volume in thousand barrels, gaps = NULL
    prices(date, state, price)                       daily state price (V01 / V02)
The plan stays lazy end to end: regressions with one input are the
``regr_*`` aggregates (JVM, partial/final), the multi-input fill uses Spark
ML's normal-equation solver on the state table (one row per state).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exprs import safe_div
from quarry.operators.aggs import collapse_small, quartile_cutoff, share_of_total
from quarry.operators.clean import flag_ge
from quarry.operators.clean import BARRELS_PER_THOUSAND, LITRES_PER_BARREL
from quarry.session import broadcast_if_small


# ------------------------------------------------------------------ V01 / V02
def daily_with_month(national_daily: DataFrame, national_month: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every day's price beside its month's, joined on the computed (year, month)."""
    keys = list(keys)
    nd = national_daily.select(*keys, "date", F.col("price").alias("daily"),
                               F.year("date").alias("year"), F.month("date").alias("month"))
    nm = national_month.select(*keys, "year", "month", F.col("price").alias("monthly"))
    return nd.join(nm, [*keys, "year", "month"])


def daily_state_prices(state_month: DataFrame, national_month: DataFrame, national_daily: DataFrame,
                       mode: str = "reference", out: str = "price", keys: Sequence[str] = ()) -> DataFrame:
    """V01 (J02): state daily price = state monthly price x curve(date).

    ``state_month(state, year, month, price)``, ``national_month(year, month, price)``,
    ``national_daily(date, price)``.  Reference curve = national monthly /
    national daily; ``mode='proportional'`` uses daily / monthly.  ``keys``
    (e.g. a product column) lets one call price every product at once.
    """
    keys = list(keys)
    cur = daily_with_month(national_daily, national_month, keys)
    curve = safe_div("monthly", "daily") if mode == "reference" else safe_div("daily", "monthly")
    cur = cur.select(*keys, "date", "year", "month", curve.alias("curve"))
    sm = state_month.select(*keys, "state", "year", "month", F.col("price").alias("sp"))
    # the curve table has one row per (product, day): broadcast when its estimate is small
    j = sm.join(broadcast_if_small(cur), [*keys, "year", "month"])
    return j.select(*keys, "date", "state", (F.col("sp") * F.col("curve")).alias(out))


def mean_price(frames: Sequence[DataFrame] | DataFrame, out: str = "price") -> DataFrame:
    """Mean of several product prices per (date, state), missing skipped.

    Accepts a list of per-product frames or one frame holding all products.
    """
    if isinstance(frames, DataFrame):
        u = frames.select("date", "state", F.col(out).alias("p"))
    else:
        u = None
        for f in frames:
            x = f.select("date", "state", F.col(f.columns[-1]).alias("p"))
            u = x if u is None else u.unionByName(x)
    return u.groupBy("date", "state").agg(F.avg("p").alias(out))


# ------------------------------------------------------------------ J01 / M01 / M03
def state_rollup(pop: DataFrame, demand: DataFrame, year: int) -> DataFrame:
    """One year of demand joined to the state sums of the population table."""
    p = pop.filter(F.col("state").isNotNull()).groupBy("state").agg(
        F.sum("pop").alias("pop"), F.sum("hab_houses").alias("hab_houses"), F.sum("cars").alias("cars"))
    d = demand.filter(F.col("year") == year).select(
        "state", (F.col("volume") * BARRELS_PER_THOUSAND).alias("BBL"))
    return d.join(p, "state", "inner")


FUEL_INPUTS = ("pop", "cars", "hab_houses")


def normal_equations(complete: DataFrame, inputs: Sequence[str], response: str) -> DataFrame:
    """One row: intercept ``b``, slopes ``b0..``, and ``r2`` of ``response ~ inputs``.

    Centred sums come from one aggregate; the k x k system is eliminated in
    column expressions, one select per pivot, so nothing leaves the plan.  An
    input without variance of its own leaves the coefficients NULL.
    """
    k = range(len(inputs))
    x = list(inputs)
    m = complete.agg(
        F.avg(response).alias("ym"), F.var_pop(response).alias("yv"), *[F.avg(x[i]).alias(f"m{i}") for i in k],
        *[F.covar_pop(x[i], x[j]).alias(f"a{i}_{j}") for i in k for j in k],
        *[F.covar_pop(x[i], response).alias(f"c{i}") for i in k])
    m = m.select("*", *[F.col(f"c{i}").alias(f"y{i}") for i in k])
    for p in k:
        for i in range(p + 1, len(x)):
            f = F.try_divide(F.col(f"a{i}_{p}"), F.col(f"a{p}_{p}"))
            m = m.withColumn("_f", f)
            m = m.withColumns({f"y{i}": F.col(f"y{i}") - F.col("_f") * F.col(f"y{p}")}
                              | {f"a{i}_{j}": F.col(f"a{i}_{j}") - F.col("_f") * F.col(f"a{p}_{j}") for j in range(p, len(x))})
    for i in reversed(k):
        rest = F.col(f"y{i}")
        for j in range(i + 1, len(x)):
            rest = rest - F.col(f"a{i}_{j}") * F.col(f"b{j}")
        m = m.withColumn(f"b{i}", F.try_divide(rest, F.col(f"a{i}_{i}")))
    b = F.col("ym")
    explained = F.lit(0.0)
    for i in k:
        b = b - F.col(f"b{i}") * F.col(f"m{i}")
        explained = explained + F.col(f"b{i}") * F.col(f"c{i}")
    return m.select(b.alias("b"), *[f"b{i}" for i in k], F.try_divide(explained, F.col("yv")).alias("r2"))


def fill_by_regression(state_data: DataFrame, inputs: Sequence[str], response: str = "BBL") -> tuple[DataFrame, dict]:
    """M01 (fill part) + M03: fit ``response ~ inputs`` on complete rows, predict the others.

    A row to predict that lacks an input stays NULL.  The fit is one row, read
    as a scalar.
    """
    fit = normal_equations(state_data.na.drop(subset=[response, *inputs]), inputs, response)
    j = state_data.withColumn("_fit", fit.select(F.struct(*fit.columns)).scalar())
    pred = F.col("_fit.b")
    for i, x in enumerate(inputs):
        pred = pred + F.col(f"_fit.b{i}") * F.col(x)
    cols = [F.coalesce(F.col(c), pred).alias(c) if c == response else F.col(c) for c in state_data.columns]
    return j.select(*cols, F.col("_fit.r2").alias("r2")), {"model": fit}


def per_head_fuel(pop: DataFrame, state_filled: DataFrame, response: str = "BBL") -> DataFrame:
    """M01 (tail): consumption = BBL / pop per state; location volume = consumption x pop."""
    cons = state_filled.select("state", safe_div(F.col(response), F.col("pop")).alias("consumption"))
    j = pop.join(broadcast_if_small(cons), "state", "left")
    return j.select(*pop.columns, (F.col("consumption") * F.col("pop")).alias("MUN_FUEL"))


# ------------------------------------------------------------------ W11
def fill_demand(demand: DataFrame, shares: DataFrame, order_col: str = "state") -> DataFrame:
    """Fill missing (year, state) volumes with national sum x state share.

    The reference fills states one after another, each fill enlarging the
    sum used by the next; closed form per year, states in ``order_col`` order:
    ``K * s_i * prod_{j<i, missing}(1 + s_j)``, K = sum of the known states.
    The window is partitioned by year (one row per state inside).
    """
    d = demand.join(broadcast_if_small(shares.select("state", "share")), "state", "left")
    w = Window.partitionBy("year").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    missing = F.col("volume").isNull()
    cum = F.coalesce(F.sum(F.when(missing, F.ln(F.lit(1.0) + F.col("share")))).over(w), F.lit(0.0))
    known = F.sum("volume").over(Window.partitionBy("year"))
    fill = known * F.col("share") * F.exp(cum)
    return d.select("state", "year", F.coalesce(F.col("volume"), fill).alias("volume"),
                    missing.alias("synthetic"))


# ------------------------------------------------------------------ M02
def price_response(elasticity: DataFrame, y: str = "BBL", x: str = "price") -> DataFrame:
    """M02 + M03: per-state simple regression (same fit as the fully interacted OLS)."""
    return elasticity.groupBy("state").agg(
        F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"),
        F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ V03
def consumption_table(pop: DataFrame, demand: DataFrame, prices: DataFrame, year: int,
                      inputs: Sequence[str] = FUEL_INPUTS, min_share: float = 0.1, keep_above: float = 0.9,
                      aggregated: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """V03 (J01, M01, A05, W11, A11, J06, M02, A06, A07, P24, W01, A08): local consumption + price response.

    Returns (locations, model coefficients per state, intermediate frames).
    """
    sd = state_rollup(pop, demand, year)
    filled, _ = fill_by_regression(sd, list(inputs))
    loc = per_head_fuel(pop, filled)
    # State share of the national total (one row per state)
    shares = share_of_total(loc, "state", "MUN_FUEL").select("state", "share")
    dem = fill_demand(demand, shares)
    yearly_price = prices.groupBy(F.year("date").alias("year"), "state").agg(F.avg("price").alias("price"))  # A11
    el = (dem.select("state", "year", (F.col("volume") * BARRELS_PER_THOUSAND).alias("BBL"))
          .join(yearly_price, ["year", "state"]).na.drop())  # J06
    model = price_response(el)
    # A06 + A07 + P24 + W01 + A08
    total = loc.groupBy(F.col("state").alias("_s")).agg(F.sum("MUN_FUEL").alias("_state_fuel"))
    loc = loc.join(broadcast_if_small(total), F.col("state").eqNullSafe(F.col("_s")), "left") \
        .withColumn("state_share", safe_div(F.col("MUN_FUEL"), F.col("_state_fuel"))).drop("_s", "_state_fuel")
    loc = quartile_cutoff(loc, "state", "state_share", min_share, keep_above)
    loc = loc.withColumn("flag", flag_ge("state_share", "cutoff"))  # P24
    # flagged rows are few in a state (each holds at least ``min_share`` of it); the others, which
    # need no rank, are spread by their name instead of meeting in their state's window
    spread = F.when(F.col("flag") == 1, F.lit(None).cast("string")).otherwise(F.col("mun").cast("string"))
    rank = F.row_number().over(Window.partitionBy("state", "flag", spread).orderBy("mun"))
    loc = loc.withColumn("aggregate", F.when(F.col("flag") == 1, rank).otherwise(F.lit(0)))
    inter = {"state_data": filled, "shares": shares, "demand_filled": dem, "elasticity": el, "locations": loc}
    if not aggregated:
        return loc, model, inter
    out = collapse_small(loc.select("state", "mun", "lat", "lon", "MUN_FUEL", "aggregate"),
                         weight="MUN_FUEL")
    return out, model, inter


# ------------------------------------------------------------------ V04
def fuel_panel(consumption: DataFrame, model: DataFrame, prices: DataFrame) -> DataFrame:
    """V04 flagship (W07, J08, P12): (state, mun, lat, lon, date, price, litres).

    predicted = intercept + slope x price per state; curve = predicted / its
    mean over (year, state) (W07); a state without a slope gets curve 1.
    The location table is joined to the daily state prices by state (J08).
    """
    p = prices.join(broadcast_if_small(model.select("state", "intercept", "slope")), "state", "left")
    pred = F.col("intercept") + F.col("slope") * F.col("price")
    p = p.withColumn("pred", pred)
    wy = Window.partitionBy(F.year("date"), "state")
    curve = F.coalesce(safe_div(F.col("pred"), F.avg("pred").over(wy)), F.lit(1.0))
    p = p.select("date", "state", "price", curve.alias("curve"))
    loc = consumption.select("state", "mun", "lat", "lon", "MUN_FUEL").dropDuplicates()
    # the curve has one row per state and day: broadcast while that is small
    j = loc.join(broadcast_if_small(p), "state")
    return j.select("state", "mun", "lat", "lon", "date", "price",
                    (F.col("MUN_FUEL") * F.col("curve") * F.lit(LITRES_PER_BARREL)).alias("litres"))
