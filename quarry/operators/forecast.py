"""Forecast, backtest metric and scenario operators M04-M08, A09/A10/A19 helpers.

Forecasting (M06) keeps the reference's step-ahead recursion (each step feeds
the next) but with a statistical step model; it runs per location inside a
higher-order ``aggregate`` on an array of the last ``width`` values, so the
state per location is bounded and the work is parallel over locations.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.exprs import safe_div, seeded_normal
from quarry.operators.windows import growth_bound
from quarry.session import broadcast_if_small, cut_lineage


# ------------------------------------------------------------------ M06
def _step(model: str, win: Column, width: int) -> Column:
    last = F.element_at(win, -1)
    n = F.size(win)  # less than ``width`` for a short history
    if model == "seasonal" and width >= 7:
        return F.when(n >= 7, F.try_element_at(win, n - 6)).otherwise(last)  # same weekday one week earlier
    first = F.element_at(win, 1)
    ratio = F.try_divide(last, first)
    drift = F.when(ratio > 0, F.pow(ratio, F.lit(1.0) / F.greatest(n - 1, F.lit(1)))).otherwise(F.lit(1.0))
    return last * drift


def forecast(panel: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], width: int,
             horizon: int, model: str = "drift", saturate: bool = False, annual_cap: float = 0.09) -> DataFrame:
    """``horizon`` daily steps after each entity's last observation.

    The last ``width`` rows per entity seed the state (rank filter, so the
    collected array never exceeds ``width``); each step appends its value and
    drops the oldest.  A shorter history is used as it is: its own length takes
    the place of ``width`` (no location is left out).  ``saturate`` clips every
    step against the oldest value of the window (W12).
    """
    w_desc = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    recent = panel.select(*keys, order, *values, F.row_number().over(w_desc).alias("_rk")) \
        .filter(F.col("_rk") <= width)
    hist = recent.groupBy(*keys).agg(
        F.max(order).alias("_last"),
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("t"), *[F.col(v) for v in values]))).alias("_h"))
    ub = growth_bound(annual_cap, width)
    def field(name):
        return lambda s: s[name].cast("double")

    def make_step():
        def step(acc, i):
            win = acc["w"]
            nxt = _step(model, win, width)
            if saturate:
                base = F.element_at(win, 1)
                chg = F.greatest(F.lit(-ub), F.least(F.lit(ub), F.try_divide(nxt, base) - 1))
                nxt = F.coalesce(base * (F.lit(1.0) + chg), nxt)
            return F.struct(F.slice(F.concat(win, F.array(nxt)), 2, width).alias("w"),
                            F.concat(acc["out"], F.array(nxt)).alias("out"))
        return step

    cols = []
    for v in values:
        init = F.struct(F.transform("_h", field(v)).alias("w"), F.array().cast("array<double>").alias("out"))
        cols.append(F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), init, make_step())["out"].alias(v))
    fc = hist.select(*keys, "_last", *cols)
    z = fc.select(*keys, "_last", F.arrays_zip(*[F.col(v) for v in values]).alias("_z"))
    ex = z.select(*keys, "_last", F.posexplode("_z").alias("_i", "_s"))
    return ex.select(*keys, F.date_add(F.col("_last").cast("date"), F.col("_i") + 1).alias(order),
                     *[F.col("_s")[v].alias(v) for v in values])


# ------------------------------------------------------------------ M07
def normalise_total(df: DataFrame, date: str, value: str, target: Column) -> DataFrame:
    """Rescale each day so the total over locations equals ``target``."""
    tot = df.groupBy(F.col(date).alias("_day")).agg(F.sum(value).alias("_tot"))  # one row per day
    j = df.join(broadcast_if_small(tot), df[date].eqNullSafe(F.col("_day")))
    return j.withColumn(value, F.col(value) * safe_div(target, F.col("_tot"))).select(*df.columns)


# ------------------------------------------------------------------ M04
def revenue_mape(obs: DataFrame, pred: DataFrame, history: DataFrame, keys: Sequence[str], date: str = "date",
                 p: str = "price", q: str = "litres") -> DataFrame:
    """Revenue-weighted MAPE per metric (price, volume) plus the error of the aggregate series.

    ``obs`` / ``pred``: (keys, date, p, q); ``history``: (keys, p, q) for the revenue weights.
    Returns rows (metric, loss).
    """
    wts = history.groupBy(*keys).agg(F.sum(F.col(p) * F.col(q)).alias("_rev"))
    wts = wts.select(*keys, safe_div(F.col("_rev"), wts.agg(F.sum("_rev")).scalar()).alias("w"))  # one scalar total
    j = obs.select(*keys, date, F.col(p).alias("p"), F.col(q).alias("q")).join(
        pred.select(*keys, date, F.col(p).alias("ph"), F.col(q).alias("qh")), [*keys, date])

    def ape(t, h):
        return F.when(t == 0, F.lit(0.0)).otherwise(F.lit(100.0) * F.abs(t - h) / F.abs(t))

    per_loc = j.groupBy(*keys).agg(F.avg(ape(F.col("p"), F.col("ph"))).alias("ep"),
                                   F.avg(ape(F.col("q"), F.col("qh"))).alias("eq"))
    loc_part = per_loc.join(wts, list(keys), "left").agg(
        F.sum(F.col("w") * F.col("ep")).alias("lp"), F.sum(F.col("w") * F.col("eq")).alias("lq"))
    agg = j.groupBy(date).agg(
        safe_div(F.sum(F.col("p") * F.col("q")), F.sum("q")).alias("P"), F.sum("q").alias("Q"),
        safe_div(F.sum(F.col("ph") * F.col("qh")), F.sum("qh")).alias("Ph"), F.sum("qh").alias("Qh"))
    agg_part = agg.agg(F.avg(ape(F.col("P"), F.col("Ph"))).alias("ap"), F.avg(ape(F.col("Q"), F.col("Qh"))).alias("aq"))
    def long(df, pcol, qcol):
        return df.select(F.explode(F.array(
            F.struct(F.lit("price").alias("metric"), F.col(pcol).alias("v")),
            F.struct(F.lit("volume").alias("metric"), F.col(qcol).alias("v")))).alias("m")).select("m.*")
    parts = long(loc_part, "lp", "lq").unionByName(long(agg_part, "ap", "aq"))
    return parts.groupBy("metric").agg(F.sum("v").alias("loss"))


# ------------------------------------------------------------------ A19
def totals_by_step(df: DataFrame, date: str = "date", p: str = "price", q: str = "litres") -> DataFrame:
    """Total volume and volume-weighted price per time step."""
    return df.groupBy(date).agg(F.sum(q).alias(q), safe_div(F.sum(F.col(p) * F.col(q)), F.sum(q)).alias(p))


# ------------------------------------------------------------------ M08
def scenario_panels(panel: DataFrame, n_scenarios: int, seed: int = 0, grain: str = "year",
                    price_sd: float = 0.05, volume_sd: float = 0.05,
                    keys: Sequence[str] = ("state", "mun")) -> tuple[DataFrame, DataFrame]:
    """Many randomised panels reduced to period price / volume, plus the period table.

    Shocks are constant within (scenario, state, period), so the panel is
    aggregated per (period, location) first and only that small table is
    expanded by the scenario ids: work is S x periods x locations, not
    S x fact rows.  Shocks are md5-seeded (M09): independent of partitioning.
    """
    per = F.year("date") if grain == "year" else F.trunc("date", "MM")
    base = panel.groupBy(per.alias("period"), *keys).agg(
        F.sum("litres").alias("q"), F.sum(F.col("price") * F.col("litres")).alias("pq"))
    x = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_scenarios - 1))).alias("scenario"))
    zp = seeded_normal(F.lit(seed), F.lit("p"), F.col("scenario"), F.col(keys[0]), F.col("period"))
    zq = seeded_normal(F.lit(seed), F.lit("q"), F.col("scenario"), F.col(keys[0]), F.col("period"))
    sp, sq = F.exp(F.lit(price_sd) * zp), F.exp(F.lit(volume_sd) * zq)
    out = x.select("scenario", "period", *keys, (F.col("q") * sq).alias("litres"),
                   safe_div(F.col("pq") * sp * sq, F.col("q") * sq).alias("price"))
    dates = panel.select(F.col("date").cast("date").alias("date")).distinct()
    periods = dates.groupBy(per.alias("period")).agg(F.count(F.lit(1)).alias("days"))
    periods = periods.select("period", "days", (F.dense_rank().over(Window.orderBy("period")) - 1)
                             .cast("int").alias("T"))
    return out.join(F.broadcast(periods.select("period", "T")), "period"), periods


def one_step_drift(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], width: int) -> DataFrame:
    """M05 predictor: the M06 drift step applied one step ahead from the observed history.

    pred_t = x_{t-1} * (x_{t-1} / x_{t-width})^(1/(width-1)), x_{t-1} when the ratio is not positive;
    window functions only (partitioned by entity, bounded by ``width`` rows).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    cols = []
    for v in values:
        last, first = F.lag(v, 1).over(w), F.lag(v, width).over(w)
        ratio = F.try_divide(last, first)
        cols.append((last * F.when(ratio > 0, F.pow(ratio, F.lit(1.0 / (width - 1)))).otherwise(F.lit(1.0))).alias(v))
    return df.select(*keys, order, *cols)


# ------------------------------------------------------------------ M06 on the calendar
def _calendar(panel: DataFrame, date: str, init_date, final_date, horizon: int | None) -> tuple[Column, Column]:
    """First forecast day (by default the day after the panel's last one) and the step numbers.

    A default first day stays a scalar subquery with ``horizon``; up to a
    ``final_date`` the last day is read first (one value).
    """
    def given(d):
        return d if isinstance(d, Column) else F.to_date(F.lit(str(d)))
    if final_date is None and horizon is None:
        raise ValueError("give final_date or horizon")
    last = panel.agg(F.max(date).cast("date").alias("last"))
    if init_date is not None:
        init = given(init_date)
    elif final_date is None:
        init = F.date_add(last.scalar(), 1)
    else:
        init = F.date_add(F.lit(last.first()["last"]).cast("date"), 1)
    return init, F.sequence(F.lit(0), F.lit(horizon - 1) if final_date is None else F.datediff(given(final_date), init))


def day_arrays(panel: DataFrame, keys: Sequence[str], values: Sequence[str], width: int, init: Column, date: str = "date",
               filled: Sequence[str] = ()) -> DataFrame:
    """(keys, one array per value): the ``width`` days before ``init`` as positions 1..width, days without a row null.

    Only these days are read.  Entities without a row among them are absent; of
    rows that repeat a day the smallest value counts.  ``filled`` values carry the
    last known day forward and the first one back.
    """
    at = F.datediff(F.col(date).cast("date"), F.date_sub(init, width)) + 1
    tasks = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the few rows cost many steps: not to be coalesced by their size
    seen = panel.filter((F.col(date).cast("date") >= F.date_sub(init, width)) & (F.col(date).cast("date") < init)) \
        .repartition(tasks, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), *[F.col(v).cast("double").alias(v) for v in values]))).alias("_seen"))

    def dense(v: str) -> Column:
        known = F.filter("_seen", lambda x: x[v].isNotNull())

        def cell(i):
            same = F.get(F.filter(known, lambda x: x["at"] == i), 0)[v]
            if v not in filled:
                return same
            return F.coalesce(same, F.try_element_at(F.filter(known, lambda x: x["at"] <= i), F.lit(-1))[v], F.get(known, 0)[v])
        return F.transform(F.sequence(F.lit(1), F.lit(width)), cell).alias(v)
    return seen.select(*keys, *[dense(v) for v in values])


def _fold(days: DataFrame, steps: Column, width: int, model: str, clips: dict[str, float | None], shocks: dict | None = None) -> DataFrame:
    """``days`` with the arrays named in ``clips`` replaced by one value per step.  State: the last ``width`` days, the last known value and its age.

    A batch of entities takes each step together, in arrays; known values are
    marked apart, so that null is not NaN.  Comparisons are Spark's: NaN is above
    every number, a division by zero is null, ``least`` and ``greatest`` pass nulls over.
    """
    def fold(window: pa.Array, each: pa.Array, clip: float | None) -> pa.Array:
        rows = len(window)
        cells, factors = window.flatten(), each.flatten()
        w, known = (np.array(x.to_numpy(zero_copy_only=False)).reshape(rows, width) for x in (pc.fill_null(cells, 0.0), pc.is_valid(cells)))
        horizon = len(factors) // max(rows, 1)
        if shocks is not None:
            by, given = (x.to_numpy(zero_copy_only=False).reshape(rows, horizon) for x in (pc.fill_null(factors, 0.0), pc.is_valid(factors)))
        at = np.arange(rows)
        some = known.any(axis=1)
        age = np.where(some, known[:, ::-1].argmax(axis=1) + 1, 0)
        last, has = w[at, width - np.maximum(age, 1)], some
        out, valid = np.zeros((rows, horizon)), np.zeros((rows, horizon), dtype=bool)
        with np.errstate(all="ignore"):
            for i in range(horizon):
                if model == "seasonal" and width >= 7:  # the same weekday one week earlier
                    nxt, ok = np.where(known[:, width - 7], w[:, width - 7], last), known[:, width - 7] | has
                else:
                    place = known.argmax(axis=1)
                    first = w[at, place]
                    gap = width - age - place
                    ratio = last / first
                    grows = known.any(axis=1) & (first != 0) & (gap > 0) & ((ratio > 0) | np.isnan(ratio))
                    rate = np.power(np.where(grows, ratio, 1.0), age / np.where(grows, gap, 1))
                    nxt, ok = last * np.where(grows, rate, 1.0), has
                if shocks is not None:
                    nxt, ok = nxt * by[:, i], ok & given[:, i]
                if clip is not None:
                    base = w[:, 0]
                    change = np.where(ok & (base != 0), np.maximum(-clip, np.fmin(clip, nxt / base - 1)), clip)
                    nxt, ok = np.where(known[:, 0], base * (1.0 + change), nxt), known[:, 0] | ok
                out[:, i], valid[:, i] = nxt, ok
                w = np.concatenate([w[:, 1:], nxt[:, None]], axis=1)
                known = np.concatenate([known[:, 1:], ok[:, None]], axis=1)
                last, has, age = np.where(ok, nxt, last), has | ok, np.where(ok, 1, age + 1)
        ends = pa.array(np.arange(rows + 1, dtype=np.int32) * horizon)
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel(), mask=~valid.ravel()))

    def batches(found):
        for x in found:
            yield pa.RecordBatch.from_arrays([fold(x.column(c), x.column(f"_by_{c}"), clips[c]) if c in clips else x.column(c) for c in names], names=names)

    names = days.columns
    factors = {c: steps.cast("array<double>") if shocks is None else F.transform(steps, shocks[c]) for c in clips}
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name in clips else f.dataType) for f in days.schema])
    return days.select(*names, *[f.alias(f"_by_{c}") for c, f in factors.items()]).mapInArrow(batches, schema)


def forecast_calendar(panel: DataFrame, keys: Sequence[str], width: int, horizon: int | None = None, target=None,
                      saturate: bool = False, annual_cap: float = 0.09, date: str = "date", price: str = "price",
                      litres: str = "litres", init_date=None, final_date=None, model: str = "drift") -> DataFrame:
    """M06 on a common calendar: every entity from ``init_date`` to ``final_date`` (both included).

    Each entity's state is a dense array of the ``width`` days before the forecast
    day; days without a row stay null.  ``drift`` grows the last known value by the
    daily rate between the first and last known day of that window, ``seasonal``
    takes the value a week earlier.  Rows of the panel from ``init_date`` on are not
    read: their days are forecast anew (``extend_panel`` overwrites or appends them).
    ``saturate`` clips the price change against the value ``width`` days earlier.

    ``target``: a function of the forecast date giving the day's total volume, met
    before the day enters later windows (M07 inside the recursion).  No loop over
    days is needed: one step is homogeneous of degree one in the volumes of its
    window, so when every window has its known days in the same places, the scaled
    recursion is the plain one times one factor per day, and that factor is the
    target over the plain total.  Gaps in the volume would move the known days per
    entity, and clipping is not homogeneous; so with a target the volume's gaps are
    filled (last known day forward, first one back), and only the price is clipped.
    """
    keys = list(keys)
    init, span = _calendar(panel, date, init_date, final_date, horizon)
    days = day_arrays(panel, keys, [price, litres], width, init, date, [litres] if target is not None else [])
    ub = growth_bound(annual_cap, width) if saturate else None
    z = _fold(days, span, width, model, {price: ub, litres: None}).select(*keys, F.arrays_zip(price, litres).alias("_z"))
    out = z.select(*keys, F.posexplode("_z").alias("_i", "_s")) \
        .select(*keys, F.date_add(init, F.col("_i")).alias(date), F.col("_s")[price].alias(price), F.col("_s")[litres].alias(litres))
    if target is None:
        return out
    return normalise_total(out, date, litres, target(F.col(date)))


def extend_panel(panel: DataFrame, predicted: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """The panel with its days from the forecast's first to its last one overwritten, later ones appended.

    The forecast is read for its first day, its last day and its rows: it is computed once, into the checkpoint folder.
    """
    predicted = cut_lineage(predicted)
    bounds = predicted.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    day = F.col(date).cast("date")
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    kept = panel.filter(F.coalesce((day < lo) | (day > hi), F.lit(True)))
    return kept.unionByName(predicted.select(*[F.col(c).cast(panel.schema[c].dataType).alias(c) for c in panel.columns]))


# ------------------------------------------------------------------ M08 from forecasts
def forecast_scenarios(panel: DataFrame, keys: Sequence[str], width: int, n_scenarios: int, horizon: int | None = None, seed: int = 0,
                       grain: str = "year", price_sd: float = 0.05, volume_sd: float = 0.05, saturate: bool = True,
                       annual_cap: float = 0.09, date: str = "date", price: str = "price", litres: str = "litres",
                       init_date=None, final_date=None, model: str = "drift") -> tuple[DataFrame, DataFrame]:
    """M08 on M06: many shocked forecasts reduced to period price and volume, and the period table of the forecast's days.

    Every step of every scenario is multiplied by exp(sd z), z drawn by md5 from
    (seed, metric, scenario, first key, step), so shocks feed later days; with
    ``saturate`` the price is clipped after its shock.  All scenarios run in one
    job: the day arrays (one row per entity) are expanded by the scenario ids.
    """
    keys = list(keys)
    init, span = _calendar(panel, date, init_date, final_date, horizon)
    ub = growth_bound(annual_cap, width) if saturate else None
    days = day_arrays(panel, keys, [price, litres], width, init, date) \
        .withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(n_scenarios - 1))))

    def shock(metric, sd):
        return lambda i: F.exp(F.lit(sd) * seeded_normal(F.lit(seed), F.lit(metric), F.col("scenario"), F.col(keys[0]), i))
    z = _fold(days, span, width, model, {price: ub, litres: None}, {price: shock("p", price_sd), litres: shock("q", volume_sd)}) \
        .select(*keys, "scenario", F.arrays_zip(F.col(price).alias("p"), F.col(litres).alias("q")).alias("_z"))
    def period(day):
        return F.year(day) if grain == "year" else F.trunc(day, "MM")
    daily = z.select(*keys, "scenario", F.posexplode("_z").alias("_i", "_s"))
    sums = daily.groupBy("scenario", period(F.date_add(init, F.col("_i"))).alias("period"), *keys) \
        .agg(F.sum("_s.q").alias(litres), F.sum(F.col("_s.p") * F.col("_s.q")).alias("revenue"))
    calendar = panel.sparkSession.range(1).select(F.explode(span).alias("_i")).select(F.date_add(init, F.col("_i")).alias("day"))
    periods = calendar.groupBy(period(F.col("day")).alias("period")).agg(F.count(F.lit(1)).alias("days"))
    periods = periods.select("period", "days", (F.dense_rank().over(Window.orderBy("period")) - 1).cast("int").alias("T"))
    out = sums.join(F.broadcast(periods.select("period", "T")), "period")  # one row per period of the calendar
    return out.select("scenario", "period", *keys, litres, safe_div(F.col("revenue"), F.col(litres)).alias(price), "T"), periods
