"""Cases for windows and time series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.cases import case, r
from quarry.functions.exprs import seeded_normal, seeded_normal_sql
from quarry.operators import forecast as FC
from quarry.operators import windows as W
from quarry.operators.aggs import period_calendar, volume_weighted_price
from quarry.sources.fixtures import with_views

L = 7           # window length (rows)
LOC = ["state", "mun"]


# ------------------------------------------------------------------ W02
@case("w02_dense_date_index",
      with_views("SELECT p.state, p.mun, p.date, d.idx FROM panel p JOIN (SELECT date, CAST(dense_rank() OVER "
                 "(ORDER BY date) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT date FROM panel) x) d USING (date)",
                 "panel"))
def w02(fx):
    return W.dense_index(fx.panel.select("state", "mun", "date"), "date")


# ------------------------------------------------------------------ W04
W04_SQL = f"""
SELECT state, mun, date AS "end", start, in_mean_price, label_litres FROM (
  SELECT state, mun, date,
         first_value(date) OVER (PARTITION BY state, mun ORDER BY date ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW) AS start,
         count(*) OVER (PARTITION BY state, mun ORDER BY date ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW) AS n,
         avg(price) OVER (PARTITION BY state, mun ORDER BY date ROWS BETWEEN {L - 1} PRECEDING AND 1 PRECEDING) AS in_mean_price,
         litres AS label_litres
  FROM panel) x WHERE n = {L}"""


@case("w04_sliding_windows", with_views(W04_SQL, "panel"), rounding=r(4, "in_mean_price", "label_litres"))
def w04(fx):
    s = W.sliding_windows(fx.panel, LOC, "date", ["price", "litres"], L, 1)
    prices = F.transform("inputs", lambda x: x["price"])
    mean = F.aggregate(prices, F.lit(0.0), lambda a, x: a + x) / F.size(prices)
    return s.select("state", "mun", "end", "start", mean.alias("in_mean_price"),
                    F.col("labels")[0]["litres"].alias("label_litres"))


@case("w04_window_count",
      with_views("SELECT state, mun, count(*) - " + str(L - 1) + " AS windows FROM panel GROUP BY state, mun "
                 f"HAVING count(*) >= {L}", "panel"))
def w04n(fx):
    s = W.sliding_windows(fx.panel, LOC, "date", ["price"], L, 1)
    return s.groupBy("state", "mun").agg(F.count(F.lit(1)).alias("windows"))


# ------------------------------------------------------------------ W05 / W13
W05_SQL = """
SELECT state, mun, date, price, CASE WHEN prev IS NULL THEN 0.0
       ELSE 1.0 / (1.0 + exp(-coalesce(price / NULLIF(prev, 0) - 1, 0.0))) END AS chg
FROM (SELECT state, mun, date, price, lag(price) OVER (PARTITION BY state, mun ORDER BY date) AS prev FROM panel) x"""


@case("w05_squashed_change", with_views(W05_SQL, "panel"), rounding={"price": 4, "chg": 8})
def w05(fx):
    return W.squashed_change(fx.panel, LOC, "date", "price")


@case("w13_chain_level",
      with_views(f"""
SELECT state, mun, date AS "end", lvl FROM (
  SELECT state, mun, date,
         count(*) OVER w AS n,
         first_value(price) OVER w * product(1.0 + chg) OVER w AS lvl
  FROM w05 WINDOW w AS (PARTITION BY state, mun ORDER BY date ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW)) x
WHERE n = {L}""", "panel", extra=dict(w05=W05_SQL)), rounding=r(4, "lvl"))
def w13(fx):
    ch = W.squashed_change(fx.panel, LOC, "date", "price")
    s = W.sliding_windows(ch, LOC, "date", ["price", "chg"], L, 0)
    first = F.col("inputs")[0]["price"]
    rets = F.transform("inputs", lambda x: x["chg"])
    return s.select("state", "mun", "end", W.chain_level(first, rets).alias("lvl"))


# ------------------------------------------------------------------ W06
@case("w06_window_moments",
      with_views(f"""
SELECT state, mun, date, price, mean, std FROM (
  SELECT state, mun, date, price, count(price) OVER w AS n, avg(price) OVER w AS mean, stddev_pop(price) OVER w AS std
  FROM panel WINDOW w AS (PARTITION BY state, mun ORDER BY date ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW)) x
WHERE n = {L}""", "panel"), rounding=r(4, "price", "mean", "std"))
def w06(fx):
    return W.window_moments(fx.panel, LOC, "date", "price", L)


# ------------------------------------------------------------------ W08
SPLIT_SQL = ("SELECT date, CASE WHEN i < n - 2 * floor(n * CAST(0.2 AS DOUBLE)) THEN 'train' "
             "WHEN i < n - floor(n * CAST(0.2 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM "
             "(SELECT date, dense_rank() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n "
             "FROM (SELECT DISTINCT date FROM panel) d) x")


@case("w08_chronological_split",
      with_views("SELECT p.state, p.mun, p.date, l.split FROM panel p JOIN lab l USING (date)", "panel",
                 extra=dict(lab=SPLIT_SQL)))
def w08(fx):
    return W.chronological_split(fx.panel.select("state", "mun", "date"), "date", 0.2)


@case("w08_chronological_split_reference",
      with_views("SELECT p.state, p.mun, p.date, i >= t AS in_test, i >= 2 * t AS in_train, i >= 3 * t AS in_validation "
                 "FROM panel p JOIN (SELECT date, i, floor(n * CAST(0.2 AS DOUBLE)) AS t FROM (SELECT date, "
                 "dense_rank() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date "
                 "FROM panel) d) x) l USING (date)", "panel"))
def w08r(fx):
    return W.chronological_split(fx.panel.select("state", "mun", "date"), "date", 0.2, mode="reference")


@case("w08_target_pairs",
      with_views("SELECT * FROM (SELECT state, mun, date, litres AS history, lead(litres, 3) OVER (PARTITION BY "
                 "state, mun ORDER BY date) AS target FROM panel) x WHERE target IS NOT NULL", "panel"),
      rounding=r(4, "history", "target"))
def w08t(fx):
    return W.target_pairs(fx.panel, LOC, "date", "litres", 3)


# ------------------------------------------------------------------ W12
def _ub():
    return W.growth_bound(0.09, 56)


@case("w12_limit_growth",
      with_views(f"""
SELECT state, mun, date, price, coalesce(base * (1.0 + greatest(-{_ub()!r}, least({_ub()!r}, price / NULLIF(base, 0) - 1))),
       price) AS price_limited
FROM (SELECT state, mun, date, price, lag(price, 56) OVER (PARTITION BY state, mun ORDER BY date) AS base FROM panel) x""",
                 "panel"), rounding=r(4, "price", "price_limited"))
def w12(fx):
    return W.limit_growth(fx.panel.select("state", "mun", "date", "price"), LOC, "date", "price", 56)


# ------------------------------------------------------------------ A09 / A10 / A19
@case("a09_monthly_weighted_price",
      with_views("SELECT CAST(date_trunc('month', date) AS DATE) AS period, state, mun, sum(litres) AS litres, "
                 "sum(price * litres) AS revenue, sum(price * litres) / NULLIF(sum(litres), 0) AS price "
                 "FROM panel GROUP BY 1, 2, 3", "panel"), rounding=r(4, "litres", "revenue", "price"))
def a09(fx):
    return volume_weighted_price(fx.panel, F.trunc("date", "MM"), LOC)


@case("a10_period_calendar",
      with_views("SELECT period, days, CAST(dense_rank() OVER (ORDER BY period) - 1 AS INTEGER) AS T FROM "
                 "(SELECT CAST(year(date) AS INTEGER) AS period, count(*) AS days FROM (SELECT DISTINCT date FROM panel) d "
                 "GROUP BY 1) g", "panel"))
def a10(fx):
    return period_calendar(fx.panel, "date", "year")


@case("a19_totals_by_step",
      with_views("SELECT date, sum(litres) AS litres, sum(price * litres) / NULLIF(sum(litres), 0) AS price "
                 "FROM panel GROUP BY date", "panel"), rounding=r(4, "litres", "price"))
def a19(fx):
    return FC.totals_by_step(fx.panel)


# ------------------------------------------------------------------ M04 / M05
M04_VIEWS = dict(
    lab=SPLIT_SQL,
    obs="SELECT p.state, p.mun, p.date, p.price AS p, p.litres AS q FROM panel p JOIN lab USING (date) "
        "WHERE split = 'test'",
    pred="SELECT state, mun, date, lag(price) OVER w AS ph, lag(litres) OVER w AS qh FROM panel "
         "WINDOW w AS (PARTITION BY state, mun ORDER BY date)",
    hist="SELECT p.state, p.mun, p.price, p.litres FROM panel p JOIN lab USING (date) WHERE split = 'train'",
    j="SELECT * FROM obs JOIN pred USING (state, mun, date)",
)
APE = "(CASE WHEN {t} = 0 THEN 0.0 ELSE 100.0 * abs({t} - {h}) / abs({t}) END)"
M04_SQL = f"""
SELECT metric, sum(v) AS loss FROM (
  SELECT 'price' AS metric, sum(w * ep) AS v FROM per_loc LEFT JOIN wts USING (state, mun)
  UNION ALL SELECT 'volume', sum(w * eq) FROM per_loc LEFT JOIN wts USING (state, mun)
  UNION ALL SELECT 'price', avg({APE.format(t='P', h='Ph')}) FROM agg
  UNION ALL SELECT 'volume', avg({APE.format(t='Q', h='Qh')}) FROM agg) u
GROUP BY metric"""
M04_VIEWS.update(
    per_loc=f"SELECT state, mun, avg({APE.format(t='p', h='ph')}) AS ep, avg({APE.format(t='q', h='qh')}) AS eq "
            "FROM j GROUP BY state, mun",
    wts="SELECT state, mun, rev / NULLIF(sum(rev) OVER (), 0) AS w FROM (SELECT state, mun, sum(price * litres) AS rev "
        "FROM hist GROUP BY state, mun) x",
    agg="SELECT date, sum(p * q) / NULLIF(sum(q), 0) AS P, sum(q) AS Q, sum(ph * qh) / NULLIF(sum(qh), 0) AS Ph, "
        "sum(qh) AS Qh FROM j GROUP BY date",
)


def _backtest(fx):
    panel = fx.panel
    lab = W.chronological_split(panel, "date", 0.2)
    obs = lab.filter(F.col("split") == "test").select("state", "mun", "date", "price", "litres")
    hist = lab.filter(F.col("split") == "train").select("state", "mun", "price", "litres")
    w = Window.partitionBy("state", "mun").orderBy("date")
    pred = panel.select("state", "mun", "date", F.lag("price").over(w).alias("price"),
                        F.lag("litres").over(w).alias("litres"))
    return obs, pred, hist


@case("m04_revenue_mape", with_views(M04_SQL, "panel", extra=M04_VIEWS), rounding=r(8, "loss"))
def m04(fx):
    obs, pred, hist = _backtest(fx)
    return FC.revenue_mape(obs, pred, hist, LOC)


@case("m05_backtest_series",
      with_views("SELECT date, Q AS litres, P AS price, Qh AS litres_pred, Ph AS price_pred FROM agg", "panel",
                 extra=M04_VIEWS), rounding=r(4, "litres", "price", "litres_pred", "price_pred"))
def m05(fx):
    obs, pred, _ = _backtest(fx)
    o = FC.totals_by_step(obs)
    p = FC.totals_by_step(obs.select("state", "mun", "date").join(pred, ["state", "mun", "date"]))
    return o.join(p.select("date", F.col("litres").alias("litres_pred"), F.col("price").alias("price_pred")), "date")


# ------------------------------------------------------------------ M06
def _m06_sql(model: str, width: int, horizon: int, saturate: bool) -> str:
    """The step-ahead recursion as a recursive CTE over the list of the last ``width`` values."""
    ub = W.growth_bound(0.09, width)

    def step(w):
        if model == "seasonal":
            return f"(CASE WHEN len({w}) >= 7 THEN {w}[len({w}) - 6] ELSE {w}[-1] END)"
        ratio = f"({w}[-1] / NULLIF({w}[1], 0))"
        nxt = f"({w}[-1] * CASE WHEN {ratio} > 0 THEN pow({ratio}, 1.0 / greatest(len({w}) - 1, 1)) ELSE 1.0 END)"
        if not saturate:
            return nxt
        return f"coalesce({w}[1] * (1.0 + greatest(-{ub!r}, least({ub!r}, {nxt} / NULLIF({w}[1], 0) - 1))), {nxt})"

    return f"""SELECT * FROM (WITH RECURSIVE seed AS (
  SELECT state, mun, max(date) AS last, list(price ORDER BY date) AS p, list(litres ORDER BY date) AS q FROM (
    SELECT *, row_number() OVER (PARTITION BY state, mun ORDER BY date DESC) AS rk FROM panel) x WHERE rk <= {width} GROUP BY state, mun),
f AS (SELECT state, mun, last, 0 AS i, p, q, NULL::DOUBLE AS price, NULL::DOUBLE AS litres FROM seed
  UNION ALL
  SELECT state, mun, last, i + 1, list_append(p[2:], np), list_append(q[2:], nq), np, nq FROM (
    SELECT *, {step('p')} AS np, {step('q')} AS nq FROM f WHERE i < {horizon}) s)
SELECT state, mun, CAST(last AS DATE) + i AS date, price, litres FROM f WHERE i > 0) z"""


@case("m06_forecast_drift", with_views(_m06_sql("drift", 28, 30, True), "panel"), rounding=r(3, "price", "litres"))
def m06(fx):
    return FC.forecast(fx.panel, LOC, "date", ["price", "litres"], width=28, horizon=30, model="drift",
                       saturate=True)


@case("m06_forecast_seasonal", with_views(_m06_sql("seasonal", 28, 30, False), "panel"), rounding=r(3, "price", "litres"))
def m06s(fx):
    return FC.forecast(fx.panel, LOC, "date", ["price", "litres"], width=28, horizon=30, model="seasonal")


# ------------------------------------------------------------------ M07
@case("m07_normalise_total",
      with_views("SELECT state, mun, date, litres * ((870.0 + 30.0 * " + seeded_normal_sql("11", "date") +
                 ") * 1000.0 / NULLIF(sum(litres) OVER (PARTITION BY date), 0)) AS litres FROM panel", "panel"),
      rounding=r(4, "litres"))
def m07(fx):
    p = fx.panel.select("state", "mun", "date", "litres")
    target = (F.lit(870.0) + F.lit(30.0) * seeded_normal(F.lit(11), F.col("date"))) * F.lit(1000.0)
    return FC.normalise_total(p, "date", "litres", target)


# ------------------------------------------------------------------ M08
def _m08_sql() -> str:
    zp = seeded_normal_sql("3", "'p'", "scenario", "state", "period")
    zq = seeded_normal_sql("3", "'q'", "scenario", "state", "period")
    return f"""
SELECT scenario, period, state, mun, litres, price, T FROM (
  SELECT scenario, period, state, mun, q * exp(0.05 * {zq}) AS litres,
         (pq * exp(0.05 * {zp}) * exp(0.05 * {zq})) / NULLIF(q * exp(0.05 * {zq}), 0) AS price
  FROM (SELECT CAST(year(date) AS INTEGER) AS period, state, mun, sum(litres) AS q, sum(price * litres) AS pq
        FROM panel GROUP BY 1, 2, 3) b, range(0, 10) AS g(scenario)) x
JOIN (SELECT period, CAST(dense_rank() OVER (ORDER BY period) - 1 AS INTEGER) AS T FROM
      (SELECT DISTINCT CAST(year(date) AS INTEGER) AS period FROM panel) d) t USING (period)"""


@case("m08_scenario_panels", with_views(_m08_sql(), "panel"), rounding=r(2, "litres", "price"))
def m08(fx):
    out, _ = FC.scenario_panels(fx.panel, 10, seed=3, grain="year")
    return out.select(F.col("scenario").cast("bigint").alias("scenario"), "period", "state", "mun", "litres",
                      "price", "T")


# ------------------------------------------------------------------ W04 (window at a date index)
IDX = 1000


@case("w04_window_at_index",
      with_views(f"""
SELECT state, mun, count(*) FILTER (WHERE idx <= {IDX}) AS n_inputs,
       avg(price) FILTER (WHERE idx <= {IDX}) AS in_mean_price,
       max(CASE WHEN idx = {IDX + 1} THEN litres END) AS response_litres
FROM (SELECT p.*, d.idx FROM panel p JOIN (SELECT date, dense_rank() OVER (ORDER BY date) - 1 AS idx
      FROM (SELECT DISTINCT date FROM panel) x) d USING (date)) y
WHERE idx BETWEEN {IDX - L + 1} AND {IDX + 1}
GROUP BY state, mun""", "panel"), rounding=r(4, "in_mean_price", "response_litres"))
def w04i(fx):
    w = W.window_at(fx.panel, LOC, "date", ["price", "litres"], L, IDX)
    prices = F.transform("inputs", lambda s: s["price"])
    return w.select("state", "mun", F.size("inputs").cast("bigint").alias("n_inputs"),
                    F.try_divide(F.aggregate(prices, F.lit(0.0), lambda a, v: a + v), F.size(prices))
                    .alias("in_mean_price"),
                    F.col("response")["litres"].alias("response_litres"))


# ------------------------------------------------------------------ M04 / M05 with the drift step as predictor
DW = 8


def _drift_sql(v: str) -> str:
    last, first = f"lag({v}, 1) OVER w", f"lag({v}, {DW}) OVER w"
    ratio = f"({last} / NULLIF({first}, 0))"
    return f"{last} * CASE WHEN {ratio} > 0 THEN pow({ratio}, {1.0 / (DW - 1)!r}) ELSE 1.0 END"


M04D_VIEWS = dict(M04_VIEWS)
M04D_VIEWS["pred"] = (f"SELECT state, mun, date, {_drift_sql('price')} AS ph, {_drift_sql('litres')} AS qh FROM panel "
                      "WINDOW w AS (PARTITION BY state, mun ORDER BY date)")
M04D_VIEWS = {k: M04D_VIEWS[k] for k in ("lab", "obs", "pred", "hist", "j", "per_loc", "wts", "agg")}


def _backtest_drift(fx):
    obs, _, hist = _backtest(fx)
    pred = FC.one_step_drift(fx.panel, LOC, "date", ["price", "litres"], DW)
    return obs, pred, hist


@case("m04_revenue_mape_drift", with_views(M04_SQL, "panel", extra=M04D_VIEWS), rounding=r(6, "loss"))
def m04d(fx):
    obs, pred, hist = _backtest_drift(fx)
    return FC.revenue_mape(obs, pred, hist, LOC)


@case("m05_backtest_series_drift",
      with_views("SELECT date, Q AS litres, P AS price, Qh AS litres_pred, Ph AS price_pred FROM agg", "panel",
                 extra=M04D_VIEWS), rounding=r(3, "litres", "price", "litres_pred", "price_pred"))
def m05d(fx):
    obs, pred, _ = _backtest_drift(fx)
    o = FC.totals_by_step(obs)
    p = FC.totals_by_step(obs.select("state", "mun", "date").join(pred, ["state", "mun", "date"]))
    return o.join(p.select("date", F.col("litres").alias("litres_pred"), F.col("price").alias("price_pred")), "date")


@case("w05_squashed_change_dropped_first",
      with_views("SELECT state, mun, date, price, 1.0 / (1.0 + exp(-coalesce(price / NULLIF(prev, 0) - 1, 0.0))) AS chg "
                 "FROM (SELECT state, mun, date, price, lag(price) OVER (PARTITION BY state, mun ORDER BY date) AS prev "
                 "FROM panel) x WHERE prev IS NOT NULL", "panel"), rounding={"price": 4, "chg": 8})
def w05d(fx):
    return W.squashed_change(fx.panel, LOC, "date", "price", first_zero=False)
