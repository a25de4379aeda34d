"""Cases of the calendar forecast family (M06-M08): gaps, unequal ends, overwritten days, totals met every day, scenarios.

The SQL twins are recursive CTEs that rescale inside the recursion and take the
known days from the list at every step.  Prices and volumes are compared as
logarithms: a drift over few known days spans many orders of magnitude.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.cases import case, r
from quarry.functions.exprs import seeded_normal, seeded_normal_sql
from quarry.operators import forecast as FC
from quarry.operators import windows as W
from quarry.sources.fixtures import with_views

LOC = ["state", "mun"]
WIDTH, BACK, DAYS = 28, 14, 34  # window, days of the panel that are forecast anew, forecast days
KNOWN = "list_filter({w}, lambda x: x IS NOT NULL)"


def _step(w: str, model: str = "drift") -> str:
    known = KNOWN.format(w=w)
    age = f"list_position(list_reverse(list_transform({w}, lambda x: x IS NOT NULL)), true)"
    last, first = f"{known}[-1]", f"{known}[1]"
    if model == "seasonal":
        return f"coalesce({w}[{WIDTH - 6}], {last})"
    gap = f"({WIDTH} + 1 - {age} - list_position({w}, {first}))"
    ratio = f"({last} / NULLIF({first}, 0))"
    return f"({last} * CASE WHEN {gap} > 0 AND {ratio} > 0 THEN pow({ratio}, CAST({age} AS DOUBLE) / NULLIF({gap}, 0)) ELSE 1.0 END)"


def _clipped(w: str, nxt: str) -> str:
    ub = W.growth_bound(0.09, WIDTH)
    return f"coalesce({w}[1] * (1.0 + greatest(-{ub!r}, least({ub!r}, {nxt} / NULLIF({w}[1], 0) - 1))), {nxt})"


def _recursion(init: str, days: int, model: str = "drift", saturate: bool = True, target: str | None = None, scenarios: int | None = None) -> str:
    """(state, mun, date, price, litres), with scenarios also scenario."""
    q = "p.litres" if target is None else ("coalesce(p.litres, last_value(p.litres IGNORE NULLS) OVER (PARTITION BY g.state, g.mun ORDER BY g.i), "
                                           "first_value(p.litres IGNORE NULLS) OVER (PARTITION BY g.state, g.mun ORDER BY g.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
    key = "state, mun" + (", scenario" if scenarios else "")
    many = f", range(0, {scenarios}) AS s(scenario)" if scenarios else ""
    np, nq = _step("p", model), _step("q", model)
    if scenarios:
        np = f"({np} * exp(0.05 * {seeded_normal_sql('3', chr(39) + 'p' + chr(39), 'scenario', 'state', 'i')}))"
        nq = f"({nq} * exp(0.05 * {seeded_normal_sql('3', chr(39) + 'q' + chr(39), 'scenario', 'state', 'i')}))"
    scaled = "nq" if target is None else f"nq * ({target.format(d='init + i')}) / NULLIF(sum(nq) OVER (PARTITION BY i), 0)"
    return f"""SELECT {key}, CAST(init AS DATE) + i - 1 AS date, price, litres FROM (WITH RECURSIVE ini AS (SELECT CAST({init} AS DATE) AS init),
grid AS (SELECT l.*, t.i FROM (SELECT DISTINCT state, mun FROM panel, ini WHERE date >= init - {WIDTH} AND date < init) l, range(1, {WIDTH + 1}) AS t(i)),
cells AS (SELECT g.state, g.mun, g.i, p.price AS p, {q} AS q FROM grid g CROSS JOIN ini LEFT JOIN panel p ON p.state = g.state AND p.mun = g.mun AND p.date = ini.init - {WIDTH + 1} + CAST(g.i AS INTEGER)),
seed AS (SELECT state, mun, list(p ORDER BY i) AS p, list(q ORDER BY i) AS q FROM cells GROUP BY 1, 2),
f AS (SELECT {key}, init, 0 AS i, p, q, NULL::DOUBLE AS price, NULL::DOUBLE AS litres FROM seed, ini{many}
  UNION ALL
  SELECT {key}, init, i + 1, list_append(p[2:], np), list_append(q[2:], sq), np, sq FROM (
    SELECT *, {scaled} AS sq FROM (SELECT * REPLACE (p AS p), {_clipped('p', 'raw') if saturate else 'raw'} AS np FROM (
      SELECT *, {np} AS raw, {nq} AS nq FROM f WHERE i < {days}) a) b) c)
SELECT * FROM f WHERE i > 0) z"""


def _logs(sql: str, more: str = "state, mun, date") -> str:
    return f"SELECT {more}, ln(price) AS log_price, ln(litres) AS log_litres FROM ({sql}) y"


def logs(df, *keys):
    return df.select(*keys, F.ln("price").alias("log_price"), F.ln("litres").alias("log_litres"))


LAST = "(SELECT max(date) FROM panel)"
ANEW = f"(SELECT CAST(max(date) AS DATE) - {BACK - 1} FROM panel)"


def anew(panel):
    return F.date_sub(panel.agg(F.max("date").cast("date")).scalar(), BACK - 1)


@case("m06_forecast_calendar", with_views(_logs(_recursion(ANEW, DAYS)), "panel"), rounding=r(6, "log_price", "log_litres"))
def m06_calendar(fx):
    return logs(FC.forecast_calendar(fx.panel, LOC, WIDTH, DAYS, saturate=True, init_date=anew(fx.panel)), *LOC, "date")


@case("m06_forecast_calendar_seasonal", with_views(_logs(_recursion(f"{LAST} + INTERVAL 1 DAY", DAYS, "seasonal", False)), "panel"), rounding=r(6, "log_price", "log_litres"))
def m06_calendar_seasonal(fx):
    return logs(FC.forecast_calendar(fx.panel, LOC, WIDTH, DAYS, model="seasonal"), *LOC, "date")


@case("m06_forecast_extended_panel", with_views(
    f"SELECT state, mun, date, ln(price) AS log_price, ln(litres) AS log_litres FROM (SELECT state, mun, date, price, litres FROM panel WHERE date < {ANEW} OR date > {ANEW} + {DAYS - 1} "
    f"UNION ALL SELECT * FROM ({_recursion(ANEW, DAYS)}) n) e", "panel"), rounding=r(6, "log_price", "log_litres"))
def m06_extended(fx):
    new = FC.forecast_calendar(fx.panel, LOC, WIDTH, DAYS, saturate=True, init_date=anew(fx.panel))
    return logs(FC.extend_panel(fx.panel, new, LOC), *LOC, "date")


BARRELS = 1000.0 * 158.9873027281


@case("m06_forecast_normalized", with_views(_logs(_recursion(f"{LAST} + INTERVAL 1 DAY", 14, target="(870.0 + 30.0 * " + seeded_normal_sql("11", "CAST({d} AS DATE)") + f") * {BARRELS!r}")), "panel"),
      rounding=r(6, "log_price", "log_litres"))
def m06n(fx):
    """The national total of every day is a seeded N(870, 30) thousand barrels; the SQL rescales inside the recursion."""
    def target(d):
        return (F.lit(870.0) + F.lit(30.0) * seeded_normal(F.lit(11), d)) * F.lit(BARRELS)
    return logs(FC.forecast_calendar(fx.panel, LOC, width=WIDTH, horizon=14, target=target, saturate=True), *LOC, "date")


def _m08_sql() -> str:
    days = _recursion(f"{LAST} + INTERVAL 1 DAY", 70, scenarios=5)
    return f"""WITH fc AS MATERIALIZED ({days})
SELECT scenario, period, state, mun, ln(litres) AS log_litres, ln(price) AS log_price, T FROM (
  SELECT scenario, date_trunc('month', date)::DATE AS period, state, mun, sum(litres) AS litres, sum(price * litres) / NULLIF(sum(litres), 0) AS price FROM fc GROUP BY ALL) a
JOIN (SELECT period, CAST(dense_rank() OVER (ORDER BY period) - 1 AS INTEGER) AS T FROM (SELECT DISTINCT date_trunc('month', date)::DATE AS period FROM fc) b) c USING (period)"""


@case("m08_forecast_scenarios", with_views(f"SELECT * FROM ({_m08_sql()}) w", "panel"), rounding=r(6, "log_price", "log_litres"))
def m08_scenarios(fx):
    out, _ = FC.forecast_scenarios(fx.panel, LOC, WIDTH, 5, horizon=70, seed=3, grain="month")
    return logs(out.withColumn("scenario", F.col("scenario").cast("bigint")), "scenario", "period", *LOC, "T")


@case("m08_forecast_periods", with_views(
    f"SELECT period, days, CAST(row_number() OVER (ORDER BY period) - 1 AS INTEGER) AS T FROM (SELECT CAST(year(d) AS INTEGER) AS period, count(*) AS days "
    f"FROM (SELECT CAST({LAST} AS DATE) + CAST(i AS INTEGER) AS d FROM range(1, 401) AS t(i)) a GROUP BY 1) b", "panel"))
def m08_periods(fx):
    _, periods = FC.forecast_scenarios(fx.panel, LOC, WIDTH, 2, horizon=400, seed=3, grain="year")
    return periods
