"""Calendar forecast (M06-M08) against a plain day-by-day recursion: gaps, unequal ends, overwritten days, totals, shocks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import forecast as FC
from quarry.operators.windows import growth_bound
from quarry.plans.project import Project

BASE = dt.date(2024, 1, 1)
KEYS = ["state", "mun"]
SCHEMA = "state string, mun string, date date, price double, litres double"


def day(i):
    return BASE + dt.timedelta(days=i)


def rows(seed=5):
    rng = random.Random(seed)
    out = [("s", "dense", day(i), 10.0 + i, 100.0 + 3 * i) for i in range(20)]
    out += [("s", "gaps", day(i), 8.0 + rng.random(), 50.0 + 10 * rng.random()) for i in range(20) if rng.random() < 0.5]
    out += [("s", "early", day(i), 5.0, 20.0 + i) for i in range(15)]  # ends five days before the others
    out += [("s", "silent", day(i), 5.0, 20.0) for i in range(3)]      # nothing in the first window
    return out + [("s", "zero", day(i), 0.0, 0.0) for i in range(10, 20)]


def brute(width, init, days, data, saturate=False, target=None):
    series = {}
    for _, m, d, p, q in data:
        if d < init:
            series.setdefault(m, {})[d] = [p, q]
    ub = growth_bound(0.09, width)
    first = init - dt.timedelta(days=width)
    series = {m: {d: v for d, v in s.items() if d >= first} for m, s in series.items()}
    series = {m: s for m, s in series.items() if s}
    if target:
        for s in series.values():
            known = sorted(s)
            for k in range(width):
                d = first + dt.timedelta(days=k)
                if d not in s:
                    past = [x for x in known if x <= d]
                    s[d] = [None, s[past[-1] if past else known[0]][1]]
    for i in range(days):
        d = init + dt.timedelta(days=i)
        new = {}
        for m, s in series.items():
            cell = []
            for v in (0, 1):
                win = [(t, x[v]) for t, x in sorted(s.items()) if d - dt.timedelta(days=width) <= t < d and x[v] is not None]
                (tf, f), (tl, last) = win[0], win[-1]
                gap = (tl - tf).days
                grow = (last / f) ** ((d - tl).days / gap) if gap > 0 and f and last / f > 0 else 1.0
                cell.append(last * grow)
            base = s.get(d - dt.timedelta(days=width), [None])[0]
            if saturate and base:
                cell[0] = base * (1 + max(-ub, min(ub, cell[0] / base - 1)))
            new[m] = cell
        total = sum(c[1] for c in new.values())
        for m, c in new.items():
            series[m][d] = [c[0], c[1] * target / total if target else c[1]]
    return {(m, d): tuple(x) for m, s in series.items() for d, x in s.items() if d >= init}


@pytest.mark.parametrize("width,init,days,saturate,target", [(6, 20, 9, False, None), (6, 20, 9, True, None), (7, 14, 12, True, None), (6, 20, 9, True, 500.0), (5, 17, 8, False, 70.0)])
def test_calendar_forecast_matches_recursion(spark, width, init, days, saturate, target):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = FC.forecast_calendar(df, KEYS, width, days, target=None if target is None else (lambda d: F.lit(target)), saturate=saturate, init_date=day(init))
    want = brute(width, day(init), days, rows(), saturate, target)
    got = {(r.mun, r.date): (r.price, r.litres) for r in got.collect()}
    assert set(got) == set(want) and not any(m == "silent" for m, _ in got)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9), k


def test_default_days_and_final_date_agree(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    key = lambda f: sorted(map(tuple, f.collect()))
    a = key(FC.forecast_calendar(df, KEYS, 6, 5))
    assert a == key(FC.forecast_calendar(df, KEYS, 6, init_date=day(20), final_date=day(24))) == key(Project.forecast(df, 6, final_date=day(24), saturate=False))
    with pytest.raises(ValueError):
        FC.forecast_calendar(df, KEYS, 6)


def test_extended_panel_overwrites_and_appends(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    new = FC.forecast_calendar(df, KEYS, 6, 8, init_date=day(15))
    out = {(r.mun, r.date): r.price for r in FC.extend_panel(df, new, KEYS).collect()}
    fresh = {(r.mun, r.date): r.price for r in new.collect()}
    kept = {(m, d): p for _, m, d, p, _ in rows() if d < day(15)}
    assert out == {**kept, **fresh}


def test_no_loop_and_no_single_task_over_locations(spark):
    df = spark.range(1000).select(F.lit("s").alias("state"), F.col("id").cast("string").alias("mun"), F.lit(day(0)).alias("date"), F.lit(1.0).alias("price"), F.lit(1.0).alias("litres"))
    plan = FC.forecast_calendar(df, KEYS, 6, 5, target=lambda d: F.lit(1.0))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Checkpoint" not in plan and "LogicalRDD" not in plan


def test_scenarios_shock_every_step_and_periods_follow_the_calendar(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    calm, periods = FC.forecast_scenarios(df, KEYS, 6, 2, horizon=40, grain="month", price_sd=0.0, volume_sd=0.0, saturate=False)
    plain = FC.forecast_calendar(df, KEYS, 6, 40)
    want = {(r.mun, r.m): (r.q, r.p) for r in plain.groupBy("mun", F.trunc("date", "MM").alias("m")).agg(
        F.sum("litres").alias("q"), F.try_divide(F.sum(F.col("price") * F.col("litres")), F.sum("litres")).alias("p")).collect()}
    got = calm.collect()
    assert {r.scenario for r in got} == {0, 1} and len(got) == 2 * len(want)
    for r in got:
        litres, price = want[r.mun, r.period]
        assert r.litres == pytest.approx(litres, rel=1e-9) and (r.price is price is None or r.price == pytest.approx(price, rel=1e-9))
    assert [(r.period, r.days, r["T"]) for r in periods.orderBy("T").collect()] == [(dt.date(2024, 1, 1), 11, 0), (dt.date(2024, 2, 1), 29, 1)]
    wild, _ = FC.forecast_scenarios(df, KEYS, 6, 3, horizon=40, grain="month")
    assert len({round(r.litres, 6) for r in wild.filter("mun = 'dense' and T = 0").collect()}) == 3
    years, table = Project.annual_data(df, 2, final_date=day(400), width=6)
    assert table.agg(F.sum("days")).first()[0] == 381 and years.filter("mun = 'dense'").count() == 4


def test_empty_panel(spark):
    assert FC.forecast_calendar(spark.createDataFrame([], SCHEMA), KEYS, 6, 5).count() == 0


def test_few_entities_are_dealt_to_several_tasks(spark):
    """A forecast's many steps per row are not left to one task because its rows are few."""
    rows = [(f"s{k % 3}", f"m{k}", dt.date(2020, 1, 1 + d), 1.0 + k, 2.0 + d) for k in range(40) for d in range(5)]
    df = spark.createDataFrame(rows, "state string, mun string, date date, price double, litres double").coalesce(1)
    out = FC.forecast_calendar(df, ["state", "mun"], 4, 3)
    assert out.count() == 40 * 3
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
