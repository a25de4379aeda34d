"""Window operators W01-W13 (W01 / W03 / W07 / W09 / W11 live next to their plans).

Every window is partitioned by an entity key (location, run x plant);
order-only windows run on distinct period tables, which are then joined
back by broadcast (W02), so no fact table is ever pulled into one task.
Frames are bounded (``rowsBetween(-(L-1), 0)``), so the per-row state is at
most ``L`` values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.exprs import safe_div, sigmoid
from quarry.session import broadcast_if_small


# ------------------------------------------------------------------ W02
def dense_index(df: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """Dense index of the distinct values of ``col`` from 0, joined back.

    The ordering window runs on the distinct values only (one row per date or
    period), which is then broadcast to the fact rows when its estimate is small
    (a calendar is; a column of raw timestamps may not be).
    """
    d = df.select(col).distinct()
    d = d.select(col, (F.dense_rank().over(Window.orderBy(col)) - 1).cast("int").alias(out))
    return df.join(broadcast_if_small(d), col)


# ------------------------------------------------------------------ W04 / W06 / W13
def sliding_windows(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str],
                    length: int, label_width: int = 1) -> DataFrame:
    """Fixed-length windows with stride 1, split into inputs and labels.

    One row per complete window (its last row), with an ``inputs`` and a
    ``labels`` array of structs.  Incomplete windows (fewer than ``length``
    rows so far) are dropped, giving ``n - length + 1`` windows per entity.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(length - 1), 0)
    st = F.struct(F.col(order).alias("t"), *[F.col(v) for v in values])
    x = df.select(*keys, F.col(order).alias("end"), F.collect_list(st).over(w).alias("win"))
    x = x.filter(F.size("win") == length)
    n_in = length - label_width
    return x.select(*keys, "end", F.col("win")[0]["t"].alias("start"),
                    F.slice("win", 1, n_in).alias("inputs"), F.slice("win", n_in + 1, label_width).alias("labels"))


def window_moments(df: DataFrame, keys: Sequence[str], order: str, value: str, length: int) -> DataFrame:
    """Mean and population std over the trailing ``length`` rows (complete frames only)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(length - 1), 0)
    return df.select(*keys, order, value, F.count(value).over(w).alias("n"),
                     F.avg(value).over(w).alias("mean"), F.stddev_pop(value).over(w).alias("std")) \
        .filter(F.col("n") == length).drop("n")


def chain_level(first: Column, returns: Column) -> Column:
    """``x0 * prod(1 + r)`` over an array of returns (higher-order ``aggregate``)."""
    return F.aggregate(returns, first, lambda acc, r: acc * (F.lit(1.0) + r))


# ------------------------------------------------------------------ W05
def squashed_change(df: DataFrame, keys: Sequence[str], order: str, value: str, first_zero: bool = True,
                    out: str = "chg") -> DataFrame:
    """sigmoid(x_t / x_{t-1} - 1) with 0/0 guarded (to 0 before the squash).

    ``first_zero`` keeps the first row with change 0 (numpy form); otherwise it is dropped.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag(value).over(w)
    r = F.coalesce(safe_div(F.col(value), prev) - 1, F.lit(0.0))
    x = df.select(*keys, order, value, prev.isNull().alias("_first"), r.alias("_r"))
    if first_zero:
        return x.select(*keys, order, value, F.when(F.col("_first"), F.lit(0.0))
                        .otherwise(sigmoid(F.col("_r"))).alias(out))
    return x.filter(~F.col("_first")).select(*keys, order, value, sigmoid(F.col("_r")).alias(out))


# ------------------------------------------------------------------ W08
def chronological_split(df: DataFrame, order: str, test_size: float = 0.2, mode: str = "default",
                        out: str = "split") -> DataFrame:
    """Label rows by the position of their date among the distinct dates.

    default: train [0, n-2t), validation [n-2t, n-t), test [n-t, n), t = int(f n).
    ``mode='reference'`` reproduces the overlapping ranges (test from t,
    train from 2t, validation from 3t): a row gets the most specific label
    and an ``in_*`` flag for each range.
    """
    d = df.select(order).distinct()
    w_all = Window.partitionBy()
    d = d.select(order, (F.dense_rank().over(Window.orderBy(order)) - 1).alias("_i"),
                 F.count(F.lit(1)).over(w_all).alias("_n"))
    t = F.floor(F.col("_n") * test_size)
    if mode == "reference":
        d = d.select(order, (F.col("_i") >= t).alias("in_test"), (F.col("_i") >= 2 * t).alias("in_train"),
                     (F.col("_i") >= 3 * t).alias("in_validation"))
    else:
        lab = F.when(F.col("_i") < F.col("_n") - 2 * t, F.lit("train")) \
            .when(F.col("_i") < F.col("_n") - t, F.lit("validation")).otherwise(F.lit("test"))
        d = d.select(order, lab.alias(out))
    return df.join(broadcast_if_small(d), order)


def target_pairs(df: DataFrame, keys: Sequence[str], order: str, value: str, horizon: int) -> DataFrame:
    """W08 (``target_split``): pair each value with the one ``horizon`` rows later."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select(*keys, order, F.col(value).alias("history"), F.lead(value, horizon).over(w).alias("target")) \
        .filter(F.col("target").isNotNull())


# ------------------------------------------------------------------ W10
def carried_state(df: DataFrame, keys: Sequence[str], order: str, closing: str, opening: str,
                  tol: float = 1e-3) -> DataFrame:
    """Previous closing value (0 for the first period) against the opening value."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.coalesce(F.lag(closing).over(w), F.lit(0.0))
    return df.select("*", prev.alias("prev_closing"),
                     (F.abs(F.col(opening) - prev) > tol).alias("broken"))


# ------------------------------------------------------------------ W12
def growth_bound(annual_cap: float = 0.09, period_days: int = 56) -> float:
    daily = (1.0 + annual_cap) ** (1.0 / 365) - 1.0
    return (1.0 + daily) ** period_days - 1.0


def limit_growth(df: DataFrame, keys: Sequence[str], order: str, value: str, lag_rows: int = 56,
                 annual_cap: float = 0.09, out: str | None = None) -> DataFrame:
    """Clip the change against the value ``lag_rows`` earlier to +- the compounded cap, rebuild."""
    ub = growth_bound(annual_cap, lag_rows)
    w = Window.partitionBy(*keys).orderBy(order)
    base = F.lag(value, lag_rows).over(w)
    chg = safe_div(F.col(value), base) - 1
    clipped = F.greatest(F.lit(-ub), F.least(F.lit(ub), chg))
    rebuilt = F.coalesce(base * (F.lit(1.0) + clipped), F.col(value))
    return df.select(*df.columns, rebuilt.alias(out or f"{value}_limited"))


def window_at(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], length: int,
              end_index: int) -> DataFrame:
    """W04 (``test_data``): the window of ``length`` dates ending at date index ``end_index``
    plus the response row that follows it, per entity.

    Date indices come from W02 (dense over the distinct dates); only the
    ``length + 1`` rows per entity inside the range are collected.
    """
    x = dense_index(df, order, "_idx").filter(F.col("_idx").between(end_index - length + 1, end_index + 1))
    st = F.struct(F.col("_idx").alias("i"), F.col(order).alias("t"), *[F.col(v) for v in values])
    g = x.groupBy(*keys).agg(F.sort_array(F.collect_list(st)).alias("_w"))
    inputs = F.filter("_w", lambda s: s["i"] <= end_index)
    response = F.filter("_w", lambda s: s["i"] == end_index + 1)
    return g.select(*keys, inputs.alias("inputs"), F.try_element_at(response, F.lit(1)).alias("response"))
