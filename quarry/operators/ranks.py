"""Ranks and quantiles over whole tables or hot groups without a task that holds them.

Rows are sorted into range partitions once and kept (``sorted_runs``); a row's
place in the whole order is its place in its run plus the rows of the runs
before, a table of one row per run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import broadcast_if_small, cut_lineage

_RUN_BITS = 33  # monotonically_increasing_id: partition above, place within it below


def sorted_runs(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` with _run and _place (from 0) in the given order.  Written once: both passes over it must see the same runs."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return cut_lineage(sorted_).withColumn("_run", F.shiftright("_at", _RUN_BITS)).withColumn("_place", F.col("_at").bitwiseAND(F.lit((1 << _RUN_BITS) - 1))).drop("_at")


def rows_before(runs: DataFrame, by: Sequence[str] = (), amount: Column | None = None) -> DataFrame:
    """(by, _run, _before): the rows (or ``amount``) of earlier runs; the running sum is over one row per run."""
    sizes = runs.groupBy(*by, "_run").agg(F.sum(F.lit(1) if amount is None else amount).alias("_size"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*by, "_run", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_before"))


def global_rank(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Rows numbered from 1 in the given order, as ``row_number`` over all of them."""
    runs = sorted_runs(df, order)
    j = runs.join(broadcast_if_small(rows_before(runs)), "_run")
    return j.select(*df.columns, (F.col("_before") + F.col("_place") + 1).cast("int").alias(out))


def grouped_quantiles(df: DataFrame, group: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(_g, q0, q1, ...): exact interpolated quantiles per group, equal to ``percentile``.

    Equal values are counted first, so ties cost one row; distinct (group, value)
    pairs are sorted into runs, and only the pairs that cover a wanted place are kept.
    A null group is a group of its own; null values are left out.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    runs = sorted_runs(counted, [F.col("_g").asc_nulls_first(), F.col("_v")])
    key = F.struct("_g").alias("_k")  # a struct compares null groups as equal
    runs = runs.select("*", key)
    here = Window.partitionBy("_k", "_run").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    before = rows_before(runs, ["_k"], F.col("_n"))
    upto = runs.withColumn("_upto", F.sum("_n").over(here)).join(broadcast_if_small(before), ["_k", "_run"]) \
        .select("_k", "_v", (F.col("_before") + F.col("_upto") - F.col("_n")).alias("_from"), (F.col("_before") + F.col("_upto")).alias("_to"))
    total = broadcast_if_small(runs.groupBy("_k").agg(F.sum("_n").alias("_all")))
    placed = upto.join(total, "_k")
    aggs = []
    for i, s in enumerate(shares):
        at = F.lit(s) * (F.col("_all") - 1)
        for name, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((F.col("_from") <= place) & (place < F.col("_to")), F.col("_v"))).alias(f"{name}{i}"))
    found = placed.groupBy("_k", "_all").agg(*aggs)
    def value_at(i, s):
        at, lo, hi = F.lit(s) * (F.col("_all") - 1), F.col(f"lo{i}"), F.col(f"hi{i}")
        return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(f"q{i}")
    return found.select(F.col("_k._g").alias("_g"), *[value_at(i, s) for i, s in enumerate(shares)])
