"""Hierarchical reconciliation R01-R04.

R01 makes detail rows add up to published totals level by level (finest to
coarsest).  Per level L with keys K_L, S = aggregate of the previous level's
result, D = published total, n = detail count, x = RAW detail value:

    r_L = coalesce(S / D, 1)            (``ratio='direct'``: D / S)
    d_L = (r_L * A_L(x) - D) / n        (A = sum, or mean for mean-type columns; with
                                         ``ratio='direct'`` mean columns shift by the full
                                         gap, so their mean reaches D)
    y_L = x * r_L - d_L                 (NULL when the level has no total)

Because x restarts from the raw rows at every level and r, d are constant
inside a group, every level needs only group statistics of the level below:
the whole chain runs on grouped tables (partial + final aggregation, so a hot
state costs nothing extra), and detail rows are touched twice: once for the
finest statistics and once for the final ``x * r - d`` with the coarsest
group's factors joined back by broadcast.  No window over a skewed key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import broadcast_if_small


def level_factors(n: Column, sx: Column, c: Column, k: Column, published: Column, is_mean: bool, ratio: str) -> tuple[Column, Column, Column]:
    """(r, d, contribution to the next level's S) of one group and measure.

    ``n`` rows, ``sx`` sum of raw values, ``c`` / ``k`` sum and count of the level
    below, ``published`` the total (null when there is none).
    """
    S = F.try_divide(c, k) if is_mean else F.coalesce(c, F.lit(0.0))
    if ratio == "direct":
        r = F.coalesce(F.try_divide(published, S), F.lit(1.0))
    else:
        r = F.coalesce(F.try_divide(S, published), F.lit(1.0))
    ax = F.try_divide(sx, n) if is_mean else sx
    if is_mean and ratio == "direct":
        d = r * ax - published  # the mean itself reaches the published value
    else:
        d = F.try_divide(r * ax - published, n)
    return r, d, r * sx - n * d


def reconcile(detail: DataFrame, levels: Sequence[tuple[Sequence[str], DataFrame]], sums: Sequence[str],
              means: Sequence[str] = (), ratio: str = "reference") -> DataFrame:
    """``levels`` = [(keys, totals), ...] from the finest to the coarsest level.

    ``totals`` holds one row per group with the published value of every measure.
    Returns the detail rows with reconciled measures.
    """
    measures = list(sums) + list(means)
    prev = None  # group statistics of the previous level: keys + (c_m, k_m, sx_m, n)
    for i, (keys, totals) in enumerate(levels):
        keys = list(keys)
        if prev is None:
            g = detail.groupBy(*keys).agg(
                F.count(F.lit(1)).alias("n"),
                *[F.sum(m).alias(f"sx_{m}") for m in measures],
                # S from the raw rows at the first level: sum, or mean over non-null rows
                *[F.sum(m).alias(f"c_{m}") for m in measures],
                *[F.count(m).alias(f"k_{m}") for m in measures])
        else:
            g = prev.groupBy(*keys).agg(
                F.sum("n").alias("n"),
                *[F.sum(f"sx_{m}").alias(f"sx_{m}") for m in measures],
                *[F.sum(f"c_{m}").alias(f"c_{m}") for m in measures],
                *[F.sum(F.when(F.col(f"c_{m}").isNotNull(), F.col(f"k_{m}"))).alias(f"k_{m}") for m in measures])
        tot = totals.select(*keys, *[F.col(m).alias(f"D_{m}") for m in measures])
        g = g.join(broadcast_if_small(tot), keys, "left")
        cols = [*keys, "n"]
        for m in measures:
            sx, c, k, D = F.col(f"sx_{m}"), F.col(f"c_{m}"), F.col(f"k_{m}"), F.col(f"D_{m}")
            is_mean = m in means
            r, d, contrib = level_factors(F.col("n"), sx, c, k, D, is_mean, ratio)
            cols += [sx.alias(f"sx_{m}"), contrib.alias(f"c_{m}"),
                     F.when(d.isNotNull(), F.col("n")).alias(f"k_{m}"), r.alias(f"r_{m}"), d.alias(f"d_{m}")]
        prev = g.select(*cols)
    last_keys = list(levels[-1][0])
    fac = prev.select(*last_keys, *[F.col(f"r_{m}") for m in measures], *[F.col(f"d_{m}") for m in measures])
    j = detail.join(broadcast_if_small(fac), last_keys, "left")
    other = [c for c in detail.columns if c not in measures]
    return j.select(*other, *[(F.col(m) * F.col(f"r_{m}") - F.col(f"d_{m}")).alias(m) for m in measures])


def ratio_normalise(rows: DataFrame, group: Sequence[str], measures: Sequence[str], total_flag: str = "is_total") -> DataFrame:
    """Scale detail rows by sum(total rows) / sum(detail rows) of their group; drop total rows."""
    g = rows.groupBy(*group).agg(*[F.try_divide(F.sum(F.when(F.col(total_flag), F.col(m))),
                                               F.sum(F.when(~F.col(total_flag), F.col(m)))).alias(f"R_{m}")
                                   for m in measures])
    j = rows.filter(~F.col(total_flag)).join(broadcast_if_small(g), list(group), "left")
    other = [c for c in rows.columns if c not in measures and c != total_flag]
    return j.select(*other, *[(F.col(m) * F.col(f"R_{m}")).alias(m) for m in measures])


def split_by_name(rows: DataFrame, name_col: str, total_name: str, total_word: str = "Total") -> DataFrame:
    """One table's rows marked ``is_total``: the rows named ``total_name``; rows with any other total's name go."""
    named = F.coalesce(F.col(name_col), F.lit(""))
    return rows.filter((named == total_name) | ~named.contains(total_word)).withColumn("is_total", named == total_name)


def closing_check(reconciled: DataFrame, totals: DataFrame, keys: Sequence[str], measure: str,
                  tol: float = 1e-2) -> DataFrame:
    """Reconciled total within ``tol`` of the published total, per group."""
    a = reconciled.groupBy(*keys).agg(F.sum(measure).alias("reconciled"))
    j = a.join(totals.select(*keys, F.col(measure).alias("published")), list(keys))
    ratio = F.try_divide(F.col("reconciled"), F.col("published"))
    return j.select(*keys, "reconciled", "published", (F.abs(ratio - 1) < tol).alias("ok"))


def attach_names(df: DataFrame, names: DataFrame, keys: Sequence[str], name_col: str, fill: str = "N/A") -> DataFrame:
    """Left join to a distinct name table, ``N/A`` when absent (one name per key)."""
    n = names.groupBy(*keys).agg(F.max(name_col).alias(name_col))
    return df.join(broadcast_if_small(n), list(keys), "left").withColumn(
        name_col, F.coalesce(F.col(name_col), F.lit(fill)))
