"""Set operations, reshape, sorts and slices: U01-U07, O01, O03, O04.

Pivots always take explicit values (from a small distinct query on a
dimension, or given by the caller), so no hidden extra job runs and the
column count is known before execution.  Data stays long inside the engine;
wide tables are produced at the output edge only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_tagged(frames: Sequence[tuple[str, DataFrame]], tag: str = "source") -> DataFrame:
    """Union by name with missing columns allowed, each part tagged."""
    out = None
    for name, df in frames:
        x = df.withColumn(tag, F.lit(name))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str, val: str,
                 var_type: str | None = None) -> DataFrame:
    """Unpivot value columns into (var, val); ``var_type`` casts the names (e.g. years)."""
    out = df.unpivot(list(ids), list(values), var, val)
    return out.withColumn(var, F.col(var).cast(var_type)) if var_type else out


def long_to_wide(df: DataFrame, index: Sequence[str], key: str, value: str, values: Sequence,
                 fill: float | None = None, agg=F.first) -> DataFrame:
    """Pivot ``key`` into columns with explicit ``values``; missing cells to ``fill`` when given."""
    w = df.groupBy(*index).pivot(key, list(values)).agg(agg(value))
    if fill is not None:
        w = w.na.fill(fill, subset=[str(v) for v in values])
    return w


def pivot_measures(df: DataFrame, index: Sequence[str], key: str, measures: Sequence[str], values: Sequence[str],
                   subtotal_prefix: str | None = None, fill: float = 0.0) -> DataFrame:
    """U03 + U04: one column per (measure, key value) named ``"{measure} - {value}"``.

    With ``subtotal_prefix``, each measure also gets a column ``measure`` =
    sum over the key values starting with the prefix (computed on long rows,
    before the pivot).  A single conditional aggregation: one pass, one shuffle.
    """
    aggs: list[Column] = []
    for m in measures:
        for v in values:
            aggs.append(F.coalesce(F.sum(F.when(F.col(key) == v, F.col(m))), F.lit(fill)).alias(f"{m} - {v}"))
        if subtotal_prefix:
            aggs.append(F.coalesce(F.sum(F.when(F.col(key).startswith(subtotal_prefix), F.col(m))),
                                   F.lit(fill)).alias(m))
    return df.groupBy(*index).agg(*aggs)


def calendar_spine(start: Column, end: Column, name: str = "date") -> Column:
    """One row per day between two dates (use inside ``select``)."""
    return F.explode(F.sequence(start.cast("date"), end.cast("date"), F.expr("interval 1 day"))).alias(name)


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Overwrite existing (keys) rows with ``new`` values, append the others."""
    b = base.select(*keys, *[F.col(v).alias(f"_o_{v}") for v in values])
    n = new.select(*keys, *[F.col(v).alias(f"_n_{v}") for v in values])
    j = b.join(n, list(keys), "full_outer")
    return j.select(*keys, *[F.when(F.col(f"_n_{v}").isNotNull() | F.col(f"_o_{v}").isNull(), F.col(f"_n_{v}"))
                             .otherwise(F.col(f"_o_{v}")).alias(v) for v in values])


def first_last(df: DataFrame, order: str, which: str = "last") -> DataFrame:
    """Rows of the first or last period (scalar aggregate, broadcast back)."""
    agg = F.max(order) if which == "last" else F.min(order)
    edge = df.agg(agg.alias(order))
    return df.join(F.broadcast(edge), order, "left_semi")


def date_slice(df: DataFrame, col: str, start, end) -> DataFrame:
    """Inclusive date range (pushed down to the scan when ``col`` is a column of it)."""
    return df.filter(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
