"""Registered queries: each pairs a Spark builder with its DuckDB oracle SQL.

A case receives a :class:`~quarry.sources.fixtures.Fixtures` and returns a
DataFrame.  ``rounding`` names the double columns rounded (same digits on
both sides) before the driver hashes values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.fixtures import Fixtures


@dataclass
class Case:
    name: str
    build: Callable[[Fixtures], DataFrame]
    sql: str | None
    rounding: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Fixtures(spark, sf_dir))
        if self.rounding:
            df = df.select(*[snap(F.col(c), self.rounding[c]).alias(c) if c in self.rounding else F.col(c)
                             for c in df.columns])
        return df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.rounding:
            return self.sql
        rep = ", ".join(f"{snap_sql(_q(c), d)} AS {_q(c)}" for c, d in self.rounding.items())
        return f"SELECT * REPLACE ({rep}) FROM (\n{self.sql}\n) AS q"


SNAP_OFFSET = 0.3819660112501051  # 1 - 1/phi


def snap(x, d: int):
    """Snap to a grid of 10^-d with IEEE operations only: floor(x 10^d + c) / 10^d.

    Both engines produce bit-identical doubles from identical inputs.  The
    offset ``c`` is irrational-looking instead of 0.5, so values with short
    decimal expansions (ratios of cents to counts, exact halves) never sit on
    a bucket edge where a one-ulp summation-order difference would flip them.
    """
    s = 10.0 ** d
    snapped = F.floor(x * F.lit(s) + F.lit(SNAP_OFFSET)).cast("double") / F.lit(s)
    # beyond 2^53 the double is already coarser than the grid (and inf / NaN stay as they are)
    return F.when(F.abs(x * F.lit(s)) < F.lit(1e15), snapped).otherwise(x)


def snap_sql(x: str, d: int) -> str:
    s = 10.0 ** d
    sd = f"CAST({s!r} AS DOUBLE)"
    snapped = f"CAST(floor({x} * {sd} + CAST({SNAP_OFFSET!r} AS DOUBLE)) AS DOUBLE) / {sd}"
    return f"(CASE WHEN abs({x} * {sd}) < 1e15 THEN {snapped} ELSE {x} END)"


def _q(c: str) -> str:
    return c if c.replace("_", "").isalnum() else '"' + c.replace('"', '""') + '"'


REGISTRY: dict[str, Case] = {}


def case(name: str, sql: str | None, rounding: dict[str, int] | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate case {name}")
        REGISTRY[name] = Case(name, fn, sql, dict(rounding or {}))
        return fn
    return deco


def r(d: int, *cols: str) -> dict[str, int]:
    return {c: d for c in cols}


def load_all() -> dict[str, Case]:
    # import for registration side effects
    import importlib
    for m in MODULES:
        importlib.import_module(f"quarry.cases.{m}")
    return REGISTRY


MODULES = ["c_valuation", "c_clean", "c_panel", "c_windows", "c_forecast", "c_costing", "c_plan", "c_reconcile", "c_census", "c_census_flow", "c_misc", "c_sources"]
