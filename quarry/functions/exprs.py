"""Column-expression helpers (JVM-side, codegen friendly; no Python UDF).

The missing-value policy of the whole engine lives here (SURVEY §1.4):
pandas' inf / NaN results become SQL NULL through ``try_divide``; where the
reference later replaced them by 0 the caller wraps with ``coalesce(.., 0)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# ---------------------------------------------------------------- arithmetic
def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b, NULL when b is 0 or NULL (pandas gave inf / NaN)."""
    return F.try_divide(c(a), c(b))


def guarded_ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """P10: a / b with inf and NaN mapped to 0."""
    return F.coalesce(F.try_divide(c(a), c(b)), F.lit(0.0))


def ln_pos(x: ColumnOrName) -> Column:
    """Natural log, NULL for x <= 0 (pandas: NaN / -inf, later dropped)."""
    x = c(x)
    return F.when(x > 0, F.ln(x))


def sigmoid(x: ColumnOrName) -> Column:
    """P17."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c(x)))


def capacity_policy(x: ColumnOrName, big: float = 1e25) -> Column:
    """Missing / NaN to 0, +inf to a large finite bound."""
    x = c(x).cast("double")
    x0 = F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))
    return F.when(x0 == F.lit(float("inf")), F.lit(big)).otherwise(x0)


# ---------------------------------------------------------------- geometry
EARTH_RADIUS_KM = 6371.0


def haversine(lon1: ColumnOrName, lat1: ColumnOrName, lon2: ColumnOrName, lat2: ColumnOrName,
              radius_km: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance in km (degrees in)."""
    la1, la2 = F.radians(c(lat1)), F.radians(c(lat2))
    dlat = la2 - la1
    dlon = F.radians(c(lon2)) - F.radians(c(lon1))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2.0 * radius_km) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


# ---------------------------------------------------------------- normal law
# Abramowitz & Stegun 7.1.26 coefficients for erf (|error| < 1.5e-7).
AS_P = 0.3275911
AS_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: ColumnOrName) -> Column:
    x = c(x)
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * ax)
    poly = F.lit(0.0)
    for coef in reversed(AS_A):
        poly = (poly + F.lit(coef)) * t
    y = F.lit(1.0) - poly * F.exp(-ax * ax)
    return F.when(x < 0, -y).otherwise(y)


def norm_cdf(x: ColumnOrName) -> Column:
    """Standard normal CDF."""
    return F.lit(0.5) * (F.lit(1.0) + erf(c(x) / F.lit(math.sqrt(2.0))))


# ---------------------------------------------------------------- seeded draws
TWO32 = 4294967296.0


def seeded_uniform(*parts: ColumnOrName) -> Column:
    """Uniform in (0, 1) from md5 of the key parts.

    Depends only on the key, never on partitioning, so results are the same
    for any number of tasks, after retries, and in DuckDB
    (``(cast(('0x' || substr(md5(s),1,8)) as bigint) + 0.5) / 2^32``).
    """
    s = F.concat_ws("|", *[c(p).cast("string") for p in parts])
    h = F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(TWO32)


def seeded_normal(*parts: ColumnOrName) -> Column:
    """Standard normal draw by Box-Muller on two keyed uniforms."""
    u1 = seeded_uniform(*parts, F.lit("u1"))
    u2 = seeded_uniform(*parts, F.lit("u2"))
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def seeded_uniform_sql(*parts: str) -> str:
    s = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"((CAST(('0x' || substr(md5({s}), 1, 8)) AS BIGINT) + 0.5) / {TWO32})"


def seeded_normal_sql(*parts: str) -> str:
    u1 = seeded_uniform_sql(*parts, "'u1'")
    u2 = seeded_uniform_sql(*parts, "'u2'")
    return f"(sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi} * {u2}))"


# ---------------------------------------------------------------- calendar
DAY_SECONDS = 86400
WEEK_SECONDS = 7 * DAY_SECONDS
MONTH_SECONDS = 30 * DAY_SECONDS


def weekday(d: ColumnOrName) -> Column:
    """Monday = 0 (pandas ``dt.weekday``)."""
    return F.weekday(c(d))


def calendar_features(ts: ColumnOrName, mode: str = "default") -> list[Column]:
    """Cyclic weekday / week / month features.

    ``mode='reference'`` keeps the original quirk of dividing the weekday by
    the week length in seconds (features almost constant).
    """
    ts = c(ts)
    wd = weekday(ts).cast("double")
    period = WEEK_SECONDS if mode == "reference" else 7
    secs = F.unix_timestamp(ts.cast("timestamp")).cast("double")
    two_pi = 2.0 * math.pi
    return [
        F.sin(wd * F.lit(two_pi / period)).alias("day_sin"),
        F.cos(wd * F.lit(two_pi / period)).alias("day_cos"),
        F.sin(secs * F.lit(two_pi / WEEK_SECONDS)).alias("week_sin"),
        F.cos(secs * F.lit(two_pi / WEEK_SECONDS)).alias("week_cos"),
        F.sin(secs * F.lit(two_pi / MONTH_SECONDS)).alias("month_sin"),
        F.cos(secs * F.lit(two_pi / MONTH_SECONDS)).alias("month_cos"),
    ]


# ---------------------------------------------------------------- indicators
def delta_flag(x: ColumnOrName, tol: float = 1e-5) -> Column:
    """P25: 1 when |x| > tol."""
    return F.when(F.abs(c(x)) > tol, 1).otherwise(0)


def step_flag(x: ColumnOrName) -> Column:
    """P25: 1 when x > 0."""
    return F.when(c(x) > 0, 1).otherwise(0)


def rnd(x: ColumnOrName, d: int) -> Column:
    return F.round(c(x), d)


# ---------------------------------------------------------------- SQL twins (oracle text)
def erf_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + {AS_P} * abs({x})))"
    poly = "0.0"
    for coef in reversed(AS_A):
        poly = f"(({poly} + {coef}) * {t})"
    y = f"(1.0 - {poly} * exp(-abs({x}) * abs({x})))"
    return f"(CASE WHEN {x} < 0 THEN -{y} ELSE {y} END)"


def norm_cdf_sql(x: str) -> str:
    return f"(0.5 * (1.0 + {erf_sql(f'({x}) / {math.sqrt(2.0)}')}))"


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str, radius_km: float = EARTH_RADIUS_KM) -> str:
    a = (f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))")
    return f"({2.0 * radius_km} * asin(sqrt(least(1.0, {a}))))"
