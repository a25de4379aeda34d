"""Cases for the plan audit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.cases import case, r
from quarry.operators.windows import carried_state
from quarry.plans import audit as AU
from quarry.sources.fixtures import with_views


def plan_state(fx):
    """Plant-period decisions derived from the plan fixture (runs = priorities)."""
    p = fx.plan
    w = Window.partitionBy("file", "plant").orderBy("T")
    s1 = (F.col("revenues") > F.col("costs")).cast("int")
    c1 = (F.col("production") > 200).cast("int")
    x = p.select("file", "T", "plant", "production", "capacity", "capex", s1.alias("s1"), F.lit(1).alias("a1"),
                 c1.alias("c1"))
    x = x.select("*", F.coalesce(F.lag("s1").over(w), F.col("s1")).alias("s0"),
                 F.coalesce(F.lag("a1").over(w), F.lit(1)).alias("a0"),
                 F.coalesce(F.lag("c1").over(w), F.lit(0)).alias("c0"))
    return x.select(
        "file", "T", "plant", "a0", "a1", "s0", "s1", "c0", "c1",
        ((F.col("s0") == 0) & (F.col("s1") == 1)).cast("int").alias("SWITCH"),
        ((F.col("s0") == 1) & (F.col("s1") == 0)).cast("int").alias("LAYOFF"),
        F.lit(0).alias("INITIAL_CAPEX"), (F.col("capex") > 20000).cast("int").alias("STRATEGIC_CAPEX"),
        "production", "capacity", (F.col("capacity") * 0.2).alias("expansion_capacity"),
        (F.col("production") * 0.1).alias("opening"),
        (F.col("production") * 0.1 + F.col("production") - F.col("production") * 0.95).alias("closing"),
        (F.col("production") * 0.95).alias("shipped"), (F.col("capacity") * 0.1).alias("storage"),
        (F.col("capacity") * 0.01).alias("safety"), (F.col("capex") > 30000).cast("int").alias("needs_initial"))


PS_SQL = """
SELECT file, T, plant, a0, a1, s0, s1, c0, c1,
       CAST(s0 = 0 AND s1 = 1 AS INTEGER) AS SWITCH, CAST(s0 = 1 AND s1 = 0 AS INTEGER) AS LAYOFF,
       0 AS INITIAL_CAPEX, CAST(capex > 20000 AS INTEGER) AS STRATEGIC_CAPEX,
       production, capacity, capacity * 0.2 AS expansion_capacity, production * 0.1 AS opening,
       production * 0.1 + production - production * 0.95 AS closing, production * 0.95 AS shipped,
       capacity * 0.1 AS storage, capacity * 0.01 AS safety, CAST(capex > 30000 AS INTEGER) AS needs_initial
FROM (
  SELECT *, coalesce(lag(s1) OVER w, s1) AS s0, coalesce(lag(a1) OVER w, 1) AS a0, coalesce(lag(c1) OVER w, 0) AS c0
  FROM (SELECT file, T, plant, production, capacity, capex, CAST(revenues > costs AS INTEGER) AS s1, 1 AS a1,
               CAST(production > 200 AS INTEGER) AS c1 FROM plan) b
  WINDOW w AS (PARTITION BY file, plant ORDER BY T)) x"""

ALLOWED_SQL = "VALUES " + ", ".join(str(t) for t in AU.ALLOWED_TRANSITIONS)


def _audit_sql(baseline: bool) -> str:
    rules = [
        ("capacity", "production > s1 * (capacity + c1 * expansion_capacity) + 0.001",
         "production - s1 * (capacity + c1 * expansion_capacity)"),
        ("stock_balance", "abs(closing - (opening + production - shipped)) > 0.001",
         "closing - (opening + production - shipped)"),
        ("stock_negative", "closing < -0.001", "closing"),
        ("safety_stock", "closing < safety * s1 - 0.001", "closing - safety * s1"),
        ("storage", "opening > storage + 0.001", "opening - storage"),
        ("stock_continuity", "abs(opening - coalesce(pc, 0.0)) > 0.001", "opening - coalesce(pc, 0.0)"),
        ("state_continuity", "ps IS NOT NULL AND s0 <> ps", "s0 - ps"),
        ("available_continuity", "pa IS NOT NULL AND a0 <> pa", "a0 - pa"),
        ("expansion_continuity", "pcx IS NOT NULL AND c0 <> pcx", "c0 - pcx"),
        ("strategic_capex_flag", "STRATEGIC_CAPEX <> CAST(c0 = 0 AND c1 = 1 AS INTEGER)", "STRATEGIC_CAPEX"),
        ("initial_capex_flag", "INITIAL_CAPEX <> CAST(a0 = 0 AND a1 = 1 AS INTEGER)", "INITIAL_CAPEX"),
        ("switch_flag", "SWITCH <> CAST(s0 = 0 AND s1 = 1 AS INTEGER)", "SWITCH"),
        ("layoff_flag", "LAYOFF <> CAST(s0 = 1 AND s1 = 0 AS INTEGER)", "LAYOFF"),
        ("last_state", "is_last AND s1 <> s0", "s1 - s0"),
    ]
    if baseline:
        rules += [("baseline_expansion", "c1 <> 0", "c1"),
                  ("baseline_unavailable", "needs_initial = 1 AND a1 <> 0", "a1")]
    parts = [f"SELECT file, T, plant, '{n}' AS rule, CAST({a} AS DOUBLE) AS amount FROM pp WHERE {c}"
             for n, c, a in rules]
    parts.append("SELECT file, T, plant, 'transition' AS rule, 1.0 AS amount FROM pp WHERE NOT EXISTS ("
                 "SELECT 1 FROM allowed t WHERE t.a0 = pp.a0 AND t.a1 = pp.a1 AND t.s0 = pp.s0 AND t.s1 = pp.s1 "
                 "AND t.c0 = pp.c0 AND t.c1 = pp.c1)")
    return "\nUNION ALL\n".join(parts)


PP_SQL = ("SELECT *, lag(closing) OVER w AS pc, lag(s1) OVER w AS ps, lag(a1) OVER w AS pa, lag(c1) OVER w AS pcx, "
          "T = max(T) OVER (PARTITION BY file, plant) AS is_last FROM ps WINDOW w AS (PARTITION BY file, plant ORDER BY T)")
VIEWS = dict(ps=PS_SQL, pp=PP_SQL, allowed=f"SELECT * FROM ({ALLOWED_SQL}) t(a0, a1, s0, s1, c0, c1)")


@case("v07_plan_audit", with_views(_audit_sql(False), "plan", extra=VIEWS), rounding=r(4, "amount"))
def v07(fx):
    return AU.audit_plan(plan_state(fx))


@case("v23_baseline_audit", with_views(_audit_sql(True), "plan", extra=VIEWS), rounding=r(4, "amount"))
def v23(fx):
    return AU.audit_plan(plan_state(fx), mode="baseline")


@case("v07_rule_counts",
      with_views("SELECT rule, count(*) AS n FROM (" + _audit_sql(False) + ") a GROUP BY rule", "plan", extra=VIEWS))
def v07c(fx):
    return AU.audit_plan(plan_state(fx)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@case("w10_carried_state",
      with_views("SELECT file, T, plant, opening, closing, coalesce(lag(closing) OVER w, 0.0) AS prev_closing, "
                 "abs(opening - coalesce(lag(closing) OVER w, 0.0)) > 0.001 AS broken FROM ps "
                 "WINDOW w AS (PARTITION BY file, plant ORDER BY T)", "plan", extra=dict(ps=PS_SQL)),
      rounding=r(4, "opening", "closing", "prev_closing"))
def w10(fx):
    ps = plan_state(fx).select("file", "T", "plant", "opening", "closing")
    return carried_state(ps, ["file", "plant"], "T", "closing", "opening")


@case("v07_market_audit",
      with_views("""
SELECT file, T, market, NULL::VARCHAR AS plant, 'market_demand' AS rule, s - d AS amount FROM (
  SELECT file, T, market, sum(sales) AS s, first(demand) AS d FROM j GROUP BY file, T, market) g WHERE s > d + 0.001
UNION ALL
SELECT file, T, market, plant, 'sale_bound' AS rule,
       CASE WHEN sales < 0 THEN sales ELSE sales - demand END AS amount
FROM j WHERE sales < -0.001 OR sales > demand + 0.001""", "plan", extra=dict(
          sales="SELECT file, T, CAST(T % 3 AS VARCHAR) AS market, plant, production AS sales FROM plan",
          dmd="SELECT file, T, market, sum(sales) * 0.8 AS demand FROM sales GROUP BY file, T, market",
          j="SELECT * FROM sales JOIN dmd USING (file, T, market)")), rounding=r(4, "amount"))
def v07m(fx):
    s = fx.plan.select("file", "T", (F.col("T") % 3).cast("string").alias("market"), "plant",
                       F.col("production").alias("sales"))
    d = s.groupBy("file", "T", "market").agg((F.sum("sales") * 0.8).alias("demand"))
    return AU.audit_markets(s, d)
