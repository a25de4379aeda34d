"""Plan audit (V07, V23, W10): list every row of a plan that breaks a planning rule.

The reference states these rules as optimisation constraints; here they
check a finished plan table.  Input ``plan(file, T, plant, a0, a1, s0, s1,
c0, c1, SWITCH, LAYOFF, INITIAL_CAPEX, STRATEGIC_CAPEX, production, capacity,
expansion_capacity, opening, closing, shipped, storage, safety)``.  Output:
one row per breach ``(file, T, plant, rule, amount)``.

All rules are row expressions or windows partitioned by (run, plant), evaluated
in one pass over the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Allowed (a0, a1, s0, s1, c0, c1) transitions of a plant in one period
# (available before/after, operating before/after, expanded before/after).
ALLOWED_TRANSITIONS = (
    (0, 0, 0, 0, 0, 0),
    (0, 1, 0, 0, 0, 0),
    (0, 1, 0, 0, 0, 1),
    (1, 1, 0, 0, 0, 0),
    (1, 1, 0, 1, 0, 0),
    (1, 1, 1, 0, 0, 0),
    (1, 1, 1, 1, 0, 0),
    (1, 1, 0, 0, 0, 1),
    (1, 1, 1, 0, 0, 1),
    (1, 1, 0, 0, 1, 1),
    (1, 1, 0, 1, 1, 1),
    (1, 1, 1, 0, 1, 1),
    (1, 1, 1, 1, 1, 1),
)
STATE_COLS = ("a0", "a1", "s0", "s1", "c0", "c1")
KEYS = ("file", "T", "plant")


def _rule(name: str, cond, amount):
    """The breach of one rule as a struct, NULL where the rule holds."""
    return F.when(cond, F.struct(F.lit(name).alias("rule"), amount.cast("double").alias("amount")))


def audit_plan(plan: DataFrame, tol: float = 1e-3, mode: str = "optimal") -> DataFrame:
    """V07 (+ V23 when ``mode='baseline'``): violation rows of a plant-period plan."""
    col = F.col
    w = Window.partitionBy("file", "plant").orderBy("T")
    last_t = F.max("T").over(Window.partitionBy("file", "plant"))
    p = plan.select("*",
                    F.lag("closing").over(w).alias("_prev_closing"),
                    F.lag("s1").over(w).alias("_prev_s"), F.lag("a1").over(w).alias("_prev_a"),
                    F.lag("c1").over(w).alias("_prev_c"), (col("T") == last_t).alias("_last"))
    bound = col("s1") * (col("capacity") + col("c1") * col("expansion_capacity"))
    balance = col("opening") + col("production") - col("shipped")
    prev_closing = F.coalesce(col("_prev_closing"), F.lit(0.0))  # W10: first period opens at 0
    parts = [
        _rule("capacity", col("production") > bound + tol, col("production") - bound),
        _rule("stock_balance", F.abs(col("closing") - balance) > tol, col("closing") - balance),
        _rule("stock_negative", col("closing") < -tol, col("closing")),
        _rule("safety_stock", col("closing") < col("safety") * col("s1") - tol,
                col("closing") - col("safety") * col("s1")),
        _rule("storage", col("opening") > col("storage") + tol, col("opening") - col("storage")),
        _rule("stock_continuity", F.abs(col("opening") - prev_closing) > tol, col("opening") - prev_closing),
        _rule("state_continuity", col("_prev_s").isNotNull() & (col("s0") != col("_prev_s")),
                col("s0") - col("_prev_s")),
        _rule("available_continuity", col("_prev_a").isNotNull() & (col("a0") != col("_prev_a")),
                col("a0") - col("_prev_a")),
        _rule("expansion_continuity", col("_prev_c").isNotNull() & (col("c0") != col("_prev_c")),
                col("c0") - col("_prev_c")),
        _rule("strategic_capex_flag",
                col("STRATEGIC_CAPEX") != ((col("c0") == 0) & (col("c1") == 1)).cast("int"),
                col("STRATEGIC_CAPEX")),
        _rule("initial_capex_flag",
                col("INITIAL_CAPEX") != ((col("a0") == 0) & (col("a1") == 1)).cast("int"), col("INITIAL_CAPEX")),
        _rule("switch_flag", col("SWITCH") != ((col("s0") == 0) & (col("s1") == 1)).cast("int"), col("SWITCH")),
        _rule("layoff_flag", col("LAYOFF") != ((col("s0") == 1) & (col("s1") == 0)).cast("int"), col("LAYOFF")),
        _rule("last_state", col("_last") & (col("s1") != col("s0")), col("s1") - col("s0")),
    ]
    # the 13 allowed transitions are literals: a row is tested in place
    now = F.struct(*[col(c).cast("int").alias(c) for c in STATE_COLS])
    allowed = [F.struct(*[F.lit(v).alias(c) for c, v in zip(STATE_COLS, t, strict=True)]) for t in ALLOWED_TRANSITIONS]
    known = F.coalesce(F.array_contains(F.array(*allowed), now), F.lit(False))
    parts.append(_rule("transition", ~known, F.lit(1.0)))
    if mode == "baseline":  # V23: do-nothing case
        parts.append(_rule("baseline_expansion", col("c1") != 0, col("c1")))
        parts.append(_rule("baseline_unavailable", (col("needs_initial") == 1) & (col("a1") != 0), col("a1")))
    # one pass: every row carries its breaches, which are then unnested
    found = p.select(*KEYS, F.explode(F.array_compact(F.array(*parts))).alias("b"))
    return found.select(*KEYS, "b.rule", "b.amount")


def audit_markets(sales: DataFrame, demand: DataFrame, tol: float = 1e-3) -> DataFrame:
    """V07 market rules: sales per market within demand; each sale within 0..demand.

    ``sales(file, T, market, plant, sales)``, ``demand(file, T, market, demand)``.
    A sale in a market without a demand row counts against a demand of 0.
    """
    j = sales.join(demand, ["file", "T", "market"], "left").withColumn("demand", F.coalesce("demand", F.lit(0.0)))
    tot = j.groupBy("file", "T", "market").agg(F.sum("sales").alias("_s"), F.first("demand").alias("_d"))
    over = tot.filter(F.col("_s") > F.col("_d") + tol).select(
        "file", "T", "market", F.lit(None).cast("string").alias("plant"), F.lit("market_demand").alias("rule"),
        (F.col("_s") - F.col("_d")).alias("amount"))
    bounds = j.filter((F.col("sales") < -tol) | (F.col("sales") > F.col("demand") + tol)).select(
        "file", "T", "market", "plant", F.lit("sale_bound").alias("rule"),
        F.when(F.col("sales") < 0, F.col("sales")).otherwise(F.col("sales") - F.col("demand")).alias("amount"))
    return over.unionByName(bounds)
