"""Cases for hierarchical reconciliation (R01-R04) on the region > nation > supplier > part hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.cases import case
from quarry.operators import reconcile as RC
from quarry.sources.fixtures import with_views

LEVELS = (["region", "nation", "supplier"], ["region", "nation"], ["region"])
FACTOR = {0: "supplier", 1: "nation", 2: "region"}
SUMS, MEANS = ["qty", "amount"], ["price"]


def detail(fx):
    d = fx.hierarchy_detail
    return d.select("region", "nation", "supplier", "part", "qty", "amount",
                    F.try_divide(F.col("amount"), F.col("qty")).alias("price"))


def totals(fx, i):
    keys = LEVELS[i]
    f = F.lit(1.0) + (F.col(FACTOR[i]) % 7) / 100.0
    return detail(fx).groupBy(*keys).agg((F.sum("qty") * f).alias("qty"), (F.sum("amount") * f).alias("amount"),
                                         (F.avg("price") * f).alias("price"))


def reconciled(fx, ratio="reference"):
    return RC.reconcile(detail(fx), [(LEVELS[i], totals(fx, i)) for i in range(3)], SUMS, MEANS, ratio)


# ------------------------------------------------------------------ SQL twin of the group algebra
def _totals_sql(i: int) -> str:
    k = ", ".join(LEVELS[i])
    f = f"(1.0 + ({FACTOR[i]} % 7) / 100.0)"
    return f"SELECT {k}, sum(qty) * {f} AS qty, sum(amount) * {f} AS amount, avg(price) * {f} AS price FROM det GROUP BY {k}"


def _level_sql(i: int, src: str, ratio: str) -> str:
    keys = LEVELS[i]
    k = ", ".join(keys)
    kk = ", ".join(f"g.{x}" for x in keys)
    ms = SUMS + MEANS
    if i == 0:
        aggs = ", ".join([f"count(*) AS n"] + [f"sum({m}) AS sx_{m}, sum({m}) AS c_{m}, count({m}) AS k_{m}"
                                                for m in ms])
    else:
        aggs = ", ".join(["sum(n) AS n"] + [f"sum(sx_{m}) AS sx_{m}, sum(c_{m}) AS c_{m}, "
                                              f"sum(CASE WHEN c_{m} IS NOT NULL THEN k_{m} END) AS k_{m}" for m in ms])
    outs = []
    for m in ms:
        S = f"(c_{m} / NULLIF(k_{m}, 0))" if m in MEANS else f"coalesce(c_{m}, 0.0)"
        rr = f"coalesce(D_{m} / NULLIF({S}, 0), 1.0)" if ratio == "direct" else f"coalesce({S} / NULLIF(D_{m}, 0), 1.0)"
        ax = f"(sx_{m} / NULLIF(n, 0))" if m in MEANS else f"sx_{m}"
        if m in MEANS and ratio == "direct":
            d = f"(({rr}) * {ax} - D_{m})"
        else:
            d = f"(({rr}) * {ax} - D_{m}) / NULLIF(n, 0)"
        outs.append(f"sx_{m}, ({rr}) * sx_{m} - n * ({d}) AS c_{m}, CASE WHEN ({d}) IS NOT NULL THEN n END AS k_{m}, "
                    f"{rr} AS r_{m}, {d} AS d_{m}")
    dcols = ", ".join(f"t.{m} AS D_{m}" for m in ms)
    on = " AND ".join(f"g.{x} = t.{x}" for x in keys)
    return (f"SELECT {k}, n, {', '.join(outs)} FROM (SELECT {kk}, g.n, "
            + ", ".join(f"g.sx_{m}, g.c_{m}, g.k_{m}" for m in ms) + f", {dcols} FROM "
            f"(SELECT {k}, {aggs} FROM {src} GROUP BY {k}) g LEFT JOIN tot{i} t ON {on}) x")


def _views(ratio: str) -> dict:
    v = {"det": "SELECT region, nation, supplier, part, qty, amount, amount / NULLIF(qty, 0) AS price "
                "FROM hierarchy_detail"}
    for i in range(3):
        v[f"tot{i}"] = _totals_sql(i)
    v["g0"] = _level_sql(0, "det", ratio)
    v["g1"] = _level_sql(1, "g0", ratio)
    v["g2"] = _level_sql(2, "g1", ratio)
    return v


FINAL = ("SELECT d.region, d.nation, d.supplier, d.part, d.qty * g.r_qty - g.d_qty AS qty, "
         "d.amount * g.r_amount - g.d_amount AS amount, d.price * g.r_price - g.d_price AS price "
         "FROM det d LEFT JOIN g2 g USING (region)")


@case("r01_reconcile", with_views(FINAL, "hierarchy_detail", extra=_views("reference")),
      rounding={"qty": 6, "amount": 3, "price": 3})
def r01(fx):
    return reconciled(fx)


@case("r01_reconcile_direct", with_views(FINAL, "hierarchy_detail", extra=_views("direct")),
      rounding={"qty": 6, "amount": 3, "price": 3})
def r01d(fx):
    return reconciled(fx, "direct")


@case("r03_closing_check",
      with_views("SELECT a.region, a.reconciled, t.qty AS published, abs(a.reconciled / NULLIF(t.qty, 0) - 1) < 0.01 "
                 "AS ok FROM (SELECT region, sum(qty) AS reconciled FROM (" + FINAL + ") f GROUP BY region) a "
                 "JOIN tot2 t USING (region)", "hierarchy_detail", extra=_views("reference")),
      rounding={"reconciled": 4, "published": 4})
def r03(fx):
    return RC.closing_check(reconciled(fx), totals(fx, 2), ["region"], "qty")


R02_ROWS = ("SELECT region, nation, supplier, qty, amount, false AS is_total FROM (SELECT region, nation, supplier, "
            "sum(qty) AS qty, sum(amount) AS amount FROM det GROUP BY 1, 2, 3) a UNION ALL "
            "SELECT region, nation, NULL, qty, amount, true FROM tot1")


@case("r02_ratio_normalise",
      with_views("SELECT x.region, x.nation, x.supplier, x.qty * R_qty AS qty, x.amount * R_amount AS amount "
                 "FROM rows x LEFT JOIN (SELECT region, nation, sum(CASE WHEN is_total THEN qty END) / "
                 "NULLIF(sum(CASE WHEN NOT is_total THEN qty END), 0) AS R_qty, sum(CASE WHEN is_total THEN amount END)"
                 " / NULLIF(sum(CASE WHEN NOT is_total THEN amount END), 0) AS R_amount FROM rows GROUP BY 1, 2) g "
                 "USING (region, nation) WHERE NOT x.is_total", "hierarchy_detail",
                 extra={**_views("reference"), "rows": R02_ROWS}),
      rounding={"qty": 6, "amount": 4})
def r02(fx):
    d = detail(fx).groupBy("region", "nation", "supplier").agg(F.sum("qty").alias("qty"),
                                                               F.sum("amount").alias("amount"))
    rows = d.withColumn("is_total", F.lit(False)).unionByName(
        totals(fx, 1).select("region", "nation", F.lit(None).cast("long").alias("supplier"), "qty", "amount",
                             F.lit(True).alias("is_total")))
    return RC.ratio_normalise(rows, ["region", "nation"], ["qty", "amount"])


@case("r04_attach_names",
      with_views("SELECT f.region, f.nation, f.supplier, f.part, coalesce(n.n_name, 'N/A') AS n_name FROM ("
                 + FINAL + ") f LEFT JOIN (SELECT n_nationkey AS nation, max(n_name) AS n_name FROM nation "
                 "WHERE n_regionkey <> 4 GROUP BY 1) n USING (nation)", "hierarchy_detail", extra=_views("reference")))
def r04(fx):
    names = fx.table("nation").filter(F.col("n_regionkey") != 4).select(F.col("n_nationkey").alias("nation"), "n_name")
    return RC.attach_names(reconciled(fx).select("region", "nation", "supplier", "part"), names, ["nation"], "n_name")


R02_L2 = ("SELECT region, nation, qty, amount, false AS is_total FROM (SELECT region, nation, sum(qty) AS qty, "
          "sum(amount) AS amount FROM l1 GROUP BY 1, 2) a UNION ALL SELECT region, NULL, qty, amount, true FROM tot2")
L1_SQL = ("SELECT x.region, x.nation, x.supplier, x.qty * R_qty AS qty, x.amount * R_amount AS amount "
          "FROM rows x LEFT JOIN (SELECT region, nation, sum(CASE WHEN is_total THEN qty END) / "
          "NULLIF(sum(CASE WHEN NOT is_total THEN qty END), 0) AS R_qty, sum(CASE WHEN is_total THEN amount END)"
          " / NULLIF(sum(CASE WHEN NOT is_total THEN amount END), 0) AS R_amount FROM rows GROUP BY 1, 2) g "
          "USING (region, nation) WHERE NOT x.is_total")


@case("r02_ratio_normalise_two_levels",
      with_views("SELECT x.region, x.nation, x.qty * R_qty AS qty, x.amount * R_amount AS amount "
                 "FROM rows2 x LEFT JOIN (SELECT region, sum(CASE WHEN is_total THEN qty END) / "
                 "NULLIF(sum(CASE WHEN NOT is_total THEN qty END), 0) AS R_qty, sum(CASE WHEN is_total THEN amount END)"
                 " / NULLIF(sum(CASE WHEN NOT is_total THEN amount END), 0) AS R_amount FROM rows2 GROUP BY 1) g "
                 "USING (region) WHERE NOT x.is_total", "hierarchy_detail",
                 extra={**_views("reference"), "rows": R02_ROWS, "l1": L1_SQL, "rows2": R02_L2}),
      rounding={"qty": 4, "amount": 2})
def r02b(fx):
    """Suppliers normalised to nation totals, then nations (their sums) to region totals."""
    l1 = r02(fx)
    agg = l1.groupBy("region", "nation").agg(F.sum("qty").alias("qty"), F.sum("amount").alias("amount"))
    rows = agg.withColumn("is_total", F.lit(False)).unionByName(
        totals(fx, 2).select("region", F.lit(None).cast("int").alias("nation"), "qty", "amount",
                             F.lit(True).alias("is_total")))
    return RC.ratio_normalise(rows, ["region"], ["qty", "amount"])
