"""Derived tables built from the driver's parquet tables (FIXTURES.md §4).

Each view exists twice: as a Spark DataFrame (``Fixtures``) and as DuckDB
SQL text (``VIEW_SQL``) used only by the oracle queries.  The Spark side is
written for scale: fact tables are aggregated on their join key before they
meet a dimension, dimensions are broadcast only behind a size check, and
every scan reads the columns it needs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.exprs import safe_div
from quarry.session import broadcast_if_small, cut_lineage, table_path, tune_optimizer

BASE_YEAR = 1995  # plan period 0 (FIXTURES §4 `plan`)


class Fixtures:
    """Lazily built views over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.materialize = materialize
        tune_optimizer(spark)

    def _shared(self, df: DataFrame) -> DataFrame:
        """A view built on the big line-item x order join is read by several branches of
        one plan with different filters (run, period, plant name); Catalyst pushes each
        branch's filters into its own copy, so the copies are not reused and the join
        would run once per branch.  It is written once to the shared checkpoint folder
        (reliable ``checkpoint()``) and read back by every branch.  Views read by a
        single branch, or by identical ones (exchange reuse), are left lazy."""
        return cut_lineage(df) if self.materialize else df

    def memo(self, key: str, build):
        """One DataFrame object per derived view and fixture set, so a plan that
        uses a view twice holds one subtree (exchange reuse, less planning)."""
        cache = self.__dict__.setdefault("_memo", {})
        if key not in cache:
            cache[key] = build()
        return cache[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(table_path(self.sf_dir, name))

    # ------------------------------------------------------------ dims
    @cached_property
    def supplier_dim(self) -> DataFrame:
        """supplier + nation names: one row per supplier."""
        nat = self.table("nation").select("n_nationkey", "n_name", "n_regionkey")
        sup = self.table("supplier").select("s_suppkey", "s_name", "s_nationkey")
        return sup.join(broadcast_if_small(nat), sup.s_nationkey == nat.n_nationkey)

    # ------------------------------------------------------------ panel
    @cached_property
    def panel(self) -> DataFrame:
        """(state, mun, date, price, litres): daily volume-weighted price per location.

        lineitem is reduced to one row per (supplier, day) before the join, so the
        join input is bounded by suppliers x days, not by line items.
        """
        li = self.table("lineitem").select(
            "l_suppkey", F.col("l_shipdate").cast("date").alias("date"),
            "l_quantity", "l_extendedprice")
        daily = li.groupBy("l_suppkey", "date").agg(
            F.sum("l_quantity").alias("litres"), F.sum("l_extendedprice").alias("revenue"))
        dim = broadcast_if_small(self.supplier_dim.select("s_suppkey", "s_name", "n_name"))
        return daily.join(dim, daily.l_suppkey == dim.s_suppkey).select(
            F.col("n_name").alias("state"), F.col("s_name").alias("mun"), "date",
            safe_div("revenue", "litres").alias("price"), "litres")

    # ------------------------------------------------------------ population
    @cached_property
    def population(self) -> DataFrame:
        cust = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
        k = F.col("c_custkey")
        g = cust.groupBy("c_nationkey", "c_mktsegment").agg(
            F.count(F.lit(1)).cast("double").alias("pop"),
            F.sum(F.when(F.col("c_acctbal") > 0, 1).otherwise(0)).cast("double").alias("hab_houses"),
            F.sum("c_acctbal").alias("cars"),
            F.avg(((k * 37) % 180 - 90).cast("double")).alias("lat"),
            F.avg(((k * 73) % 360 - 180).cast("double")).alias("lon"))
        nat = broadcast_if_small(self.table("nation").select("n_nationkey", "n_name"))
        return g.join(nat, g.c_nationkey == nat.n_nationkey).select(
            F.col("n_name").alias("state"), F.col("c_mktsegment").alias("mun"),
            "pop", "hab_houses", "cars", "lat", "lon")

    # ------------------------------------------------------------ product prices
    @cached_property
    def price_base(self) -> DataFrame:
        """(flag, state, date, q, e): line items reduced to flag x supplier x day, then named."""
        li = self.table("lineitem").select(
            F.col("l_returnflag").alias("flag"), "l_suppkey", F.col("l_shipdate").cast("date").alias("date"),
            "l_quantity", "l_extendedprice")
        g = li.groupBy("flag", "l_suppkey", "date").agg(
            F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("e"))
        dim = broadcast_if_small(self.supplier_dim.select("s_suppkey", "n_name"))
        return g.join(dim, g.l_suppkey == dim.s_suppkey).select(
            "flag", F.col("n_name").alias("state"), "date", "q", "e")

    @cached_property
    def price_days(self) -> DataFrame:
        """(flag, l_suppkey, date, q, e): line items reduced to flag x supplier x day (no join yet)."""
        li = self.table("lineitem").select(
            F.col("l_returnflag").alias("flag"), "l_suppkey", F.col("l_shipdate").cast("date").alias("date"),
            "l_quantity", "l_extendedprice")
        return li.groupBy("flag", "l_suppkey", "date").agg(
            F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("e"))

    def product_prices(self, flag: str | None = None):
        """Price sheets (state_month, national_month, national_daily) of one product, or of all
        products at once (with a ``flag`` column) when ``flag`` is None.

        The national sheets need no location, so they are rolled up from the
        flag x supplier x day sums without any join; the state sheet is first
        reduced to supplier x month (about 30x fewer rows) and only then joined
        to the supplier -> state dimension.
        """
        b = self.price_days if flag is None else self.price_days.filter(F.col("flag") == flag)
        k = ["flag"] if flag is None else []
        px = safe_div(F.sum("e"), F.sum("q")).alias("price")
        day = b.groupBy(*k, "date").agg(F.sum("e").alias("e"), F.sum("q").alias("q"))
        nd = day.select(*k, "date", safe_div(F.col("e"), F.col("q")).alias("price"))
        nm = day.groupBy(*k, F.year("date").alias("year"), F.month("date").alias("month")).agg(px)
        month = b.groupBy(*k, "l_suppkey", F.year("date").alias("year"), F.month("date").alias("month")).agg(
            F.sum("e").alias("e"), F.sum("q").alias("q"))
        dim = broadcast_if_small(self.supplier_dim.select("s_suppkey", F.col("n_name").alias("state")))
        sm = (month.join(dim, month.l_suppkey == dim.s_suppkey)
              .groupBy(*k, "state", "year", "month").agg(px))
        return sm, nm, nd

    # ------------------------------------------------------------ demand
    @cached_property
    def demand(self) -> DataFrame:
        """(state, year, volume) with the states of nationkey % 5 = 0 left empty."""
        o = self.table("orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice")
        cust = broadcast_if_small(self.table("customer").select("c_custkey", "c_nationkey"))
        g = (o.join(cust, o.o_custkey == cust.c_custkey)
             .groupBy("c_nationkey", "year").agg(F.sum("o_totalprice").alias("volume")))
        nat = broadcast_if_small(self.table("nation").select("n_nationkey", "n_name"))
        return g.join(nat, g.c_nationkey == nat.n_nationkey).select(
            F.col("n_name").alias("state"), F.col("year").cast("int").alias("year"),
            F.when(F.col("n_nationkey") % 5 == 0, F.lit(None).cast("double"))
             .otherwise(F.col("volume")).alias("volume"))

    # ------------------------------------------------------------ periods
    @cached_property
    def periods(self) -> DataFrame:
        """(T, date, days): one row per order year; small by construction."""
        y = self.table("orders").select(F.year("o_orderdate").alias("y")).distinct()
        return y.select(
            (F.col("y") - BASE_YEAR).cast("int").alias("T"),
            F.col("y").cast("int").alias("date"),
            F.datediff(F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)),
                       F.make_date("y", F.lit(1), F.lit(1))).cast("int").alias("days"))

    # ------------------------------------------------------------ coords
    @cached_property
    def coords(self) -> DataFrame:
        """(state, name, lat, lon) per supplier."""
        return self.supplier_dim.select(
            F.col("n_name").alias("state"), F.col("s_name").alias("name"),
            ((F.col("s_suppkey") * 37) % 180 - 90).cast("double").alias("lat"),
            ((F.col("s_suppkey") * 73) % 360 - 180).cast("double").alias("lon"))

    # ------------------------------------------------------------ plan
    @cached_property
    def plan(self) -> DataFrame:
        """Scenario result table (file, T, plant, ...), one row per priority x year x supplier.

        lineitem x orders is the one large join (both sides grow with the data):
        a shuffle join on the order key; everything after it is aggregated
        map-side before the small supplier dimension is attached.
        """
        li = self.table("lineitem").select(
            "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
        o = self.table("orders").select(
            "o_orderkey", F.col("o_orderpriority").alias("file"),
            (F.year("o_orderdate") - BASE_YEAR).cast("int").alias("T"))
        g = (li.join(o, li.l_orderkey == o.o_orderkey)
             .groupBy("file", "T", "l_suppkey").agg(
                 F.sum("l_extendedprice").alias("revenues"),
                 F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("base_cost"),
                 F.sum("l_tax").alias("tax"),
                 F.sum("l_quantity").alias("qty"),
                 F.count(F.lit(1)).alias("lines")))
        sup = broadcast_if_small(self.table("supplier").select("s_suppkey", "s_name"))
        j = g.join(sup, g.l_suppkey == sup.s_suppkey)
        mult = F.when(F.col("s_suppkey") % 10 == 0, F.lit(1.2)).otherwise(F.lit(0.6))
        costs = F.col("base_cost") * mult
        dep = F.col("tax") * 1000
        capex = F.col("qty") * 100
        ebitda = F.col("revenues") - costs
        nopat = (ebitda - dep) * 0.65
        return self._shared(j.select(
            "file", "T", F.col("s_name").alias("plant"),
            F.lit(1.0).alias("state"),
            F.col("qty").alias("production"),
            (F.col("lines") * 30).cast("double").alias("capacity"),
            capex.alias("capex"), costs.alias("costs"), F.col("revenues"),
            ebitda.alias("ebitda"), dep.alias("depreciation"), nopat.alias("nopat"),
            (nopat + dep - capex).alias("fcf_wo_nwc")))

    # ------------------------------------------------------------ hierarchy
    @cached_property
    def hierarchy_detail(self) -> DataFrame:
        """Detail rows (region, nation, supplier, part) with two measures."""
        li = self.table("lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
        g = li.groupBy("l_suppkey", "l_partkey").agg(
            F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("amount"))
        dim = broadcast_if_small(self.supplier_dim.select("s_suppkey", "s_nationkey", "n_regionkey"))
        return g.join(dim, g.l_suppkey == dim.s_suppkey).select(
            F.col("n_regionkey").alias("region"), F.col("s_nationkey").alias("nation"),
            F.col("s_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), "qty", "amount")

    # ------------------------------------------------------------ text fixtures
    @cached_property
    def sentinel_text(self) -> DataFrame:
        p = self.table("part").select("p_partkey", "p_size", "p_brand", "p_type")
        return p.select(
            "p_partkey",
            F.when(F.col("p_partkey") % 11 == 0, F.lit("*"))
             .when(F.col("p_partkey") % 13 == 0, F.lit("N/D"))
             .otherwise(F.col("p_size").cast("string")).alias("size_text"),
            F.when(F.col("p_partkey") % 17 == 0, F.lit(None).cast("string"))
             .when(F.col("p_partkey") % 19 == 0, F.lit("*"))
             .otherwise(F.col("p_brand")).alias("label"),
            "p_type")

    @cached_property
    def codes(self) -> DataFrame:
        """Classification codes and staff-size band texts from ``part``."""
        p = self.table("part").select("p_partkey", "p_type", "p_brand", "p_size")
        lo = (F.floor((F.col("p_size") - 1) / 10) * 10 + 1).cast("int")
        band = F.when(F.col("p_size") > 40, F.concat(lo.cast("string"), F.lit(" and more people"))) \
            .otherwise(F.concat(lo.cast("string"), F.lit(" - "), (lo + 9).cast("string"), F.lit(" people")))
        return p.select(
            "p_partkey",
            F.upper(F.concat(F.substring("p_type", 1, 3), F.regexp_replace("p_brand", "[^0-9]", ""),
                             F.lit("00"))).alias("code"),
            band.alias("size_band"))

    @cached_property
    def logs(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_custkey")
        txt = F.when(F.col("o_orderkey") % 7 == 0, F.lit("no gap reported")).otherwise(
            F.concat(F.lit("gap "), (F.col("o_custkey") % 97).cast("string"), F.lit("."),
                     (F.col("o_orderkey") % 10).cast("string"), F.lit("% then gap "),
                     (F.col("o_orderkey") % 13).cast("string"), F.lit(".5%")))
        return o.select(F.col("o_orderkey").alias("doc_id"), txt.alias("text"))

    @cached_property
    def series(self) -> DataFrame:
        e = self.table("events").select("user_id", "event_type", "ts", "value")
        return e.select(F.col("user_id").alias("entity"), "event_type", "ts", F.col("value").alias("x"))


    # ------------------------------------------------------------ census-like blocks
    @cached_property
    def census_blocks(self) -> DataFrame:
        """Census block table shaped like national census block files, one block per customer.

        Codes: ENTIDAD = nation + 1, MUN / LOC / AGEB / MZA from the customer key
        (MZA 0 and AGEB '0000' mark total rows); measures are text derived from
        the account balance, with '*' and 'N/D' sentinels.
        """
        cust = self.table("customer").select("c_custkey", "c_nationkey", "c_acctbal")
        nat = broadcast_if_small(self.table("nation").select("n_nationkey", "n_name"))
        j = cust.join(nat, cust.c_nationkey == nat.n_nationkey)
        k, b = F.col("c_custkey"), F.abs(F.col("c_acctbal"))
        mun = (k % 4 + 1).cast("int")
        loc = (k % 5 + 1).cast("int")

        def txt(e):
            return (F.when(k % 23 == 0, F.lit("*")).when(k % 29 == 0, F.lit("N/D"))
                    .otherwise(e.cast("string")))
        fl = lambda e: F.floor(e).cast("bigint")
        measures = {name: txt(e) for name, e in CENSUS_MEASURES(k, b, fl).items()}
        return j.select(
            F.col("n_name").alias("NOM_ENT"), (F.col("c_nationkey") + 1).cast("int").alias("ENTIDAD"),
            F.concat(F.col("n_name"), F.lit(" M"), mun.cast("string")).alias("NOM_MUN"), mun.alias("MUN"),
            F.concat(F.lit("L"), loc.cast("string")).alias("NOM_LOC"), loc.alias("LOC"),
            F.lpad((k % 6).cast("string"), 4, "0").alias("AGEB"), (k % 9).cast("int").alias("MZA"),
            *[v.alias(n) for n, v in measures.items()])

    @cached_property
    def economic_census(self) -> DataFrame:
        """Economic census rows (ENTIDAD, MUNICIPIO, CODIGO, ID_ESTRATO, 12 measures) from line items.

        Line items are reduced per (supplier, part, line number) before the
        part dimension is attached; strata come from the line number (blank,
        99, missing or a number).
        """
        li = self.table("lineitem").select(
            "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus")
        part = self.codes.select("p_partkey", "code")
        j = li.join(broadcast_if_small(part), li.l_partkey == part.p_partkey)
        ln = F.col("l_linenumber")
        strat = (F.when(ln == 1, F.lit("")).when(ln == 2, F.lit("99")).when(ln == 3, F.lit(None).cast("string"))
                 .otherwise(ln.cast("string")))
        g = j.groupBy(
            ((F.col("l_suppkey") % 25) + 1).cast("string").alias("ENTIDAD"),
            (F.col("l_suppkey") % 4 + 1).cast("string").alias("MUNICIPIO"),
            F.col("code").alias("CODIGO"), strat.alias("ID_ESTRATO")).agg(*_eco_aggs())
        return g

    @cached_property
    def activity_catalogue(self) -> DataFrame:
        """(CODIGO, DESC_CODIGO, CLASIFICADOR_CODIGO): one row per code."""
        p = self.table("part").select("p_partkey", "p_type", "p_brand")
        c = self.codes.select("p_partkey", "code").join(p, "p_partkey")
        b = F.regexp_replace("p_brand", "[^0-9]", "").cast("int")
        cls = F.when(b <= 10, F.lit("Rama")).when(b <= 20, F.lit("Subrama")).otherwise(F.lit("Sector"))
        return c.select(F.col("code").alias("CODIGO"), F.col("p_type").alias("DESC_CODIGO"),
                        cls.alias("CLASIFICADOR_CODIGO")).distinct()

    @cached_property
    def census_coords(self) -> DataFrame:
        """Block coordinates for the census table (state_key, mun_key as text)."""
        cust = self.table("customer").select("c_custkey", "c_nationkey")
        k = F.col("c_custkey")
        return cust.select(
            (F.col("c_nationkey") + 1).cast("string").alias("state_key"),
            (k % 4 + 1).cast("string").alias("mun_key"),
            ((k * 37) % 180 - 90).cast("double").alias("lat"),
            ((k * 73) % 360 - 180).cast("double").alias("lon"))


# Economic census measures (codes of the 12 economy columns).
ECO_MEASURES = ("A111A", "A121A", "A131A", "A211A", "A221A", "A511A", "A700A", "A800A",
                "H000A", "H000B", "H000C", "H000D")


def _eco_aggs():
    col = F.col
    flag = lambda c, v: F.sum(F.when(col(c) == v, 1).otherwise(0)).cast("double")
    return [F.sum("l_extendedprice").alias("A111A"), F.sum("l_quantity").alias("A121A"),
            (F.sum("l_discount") * 100).alias("A131A"), (F.sum("l_tax") * 100).alias("A211A"),
            F.count(F.lit(1)).cast("double").alias("A221A"),
            F.sum(col("l_extendedprice") * (1 - col("l_discount"))).alias("A511A"),
            F.max("l_quantity").alias("A700A"), F.min("l_quantity").alias("A800A"),
            flag("l_returnflag", "A").alias("H000A"), flag("l_returnflag", "N").alias("H000B"),
            flag("l_returnflag", "R").alias("H000C"), flag("l_linestatus", "O").alias("H000D")]


# Census measure spec: (name, op, factor) applied to the balance magnitude b;
# GRAPROES / PROM_OCUP are rate-type measures from the key.
CENSUS_SPEC = (
    ("POB15_64", "*", 0.65), ("POB65_MAS", "*", 0.08), ("GRAPROES", "k5", 8), ("PROM_OCUP", "k3", 3),
    ("VIVPARH_CV", "/", 3.6), ("POBTOT", "*", 1.0), ("P_18YMAS", "*", 0.7), ("P_60YMAS", "*", 0.1),
    ("PDER_SS", "*", 0.5), ("TVIVPARHAB", "/", 3.5), ("VPH_C_SERV", "/", 4.0), ("VPH_S_ELEC", "/", 100.0),
    ("VPH_AGUAFV", "/", 50.0), ("VPH_NODREN", "/", 60.0), ("VPH_INTER", "/", 6.0), ("VPH_PISOTI", "/", 70.0),
    ("VPH_AUTOM", "/", 5.0),
)


def CENSUS_MEASURES(k, b, fl):
    out = {}
    for name, op, f in CENSUS_SPEC:
        if op == "*":
            out[name] = fl(b * f) if not isinstance(b, str) else fl(f"{b} * {f}")
        elif op == "/":
            out[name] = fl(b / f) if not isinstance(b, str) else fl(f"{b} / {f}")
        elif op == "k5":
            out[name] = (k % 5 + f) if not isinstance(k, str) else f"({k} % 5 + {f})"
        else:
            out[name] = (k % 3 + f) if not isinstance(k, str) else f"({k} % 3 + {f})"
    return out


CENSUS_SHORT = [n for n, _, _ in CENSUS_SPEC]


# --------------------------------------------------------------------------
# DuckDB text of the same views (oracle side only).
VIEW_SQL: dict[str, str] = {
    "panel": """
SELECT n.n_name AS state, s.s_name AS mun, CAST(l.l_shipdate AS DATE) AS date,
       sum(l.l_extendedprice) / NULLIF(sum(l.l_quantity), 0) AS price,
       sum(l.l_quantity) AS litres
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
GROUP BY 1, 2, 3""",
    "population": """
SELECT n.n_name AS state, c.c_mktsegment AS mun, CAST(count(*) AS DOUBLE) AS pop,
       CAST(sum(CASE WHEN c.c_acctbal > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS hab_houses,
       sum(c.c_acctbal) AS cars,
       avg(CAST((c.c_custkey * 37) % 180 - 90 AS DOUBLE)) AS lat,
       avg(CAST((c.c_custkey * 73) % 360 - 180 AS DOUBLE)) AS lon
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY 1, 2""",
    "price_base": """
SELECT l.l_returnflag AS flag, n.n_name AS state, CAST(l.l_shipdate AS DATE) AS date,
       sum(l.l_quantity) AS q, sum(l.l_extendedprice) AS e
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
GROUP BY 1, 2, 3""",
    "demand": """
SELECT n.n_name AS state, CAST(year(o.o_orderdate) AS INTEGER) AS year,
       CASE WHEN n.n_nationkey % 5 = 0 THEN NULL ELSE sum(o.o_totalprice) END AS volume
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name, n.n_nationkey, year(o.o_orderdate)""",
    "periods": f"""
SELECT CAST(y - {BASE_YEAR} AS INTEGER) AS T, CAST(y AS INTEGER) AS date,
       CAST(make_date(CAST(y AS INTEGER) + 1, 1, 1) - make_date(CAST(y AS INTEGER), 1, 1) AS INTEGER) AS days
FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)""",
    "coords": """
SELECT n.n_name AS state, s.s_name AS name,
       CAST((s.s_suppkey * 37) % 180 - 90 AS DOUBLE) AS lat,
       CAST((s.s_suppkey * 73) % 360 - 180 AS DOUBLE) AS lon
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "plan": f"""
SELECT file, T, plant, CAST(1.0 AS DOUBLE) AS state, qty AS production, CAST(lines * 30 AS DOUBLE) AS capacity,
       qty * 100 AS capex, costs, revenues, revenues - costs AS ebitda, tax * 1000 AS depreciation,
       (revenues - costs - tax * 1000) * 0.65 AS nopat,
       (revenues - costs - tax * 1000) * 0.65 + tax * 1000 - qty * 100 AS fcf_wo_nwc
FROM (
  SELECT o.o_orderpriority AS file, CAST(year(o.o_orderdate) - {BASE_YEAR} AS INTEGER) AS T,
         s.s_name AS plant, sum(l.l_extendedprice) AS revenues,
         sum(l.l_extendedprice * (1 - l.l_discount))
           * CASE WHEN s.s_suppkey % 10 = 0 THEN 1.2 ELSE 0.6 END AS costs,
         sum(l.l_tax) AS tax, sum(l.l_quantity) AS qty, count(*) AS lines
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  GROUP BY o.o_orderpriority, year(o.o_orderdate), s.s_name, s.s_suppkey)""",
    "hierarchy_detail": """
SELECT n.n_regionkey AS region, s.s_nationkey AS nation, s.s_suppkey AS supplier, l.l_partkey AS part,
       sum(l.l_quantity) AS qty, sum(l.l_extendedprice) AS amount
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
GROUP BY 1, 2, 3, 4""",
    "sentinel_text": """
SELECT p_partkey,
       CASE WHEN p_partkey % 11 = 0 THEN '*' WHEN p_partkey % 13 = 0 THEN 'N/D'
            ELSE CAST(p_size AS VARCHAR) END AS size_text,
       CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN '*' ELSE p_brand END AS label,
       p_type
FROM part""",
    "codes": """
SELECT p_partkey,
       upper(substr(p_type, 1, 3) || regexp_replace(p_brand, '[^0-9]', '', 'g') || '00') AS code,
       CASE WHEN p_size > 40
            THEN CAST(CAST(floor((p_size - 1) / 10) * 10 + 1 AS INTEGER) AS VARCHAR) || ' and more people'
            ELSE CAST(CAST(floor((p_size - 1) / 10) * 10 + 1 AS INTEGER) AS VARCHAR) || ' - '
                 || CAST(CAST(floor((p_size - 1) / 10) * 10 + 10 AS INTEGER) AS VARCHAR) || ' people' END AS size_band
FROM part""",
    "logs": """
SELECT o_orderkey AS doc_id,
       CASE WHEN o_orderkey % 7 = 0 THEN 'no gap reported'
            ELSE 'gap ' || CAST(o_custkey % 97 AS VARCHAR) || '.' || CAST(o_orderkey % 10 AS VARCHAR)
                 || '% then gap ' || CAST(o_orderkey % 13 AS VARCHAR) || '.5%' END AS text
FROM orders""",
    "census_blocks": None,  # filled below
    "series": """
SELECT user_id AS entity, event_type, ts, value AS x FROM events""",
}


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs it needs (in dependency order)."""
    parts = [f"{n} AS ({VIEW_SQL[n]})" for n in names]
    for n, body in (extra or {}).items():
        parts.append(f"{n} AS ({body})")
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql


def _census_sql() -> str:
    def fl(e):
        return f"CAST(floor({e}) AS BIGINT)"
    k, b = "c.c_custkey", "abs(c.c_acctbal)"
    ms = CENSUS_MEASURES(k, b, fl)
    meas = ",\n       ".join(
        f"CASE WHEN {k} % 23 = 0 THEN '*' WHEN {k} % 29 = 0 THEN 'N/D' ELSE CAST({v} AS VARCHAR) END AS {n}"
        for n, v in ms.items())
    return f"""
SELECT n.n_name AS NOM_ENT, CAST(c.c_nationkey + 1 AS INTEGER) AS ENTIDAD,
       n.n_name || ' M' || CAST({k} % 4 + 1 AS VARCHAR) AS NOM_MUN, CAST({k} % 4 + 1 AS INTEGER) AS MUN,
       'L' || CAST({k} % 5 + 1 AS VARCHAR) AS NOM_LOC, CAST({k} % 5 + 1 AS INTEGER) AS LOC,
       lpad(CAST({k} % 6 AS VARCHAR), 4, '0') AS AGEB, CAST({k} % 9 AS INTEGER) AS MZA,
       {meas}
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"""


VIEW_SQL["census_blocks"] = _census_sql()
VIEW_SQL["census_coords"] = """
SELECT CAST(c_nationkey + 1 AS VARCHAR) AS state_key, CAST(c_custkey % 4 + 1 AS VARCHAR) AS mun_key,
       CAST((c_custkey * 37) % 180 - 90 AS DOUBLE) AS lat, CAST((c_custkey * 73) % 360 - 180 AS DOUBLE) AS lon
FROM customer"""


VIEW_SQL["economic_census"] = """
SELECT CAST(l.l_suppkey % 25 + 1 AS VARCHAR) AS ENTIDAD, CAST(l.l_suppkey % 4 + 1 AS VARCHAR) AS MUNICIPIO,
       c.code AS CODIGO,
       CASE WHEN l.l_linenumber = 1 THEN '' WHEN l.l_linenumber = 2 THEN '99' WHEN l.l_linenumber = 3 THEN NULL
            ELSE CAST(l.l_linenumber AS VARCHAR) END AS ID_ESTRATO,
       sum(l_extendedprice) AS A111A, sum(l_quantity) AS A121A, sum(l_discount) * 100 AS A131A,
       sum(l_tax) * 100 AS A211A, CAST(count(*) AS DOUBLE) AS A221A,
       sum(l_extendedprice * (1 - l_discount)) AS A511A, max(l_quantity) AS A700A, min(l_quantity) AS A800A,
       CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS DOUBLE) AS H000A,
       CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS DOUBLE) AS H000B,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS H000C,
       CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) AS H000D
FROM lineitem l JOIN codes c ON l.l_partkey = c.p_partkey
GROUP BY 1, 2, 3, 4"""
VIEW_SQL["activity_catalogue"] = """
SELECT DISTINCT c.code AS CODIGO, p.p_type AS DESC_CODIGO,
       CASE WHEN CAST(regexp_replace(p.p_brand, '[^0-9]', '', 'g') AS INTEGER) <= 10 THEN 'Rama'
            WHEN CAST(regexp_replace(p.p_brand, '[^0-9]', '', 'g') AS INTEGER) <= 20 THEN 'Subrama'
            ELSE 'Sector' END AS CLASIFICADOR_CODIGO
FROM codes c JOIN part p USING (p_partkey)"""
