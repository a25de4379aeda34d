"""Cases for sources and sinks (S01-S09, S11, S12) and V20.

Each case writes a driver table (or a view of it) in the file layout the
reference reads, into a fresh folder under the shared checkpoint directory,
reads it back with the operator under test and is compared with the source
table by the oracle.
"""

from __future__ import annotations

import os
import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.cases import case, r
from quarry.cases.c_clean import CAT_SQL
from quarry.operators import clean as C
from quarry.operators.reshape import wide_to_long
from quarry.plans import census as CE
from quarry.sources import readers as RD
from quarry.sources.fixtures import CENSUS_SHORT, ECO_MEASURES, with_views

KEYS = ["NOM_ENT", "ENTIDAD", "NOM_MUN", "MUN", "NOM_LOC", "LOC", "AGEB", "MZA"]


# ------------------------------------------------------------------ S01
@case("s01_census_csv", with_views("SELECT * FROM census_blocks", "census_blocks"))
def s01(fx):
    path = RD.scratch_path(fx.spark, "census")
    fx.census_blocks.write.option("header", True).csv(path)
    return RD.read_census(fx.spark, path, CENSUS_SHORT)


@case("s01_census_csv_short",
      with_views("SELECT NOM_ENT, ENTIDAD, MUN, POBTOT, VPH_AUTOM FROM census_blocks", "census_blocks"))
def s01s(fx):
    path = RD.scratch_path(fx.spark, "census")
    fx.census_blocks.write.option("header", True).csv(path)
    return RD.read_census(fx.spark, path, CENSUS_SHORT, keep=["NOM_ENT", "ENTIDAD", "MUN", "POBTOT", "VPH_AUTOM"])


# ------------------------------------------------------------------ S02
COORD_SCHEMA = T.StructType([T.StructField("state", T.StringType()), T.StructField("name", T.StringType()),
                             T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


@case("s02_pipe_cp1252", with_views("SELECT * FROM coords", "coords"))
def s02(fx):
    path = RD.scratch_path(fx.spark, "coords")
    fx.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    fx.coords.write.option("header", True).option("sep", "|").option("encoding", "windows-1252").csv(path)
    return RD.read_delimited(fx.spark, path, COORD_SCHEMA, sep="|", encoding="windows-1252")


# ------------------------------------------------------------------ S03 / V20
REG_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("codigo_act", T.StringType()),
                           T.StructField("per_ocu", T.StringType())])


def _catalogue(fx):
    src = fx.codes.join(fx.table("part").select("p_partkey", "p_size"), "p_partkey").filter(F.col("p_size") <= 45)
    cat = None
    for _, n in C.CLASS_LEVELS:
        part = src.select(F.substring("code", 1, n).alias("code")).distinct().select(
            "code", F.concat(F.lit(f"{n}:"), F.col("code")).alias("title"))
        cat = part if cat is None else cat.unionByName(part)
    return cat.distinct()


def _registry(fx):
    """Business registry rows written as latin-1 text and read back."""
    rows = fx.codes.select(F.col("p_partkey").alias("id"), F.col("code").alias("codigo_act"),
                           F.replace("size_band", F.lit("and more people"), F.lit("y más personas")).alias("per_ocu"))
    path = RD.scratch_path(fx.spark, "denue")
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return RD.read_delimited(fx.spark, path, REG_SCHEMA, sep=",", encoding="ISO-8859-1")


@case("s03_registry_latin1",
      with_views("SELECT p_partkey AS id, code AS codigo_act, replace(size_band, 'and more people', 'y más personas') "
                 "AS per_ocu FROM codes", "codes"))
def s03(fx):
    return _registry(fx)


@case("v20_establishments",
      with_views("SELECT c.id, c.codigo_act, c.per_ocu, " + ", ".join(f"k{n}.title AS {name}" for name, n in C.CLASS_LEVELS)
                 + ", list_max(list_transform(regexp_extract_all(replace(c.per_ocu, 'más', '500'), '(\\d+)', 1), "
                 "lambda x: CAST(x AS INTEGER))) AS personal FROM reg c "
                 + " ".join(f"LEFT JOIN cat k{n} ON k{n}.code = substr(c.codigo_act, 1, {n})" for _, n in C.CLASS_LEVELS),
                 "codes", extra=dict(cat=CAT_SQL, reg="SELECT p_partkey AS id, code AS codigo_act, "
                                     "replace(size_band, 'and more people', 'y más personas') AS per_ocu FROM codes")))
def v20(fx):
    return CE.establishments(_registry(fx), _catalogue(fx))


# ------------------------------------------------------------------ S04
ECO_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("ENTIDAD", "MUNICIPIO", "CODIGO", "ID_ESTRATO")]
                          + [T.StructField(m, T.DoubleType()) for m in ECO_MEASURES])


@case("s04_economic_csv", with_views("SELECT * REPLACE (nullif(ID_ESTRATO, '') AS ID_ESTRATO) FROM economic_census",
                                     "codes", "economic_census"),
      rounding=r(4, *ECO_MEASURES))
def s04(fx):
    path = RD.scratch_path(fx.spark, "economy")
    fx.economic_census.write.option("header", True).csv(path)
    return RD.read_delimited(fx.spark, path, ECO_SCHEMA, sep=",", encoding="UTF-8")


# ------------------------------------------------------------------ S05
def _production(fx):
    p = fx.plan
    return p.select("file", "T", "plant", "state", F.lit(1.0).alias("available"), F.lit(0.0).alias("expansion"),
                    "capacity", "production", F.lit(0.0).alias("init_inventory"), F.lit(0.0).alias("inventory"),
                    F.lit(0.0).alias("switch_cost"), F.lit(0.0).alias("layoff_cost"), "capex", "costs", "revenues",
                    "ebitda", "depreciation", "nopat", "fcf_wo_nwc",
                    F.try_divide(F.col("production"), F.col("capacity")).alias("utilization"))


@case("s05_scenario_folders",
      with_views("SELECT file, T, plant, state, 1.0::DOUBLE AS available, 0.0::DOUBLE AS expansion, capacity, "
                 "production, 0.0::DOUBLE AS init_inventory, 0.0::DOUBLE AS inventory, 0.0::DOUBLE AS switch_cost, "
                 "0.0::DOUBLE AS layoff_cost, capex, costs, "
                 "revenues, ebitda, depreciation, nopat, fcf_wo_nwc, production / NULLIF(capacity, 0) AS utilization "
                 "FROM plan", "plan"),
      rounding=r(4, "capex", "costs", "revenues", "ebitda", "depreciation", "nopat", "fcf_wo_nwc", "utilization"))
def s05(fx):
    base = RD.scratch_path(fx.spark, "scenarios")
    _production(fx).write.option("header", True).partitionBy("file").csv(os.path.join(base, "production"))
    fx.periods.select("date", "days", "T").coalesce(1).write.option("header", True).csv(
        os.path.join(base, "ts_specs", "stats.csv"))
    runs = RD.read_scenarios(fx.spark, base, tag_from="partition")
    assert runs["market"] is None and runs["demand"] is None  # missing result kinds are allowed
    return runs["production"]


def _name_files(fx, df, base, kind):
    """One CSV file per run, named after it, as a planner leaves them."""
    parts = os.path.join(base, f"_{kind}")
    df.repartition("file").write.option("header", True).partitionBy("file").csv(parts)
    jvm = fx.spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(fx.spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(os.path.join(base, kind)))
    for run in fs.globStatus(path(os.path.join(parts, "file=*"))):
        name = run.getPath().getName().split("=", 1)[1]
        for f in fs.globStatus(path(run.getPath().toString() + "/part-*")):
            fs.rename(f.getPath(), path(os.path.join(base, kind, f"{name}.csv")))


@case("s05_runs_by_file_name", with_views(
    "SELECT 'production' AS kind, file, T, plant AS place, production AS value FROM plan UNION ALL "
    "SELECT 'market', file, T, plant || '@' || CAST(state AS VARCHAR), production * 0.5 FROM plan UNION ALL "
    "SELECT 'demand', file, T, plant, production * 1.1 FROM plan UNION ALL "
    "SELECT 'objective', file, CAST(T AS INTEGER), NULL, sum(ebitda) FROM plan GROUP BY file, T", "plan"), rounding=r(3, "value"))
def s05_named(fx):
    """All four result kinds, read by file name."""
    base = RD.scratch_path(fx.spark, "runs")
    p, zero = fx.plan, F.lit(0.0)
    frames = {"production": _production(fx),
              "market": p.select("file", "T", F.col("state").cast("string").alias("mun"), "plant", (F.col("production") * 0.5).alias("sales"), zero.alias("freight"), zero.alias("revenue"), zero.alias("ebitda")),
              "demand": p.select("file", "T", F.col("plant").alias("mun"), (F.col("production") * 1.1).alias("demand"), *[zero.alias(x) for x in ("price", "freight_min", "freight_mean", "freight_median", "freight_max")]),
              "objective": p.groupBy("file", "T").agg(F.sum("ebitda").alias("objective")).select("file", "objective", F.col("T").cast("int").alias("step"))}
    for kind, df in frames.items():
        _name_files(fx, df, base, kind)
    runs = RD.read_scenarios(fx.spark, base)
    rows = [runs["production"].select("file", "T", F.col("plant").alias("place"), F.col("production").alias("value")),
            runs["market"].select("file", "T", F.concat("plant", F.lit("@"), "mun").alias("place"), F.col("sales").alias("value")),
            runs["demand"].select("file", "T", F.col("mun").alias("place"), F.col("demand").alias("value")),
            runs["objective"].select("file", F.col("step").alias("T"), F.lit(None).cast("string").alias("place"), F.col("objective").alias("value"))]
    out = None
    for kind, df in zip(("production", "market", "demand", "objective"), rows):
        df = df.select(F.lit(kind).alias("kind"), "*")
        out = df if out is None else out.unionByName(df)
    return out


# ------------------------------------------------------------------ S06 / S11
@case("s06_s11_partitioned_pattern_read", with_views("SELECT state, mun, date, price, litres FROM panel", "panel"),
      rounding=r(4, "price", "litres"))
def s06(fx):
    base = RD.scratch_path(fx.spark, "panel")
    RD.write_partitioned(fx.panel.select("state", "mun", "date", "price", "litres"), base, "state", "csv", header=True)
    schema = T.StructType([f for f in fx.panel.schema.fields if f.name in ("date", "price", "litres", "mun", "state")])
    return RD.read_by_pattern(fx.spark, base, "part-*.csv", schema).select("state", "mun", "date", "price", "litres")


# ------------------------------------------------------------------ S07 + U02
@case("s07_small_wide_csv",
      with_views("SELECT s.state, y.year, d.volume FROM (SELECT DISTINCT state FROM demand) s "
                 "CROSS JOIN (SELECT DISTINCT year FROM demand) y "
                 "LEFT JOIN demand d ON d.state = s.state AND d.year = y.year", "demand"), rounding=r(2, "volume"))
def s07(fx):
    years = [str(r["year"]) for r in fx.demand.select("year").distinct().orderBy("year").collect()]  # the sheet's columns
    wide = fx.demand.groupBy("state").pivot("year", [int(y) for y in years]).agg(F.first("volume"))
    path = RD.scratch_path(fx.spark, "demand")
    wide.write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("state", T.StringType())] + [T.StructField(y, T.DoubleType()) for y in years])
    back = RD.read_delimited(fx.spark, path, schema, sep=",", encoding="UTF-8")
    return wide_to_long(back, ["state"], years, "year", "volume", "int")


# ------------------------------------------------------------------ S08
@case("s08_two_row_header",
      with_views("SELECT s.state AS ENTIDAD, CAST(m.year AS INTEGER) AS year, m.month_str, x.price FROM "
                 "(SELECT DISTINCT state FROM sm) s CROSS JOIN (SELECT DISTINCT year, month, "
                 "['ENE','FEB','MAR','ABR','MAY','JUN','JUL','AGO','SEP','OCT','NOV','DIC'][month] AS month_str FROM sm) m "
                 "LEFT JOIN sm x ON x.state = s.state AND x.year = m.year AND x.month = m.month", "price_base",
                 extra=dict(sm="SELECT state, year(date) AS year, month(date) AS month, sum(e) / NULLIF(sum(q), 0) AS "
                               "price FROM price_base WHERE flag = 'A' GROUP BY 1, 2, 3")),
      rounding=r(4, "price"))
def s08(fx):
    sm, _, _ = fx.product_prices("A")
    # the sheet's column set: one column per (year, month), from a small distinct query (months)
    ym = sorted((r.year, r.month) for r in sm.select("year", "month").distinct().collect())
    cols = [f"c{i}" for i in range(len(ym))]
    data = sm.groupBy("state").agg(*[F.first(F.when((F.col("year") == y) & (F.col("month") == m), F.col("price")),
                                              ignorenulls=True).cast("string").alias(c)
                                     for (y, m), c in zip(ym, cols)])
    h1 = [str(y) if i == 0 or ym[i - 1][0] != y else None for i, (y, _) in enumerate(ym)]
    h2 = [C.MONTHS[m - 1] for _, m in ym]
    hdr = fx.spark.createDataFrame([(0, "ENTIDAD", *h1), (1, None, *h2)],
                                   T.StructType([T.StructField("_o", T.IntegerType()),
                                                 T.StructField("state", T.StringType())] +
                                                [T.StructField(c, T.StringType()) for c in cols]))
    sheet = hdr.unionByName(data.withColumn("_o", F.lit(2)))
    path = RD.scratch_path(fx.spark, "sheet")
    # several files, the header in the first
    sheet.repartitionByRange(4, "_o", "state").sortWithinPartitions("_o", "state").drop("_o").write.option("header", False).csv(path)
    long = RD.read_two_row_header(fx.spark, path, "ENTIDAD")
    return long.select("ENTIDAD", "year", "month_str", "price")


# ------------------------------------------------------------------ S09 / S12
@case("s09_drop_unnamed", with_views("SELECT * FROM coords", "coords"))
def s09(fx):
    return RD.drop_unnamed(fx.coords.withColumn("Unnamed: 0", F.monotonically_increasing_id()))


@case("s12_cached_table", with_views("SELECT * FROM coords", "coords"))
def s12(fx):
    path = RD.scratch_path(fx.spark, "coords-cache")
    RD.cached_table(fx.spark, path, lambda: fx.coords, "csv", header=True, sep="|")  # builds and writes
    back = RD.cached_table(fx.spark, path, lambda: fx.coords, "csv", header=True, sep="|")  # reuses
    return back.select("state", "name", F.col("lat").cast("double").alias("lat"),
                       F.col("lon").cast("double").alias("lon"))


def order_lines(fx, buckets: int = 32):
    """Line items and orders kept bucketed by the order key, and their join."""
    frames = {"lineitem": (fx.table("lineitem").select(F.col("l_orderkey").alias("order_key"), "l_suppkey", "l_extendedprice", "l_discount"), "l"),
              "orders": (fx.table("orders").select(F.col("o_orderkey").alias("order_key"), "o_orderpriority", "o_orderdate"), "o")}
    tag = zlib.crc32(fx.sf_dir.encode())
    kept = []
    for name, (df, alias) in frames.items():
        table = f"quarry_{name}_{tag}_{buckets}"
        kept.append(RD.bucketed_table(fx.spark, table, lambda df=df: df, "order_key", buckets, RD.scratch_path(fx.spark, table)).alias(alias))
    return kept[0].join(kept[1].hint("merge"), "order_key")


@case("s12_bucketed_join", with_views(
    "SELECT o_orderpriority AS file, CAST(year(o_orderdate) AS INTEGER) AS year, l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(DISTINCT l_orderkey) AS orders "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"), rounding=r(3, "revenue"))
def s12_bucketed(fx):
    return order_lines(fx).groupBy(F.col("o_orderpriority").alias("file"), F.year("o_orderdate").alias("year"), "l_suppkey") \
        .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.countDistinct("order_key").alias("orders"))
