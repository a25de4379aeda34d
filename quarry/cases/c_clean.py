"""Cases for projections, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.cases import case, r
from quarry.functions import exprs as X
from quarry.operators import clean as C
from quarry.sources.fixtures import CENSUS_SHORT, with_views

KEYS = ["NOM_ENT", "ENTIDAD", "NOM_MUN", "MUN", "NOM_LOC", "LOC", "AGEB", "MZA"]


def _sent_sql(x: str, strict: bool = False) -> str:
    v = f"(CASE WHEN trim({x}) IN ('*', 'N/D', 'N/A') THEN 0.0 ELSE TRY_CAST({x} AS DOUBLE) END)"
    return f"coalesce({v}, 0.0)" if strict else v


# ------------------------------------------------------------------ P01
@case("p01_clean_sentinels",
      with_views("SELECT " + ", ".join(KEYS) + ", " + ", ".join(f"{_sent_sql(m)} AS {m}" for m in CENSUS_SHORT)
                 + " FROM census_blocks", "census_blocks"))
def p01(fx):
    return C.clean_sentinels(fx.census_blocks, CENSUS_SHORT)


@case("p01_clean_sentinels_strict",
      with_views("SELECT p_partkey, " + _sent_sql("size_text", True) + " AS size_text FROM sentinel_text",
                 "sentinel_text"))
def p01s(fx):
    return C.clean_sentinels(fx.sentinel_text.select("p_partkey", "size_text"), ["size_text"], strict=True)


# ------------------------------------------------------------------ P02
@case("p02_label_missing",
      with_views("SELECT p_partkey, CASE WHEN label IS NULL OR trim(label) IN ('*', 'N/D', 'N/A') THEN 'N/A' "
                 "ELSE label END AS label FROM sentinel_text", "sentinel_text"))
def p02(fx):
    return C.label_missing(fx.sentinel_text.select("p_partkey", "label"), ["label"])


# ------------------------------------------------------------------ P03
STRATUM_SQL = ("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN ' 99' "
               "ELSE CAST(p_size AS VARCHAR) END AS ID_ESTRATO, p_retailprice FROM part")


@case("p03_keep_strata",
      with_views("SELECT p_partkey, coalesce(TRY_CAST(nullif(trim(ID_ESTRATO), '') AS INTEGER), 0) AS ID_ESTRATO, "
                 "p_retailprice FROM strata WHERE coalesce(TRY_CAST(nullif(trim(ID_ESTRATO), '') AS INTEGER), 0) "
                 "IN (0, 99)", extra=dict(strata=STRATUM_SQL)))
def p03(fx):
    p = fx.table("part")
    s = p.select("p_partkey",
                 F.when(F.col("p_size") % 4 == 0, F.lit("")).when(F.col("p_size") % 4 == 1, F.lit(None))
                 .when(F.col("p_size") % 4 == 2, F.lit(" 99")).otherwise(F.col("p_size").cast("string"))
                 .alias("ID_ESTRATO"), "p_retailprice")
    return C.keep_strata(s, "ID_ESTRATO")


# ------------------------------------------------------------------ P04 / P05 / P06
@case("p04_rename",
      with_views("SELECT state AS estado, mun AS municipio, pop AS POBTOT, hab_houses AS TVIVPARHAB, "
                 "cars AS VPH_AUTOM, lat, lon FROM population", "population"), rounding=r(2, "VPH_AUTOM", "lat", "lon"))
def p04(fx):
    return C.rename(fx.population, {"state": "estado", "mun": "municipio", "pop": "POBTOT",
                                    "hab_houses": "TVIVPARHAB", "cars": "VPH_AUTOM"})


@case("p05_normalise_keys",
      "SELECT p_partkey, CAST(TRY_CAST(lpad(CAST(p_partkey % 1000 AS VARCHAR), 5, '0') AS INTEGER) AS VARCHAR) "
      "AS code FROM part")
def p05(fx):
    p = fx.table("part").select("p_partkey", F.lpad((F.col("p_partkey") % 1000).cast("string"), 5, "0").alias("code"))
    return C.normalise_keys(p, ["code"])


@case("p06_parse_int_keys",
      with_views("SELECT p_partkey, TRY_CAST(trim(size_text) AS INTEGER) AS size_text FROM sentinel_text "
                 "WHERE TRY_CAST(trim(size_text) AS INTEGER) IS NOT NULL", "sentinel_text"))
def p06(fx):
    return C.parse_int_keys(fx.sentinel_text.select("p_partkey", "size_text"), ["size_text"])


# ------------------------------------------------------------------ P07
@case("p07_detail_rows",
      with_views("SELECT * FROM (SELECT " + ", ".join(KEYS) + ", " +
                 ", ".join(f"{_sent_sql(m)} AS {m}" for m in CENSUS_SHORT) +
                 " FROM census_blocks) c WHERE MUN > 0 AND LOC > 0 AND MZA > 0 AND AGEB <> '0000' AND " +
                 " AND ".join(f"{x} IS NOT NULL" for x in KEYS + CENSUS_SHORT), "census_blocks"))
def p07(fx):
    cb = C.clean_sentinels(fx.census_blocks, CENSUS_SHORT)
    return C.detail_rows(cb, ["MUN", "LOC", "MZA"], "AGEB")


# ------------------------------------------------------------------ P08
@case("p08_text_filter",
      "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'ring|widget') "
      "AND contains(p_name, 'r') AND NOT contains(p_name, 'small')")
def p08(fx):
    p = fx.table("part").select("p_partkey", "p_name")
    return C.text_filter(p, "p_name", regex="ring|widget", contains="r", not_contains="small")


# ------------------------------------------------------------------ P11
P11_SRC = ("SELECT file, T, plant, CASE WHEN T = 0 THEN 'inf'::DOUBLE WHEN T = 1 THEN 'nan'::DOUBLE "
           "WHEN T = 2 THEN NULL ELSE capacity END AS capacity FROM plan")


@case("p11_capacity_policy",
      with_views("SELECT file, T, plant, CASE WHEN isnan(coalesce(capacity, 0)) THEN 0.0 "
                 "WHEN coalesce(capacity, 0) = 'inf'::DOUBLE THEN 1e25 ELSE coalesce(capacity, 0) END AS capacity "
                 "FROM src", "plan", extra=dict(src=P11_SRC)))
def p11(fx):
    p = fx.plan.select("file", "T", "plant", F.when(F.col("T") == 0, F.lit(float("inf")))
                       .when(F.col("T") == 1, F.lit(float("nan"))).when(F.col("T") == 2, F.lit(None))
                       .otherwise(F.col("capacity")).alias("capacity"))
    return p.select("file", "T", "plant", X.capacity_policy("capacity").alias("capacity"))


# ------------------------------------------------------------------ P12
@case("p12_unit_conversion",
      with_views("SELECT state, year, volume * 1000.0 AS BBL, volume * 1000.0 * 158.9873027281 AS litres "
                 "FROM demand", "demand"), rounding={"BBL": 2, "litres": 0})
def p12(fx):
    d = fx.demand
    bbl = F.col("volume") * C.BARRELS_PER_THOUSAND
    return d.select("state", "year", bbl.alias("BBL"), C.barrels_to_litres(bbl).alias("litres"))


# ------------------------------------------------------------------ P13 / P14 / P15
MONTH_ARR = "[" + ", ".join(f"'{m}'" for m in C.MONTHS) + "]"


@case("p13_month_number",
      f"SELECT o_orderkey, {MONTH_ARR}[month(o_orderdate)] AS month_str, "
      f"CAST(list_position({MONTH_ARR}, {MONTH_ARR}[month(o_orderdate)]) AS INTEGER) AS month FROM orders")
def p13(fx):
    o = fx.table("orders").select("o_orderkey", "o_orderdate")
    names = F.array(*[F.lit(m) for m in C.MONTHS])
    s = o.select("o_orderkey", F.element_at(names, F.month("o_orderdate")).alias("month_str"))
    return s.select("o_orderkey", "month_str", C.month_number(F.col("month_str")).alias("month"))


@case("p14_parse_dmy",
      "SELECT o_orderkey, CAST(try_strptime(CASE WHEN o_orderkey % 17 = 0 THEN '32/01/1996' "
      "ELSE strftime(o_orderdate, '%d/%m/%Y') END, '%d/%m/%Y') AS DATE) AS date FROM orders")
def p14(fx):
    o = fx.table("orders").select("o_orderkey", "o_orderdate")
    t = F.when(F.col("o_orderkey") % 17 == 0, F.lit("32/01/1996")).otherwise(
        F.date_format("o_orderdate", "dd/MM/yyyy"))
    return o.select("o_orderkey", C.parse_dmy(t).alias("date"))


@case("p15_date_parts",
      "SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS year, "
      "CAST(month(o_orderdate) AS INTEGER) AS month, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_m, "
      "CAST(date_trunc('year', o_orderdate) AS DATE) AS period_y, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday "
      "FROM orders")
def p15(fx):
    return C.date_parts(fx.table("orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


# ------------------------------------------------------------------ P16 / P17 / P18
def _cal_sql(ts: str, mode: str) -> str:
    import math
    period = X.WEEK_SECONDS if mode == "reference" else 7
    two_pi = 2.0 * math.pi
    wd = f"CAST(isodow({ts}) - 1 AS DOUBLE)"
    secs = f"CAST(floor(epoch({ts})) AS DOUBLE)"
    return (f"sin({wd} * {two_pi / period!r}) AS day_sin, cos({wd} * {two_pi / period!r}) AS day_cos, "
            f"sin({secs} * {two_pi / X.WEEK_SECONDS!r}) AS week_sin, cos({secs} * {two_pi / X.WEEK_SECONDS!r}) AS week_cos, "
            f"sin({secs} * {two_pi / X.MONTH_SECONDS!r}) AS month_sin, "
            f"cos({secs} * {two_pi / X.MONTH_SECONDS!r}) AS month_cos")


CAL_COLS = ["day_sin", "day_cos", "week_sin", "week_cos", "month_sin", "month_cos"]


@case("p16_calendar_features", "SELECT event_id, " + _cal_sql("ts", "default") + " FROM events",
      rounding=r(8, *CAL_COLS))
def p16(fx):
    e = fx.table("events").select("event_id", "ts")
    return e.select("event_id", *X.calendar_features(F.col("ts")))


@case("p16_calendar_features_reference", "SELECT event_id, " + _cal_sql("ts", "reference") + " FROM events",
      rounding=r(8, *CAL_COLS))
def p16r(fx):
    e = fx.table("events").select("event_id", "ts")
    return e.select("event_id", *X.calendar_features(F.col("ts"), mode="reference"))


@case("p17_sigmoid",
      with_views("SELECT file, T, plant, 1.0 / (1.0 + exp(-((revenues - costs) / NULLIF(revenues, 0)))) AS s "
                 "FROM plan", "plan"), rounding=r(10, "s"))
def p17(fx):
    p = fx.plan
    return p.select("file", "T", "plant", X.sigmoid(X.safe_div(F.col("revenues") - F.col("costs"),
                                                             F.col("revenues"))).alias("s"))


SITE_LON, SITE_LAT = -95.358421, 29.749907  # fixed value: the import terminal's coordinates


@case("p18_haversine",
      with_views(f"SELECT state, name, {X.haversine_sql('lon', 'lat', repr(SITE_LON), repr(SITE_LAT))} AS kms "
                 "FROM coords", "coords"), rounding=r(6, "kms"))
def p18(fx):
    c = fx.coords
    return c.select("state", "name", X.haversine("lon", "lat", F.lit(SITE_LON), F.lit(SITE_LAT)).alias("kms"))


# ------------------------------------------------------------------ P19 / P20 / P21 / P22
CAT_SQL = " UNION ".join(
    f"SELECT DISTINCT substr(code, 1, {n}) AS code, '{n}:' || substr(code, 1, {n}) AS title FROM codes "
    f"JOIN part USING (p_partkey) WHERE p_size <= 45" for _, n in C.CLASS_LEVELS)


@case("p19_class_levels",
      with_views("SELECT c.p_partkey, c.code, " + ", ".join(f"k{n}.title AS {name}" for name, n in C.CLASS_LEVELS)
                 + " FROM codes c " + " ".join(f"LEFT JOIN cat k{n} ON k{n}.code = substr(c.code, 1, {n})"
                                                for _, n in C.CLASS_LEVELS),
                 "codes", extra=dict(cat=CAT_SQL)))
def p19(fx):
    codes = fx.codes.select("p_partkey", "code")
    src = fx.codes.join(fx.table("part").select("p_partkey", "p_size"), "p_partkey").filter(F.col("p_size") <= 45)
    cat = None
    for _, n in C.CLASS_LEVELS:
        part = src.select(F.substring("code", 1, n).alias("code")).distinct().select(
            "code", F.concat(F.lit(f"{n}:"), F.col("code")).alias("title"))
        cat = part if cat is None else cat.unionByName(part)
    return C.class_levels(codes, "code", cat.distinct())


@case("p20_band_upper",
      with_views("SELECT p_partkey, size_band, list_max(list_transform(regexp_extract_all("
                 "replace(size_band, 'more', '500'), '(\\d+)', 1), lambda x: CAST(x AS INTEGER))) AS personal FROM codes",
                 "codes"))
def p20(fx):
    return fx.codes.select("p_partkey", "size_band", C.band_upper("size_band", more_word="more").alias("personal"))


@case("p21_plain_upper",
      "SELECT p_partkey, replace(translate(upper(p_name), 'ÁÉÍÓÚÜÑ', 'AEIOUUN'), ' ', '_') AS name FROM part")
def p21(fx):
    return fx.table("part").select("p_partkey", C.plain_upper("p_name").alias("name"))


@case("p22_prefix_label",
      "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'RAMA - ' || p_name ELSE p_name END AS label FROM part")
def p22(fx):
    return fx.table("part").select("p_partkey", C.prefix_label("p_name", "p_type", "ECONOMY", "RAMA").alias("label"))


# ------------------------------------------------------------------ P23
@case("p23_last_percentage",
      with_views("SELECT doc_id, coalesce(CAST(CASE WHEN len(regexp_extract_all(text, '(\\d+(?:\\.\\d*)?)%', 1)) > 0 "
                 "THEN regexp_extract_all(text, '(\\d+(?:\\.\\d*)?)%', 1)[-1] END AS DOUBLE) / 100.0, -1.0) AS gap "
                 "FROM logs", "logs"), rounding=r(10, "gap"))
def p23(fx):
    return fx.logs.select("doc_id", C.last_percentage("text").alias("gap"))


@case("p23_last_percentage_reference",
      with_views("SELECT doc_id, coalesce(CAST(CASE WHEN len(regexp_extract_all(text, '(\\d\\.\\d*)%', 1)) > 0 "
                 "THEN regexp_extract_all(text, '(\\d\\.\\d*)%', 1)[-1] END AS DOUBLE) / 100.0, -1.0) AS gap "
                 "FROM logs", "logs"), rounding=r(10, "gap"))
def p23r(fx):
    return fx.logs.select("doc_id", C.last_percentage("text", reference_pattern=True).alias("gap"))


# ------------------------------------------------------------------ P25
@case("p25_indicators",
      with_views("SELECT file, T, plant, CASE WHEN abs(ebitda) > 1e-5 THEN 1 ELSE 0 END AS delta, "
                 "CASE WHEN ebitda > 0 THEN 1 ELSE 0 END AS step FROM plan", "plan"))
def p25(fx):
    p = fx.plan
    return p.select("file", "T", "plant", X.delta_flag("ebitda").alias("delta"), X.step_flag("ebitda").alias("step"))
