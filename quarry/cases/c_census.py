"""Cases for census-scale tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.cases import case, r
from quarry.operators import clean as C
from quarry.operators.aggs import mean_coords
from quarry.plans import census as CE
from quarry.sources.fixtures import CENSUS_SHORT, ECO_MEASURES, with_views

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")  # the part-type dimension
LABELS = [f"RAMA - {t}" for t in TYPES] + [f"SUBRAMA - {t}" for t in TYPES]
KEYS = ["NOM_ENT", "ENTIDAD", "NOM_MUN", "MUN", "NOM_LOC", "LOC", "AGEB", "MZA"]


def blocks(fx):
    return C.clean_sentinels(fx.census_blocks, CENSUS_SHORT)


def _sent(x):
    return f"(CASE WHEN trim({x}) IN ('*', 'N/D', 'N/A') THEN 0.0 ELSE TRY_CAST({x} AS DOUBLE) END)"


SQL = {}
SQL["blk"] = ("SELECT " + ", ".join(KEYS) + ", " + ", ".join(f"{_sent(m)} AS {m}" for m in CENSUS_SHORT) +
              " FROM census_blocks")
SQL["det"] = ("SELECT * FROM blk WHERE MUN > 0 AND LOC > 0 AND MZA > 0 AND AGEB <> '0000' AND " +
              " AND ".join(f"{x} IS NOT NULL" for x in KEYS + CENSUS_SHORT))
SQL["ren"] = ("SELECT NOM_ENT AS state, CAST(TRY_CAST(ENTIDAD AS INTEGER) AS VARCHAR) AS state_key, NOM_MUN AS mun, "
              "CAST(TRY_CAST(MUN AS INTEGER) AS VARCHAR) AS mun_key, MZA, " + ", ".join(CENSUS_SHORT) +
              ", POB15_64 + POB65_MAS AS POBESC, GRAPROES * (POB15_64 + POB65_MAS) AS GRAPROESxPOBESC, "
              "PROM_OCUP * VIVPARH_CV AS PROM_OCUPxVIVPARH_CV FROM det")
SQL["roll"] = ("SELECT state, state_key, mun, mun_key, " + ", ".join(f"sum({m}) AS {m}" for m in CE.ROLLUP_SUMS) +
               ", count(MZA) AS MZA FROM ren GROUP BY 1, 2, 3, 4")
SQL["cc"] = ("SELECT CAST(TRY_CAST(state_key AS INTEGER) AS VARCHAR) AS state_key, "
             "CAST(TRY_CAST(mun_key AS INTEGER) AS VARCHAR) AS mun_key, avg(lat) AS lat, avg(lon) AS lon "
             "FROM census_coords GROUP BY 1, 2")
SQL["j"] = ("SELECT r.*, coalesce(c.lat, 0.0) AS lat, coalesce(c.lon, 0.0) AS lon, "
            "coalesce(r.GRAPROESxPOBESC / NULLIF(r.POBESC, 0), 0.0) AS GRAPROES, "
            "coalesce(r.PROM_OCUPxVIVPARH_CV / NULLIF(r.VIVPARH_CV, 0), 0.0) AS PROM_OCUP "
            "FROM roll r LEFT JOIN cc c USING (state_key, mun_key)")
SQL["v05"] = """
SELECT *, P_18YMAS - P_60YMAS AS PEA, POBTOT - (P_18YMAS - P_60YMAS) AS PNEA, POB15_64 + POB65_MAS AS POBEST,
       (POBTOT - (P_18YMAS - P_60YMAS)) / NULLIF(P_18YMAS - P_60YMAS, 0) AS CES, PDER_SS / NULLIF(POBTOT, 0) AS SST,
       TVIVPARHAB - VPH_C_SERV AS VPH_S_SERV, (TVIVPARHAB - VPH_C_SERV) / NULLIF(TVIVPARHAB, 0) AS VSB,
       VPH_S_ELEC / NULLIF(TVIVPARHAB, 0) AS VSE, VPH_AGUAFV / NULLIF(TVIVPARHAB, 0) AS VSA,
       VPH_NODREN / NULLIF(TVIVPARHAB, 0) AS VSD, TVIVPARHAB - VPH_INTER AS VPH_S_INTER,
       (TVIVPARHAB - VPH_INTER) / NULLIF(TVIVPARHAB, 0) AS VSI, VPH_PISOTI / NULLIF(TVIVPARHAB, 0) AS PDT,
       GRAPROES AS GES, PROM_OCUP AS DENS_HAB
FROM j"""
SQL["strata"] = ("SELECT ENTIDAD, MUNICIPIO, CODIGO, " + ", ".join(ECO_MEASURES) + " FROM economic_census WHERE "
                 "coalesce(TRY_CAST(nullif(trim(ID_ESTRATO), '') AS INTEGER), 0) IN (0, 99)")
SQL["collapsed"] = ("SELECT ENTIDAD, MUNICIPIO, CODIGO, " + ", ".join(f"max({m}) AS {m}" for m in ECO_MEASURES) +
                    " FROM strata GROUP BY 1, 2, 3")
SQL["v21"] = "SELECT * FROM collapsed LEFT JOIN activity_catalogue USING (CODIGO)"
SQL["a04"] = (
    "SELECT state_key, mun_key, CASE WHEN CLASIFICADOR_CODIGO = 'Rama' THEN 'RAMA - ' || ACTIVIDAD "
    "WHEN CLASIFICADOR_CODIGO = 'Subrama' THEN 'SUBRAMA - ' || ACTIVIDAD ELSE ACTIVIDAD END AS ACTIVIDAD, "
    + ", ".join(ECO_MEASURES) + " FROM (SELECT CAST(TRY_CAST(ENTIDAD AS INTEGER) AS VARCHAR) AS state_key, "
    "CAST(TRY_CAST(MUNICIPIO AS INTEGER) AS VARCHAR) AS mun_key, CLASIFICADOR_CODIGO, upper(DESC_CODIGO) AS ACTIVIDAD, "
    + ", ".join(f"sum({m}) AS {m}" for m in ECO_MEASURES) + " FROM v21 WHERE MUNICIPIO <> ' ' AND "
    "regexp_matches(CLASIFICADOR_CODIGO, 'Rama|Subrama') AND MUNICIPIO IS NOT NULL AND DESC_CODIGO IS NOT NULL "
    "GROUP BY 1, 2, 3, 4) g")
ORDER = list(SQL)


def csql(select, upto):
    extra = {k: SQL[k] for k in ORDER[: ORDER.index(upto) + 1]}
    return with_views(select, "census_blocks", "census_coords", "codes", "economic_census", "activity_catalogue",
                      extra=extra)


RATIOS = ["CES", "SST", "VSB", "VSE", "VSA", "VSD", "VSI", "PDT", "GES", "DENS_HAB", "GRAPROES", "PROM_OCUP",
          "lat", "lon"]


@case("a01_municipal_rollup", csql("SELECT * FROM roll", "roll"))
def a01(fx):
    return CE.municipal_rollup(blocks(fx))


@case("a02_mean_coords", csql("SELECT * FROM cc", "cc"), rounding=r(9, "lat", "lon"))
def a02(fx):
    return mean_coords(C.normalise_keys(fx.census_coords, ["state_key", "mun_key"]), ["state_key", "mun_key"])


@case("j03_left_join_fill", csql("SELECT state_key, mun_key, POBTOT, lat, lon FROM j", "j"), rounding=r(9, "lat", "lon"))
def j03(fx):
    return CE.municipal_indicators(blocks(fx), fx.census_coords).select("state_key", "mun_key", "POBTOT", "lat", "lon")


@case("a13_weighted_carry", csql("SELECT state_key, mun_key, GRAPROES, PROM_OCUP FROM j", "j"),
      rounding=r(9, "GRAPROES", "PROM_OCUP"))
def a13(fx):
    return CE.municipal_indicators(blocks(fx), fx.census_coords).select("state_key", "mun_key", "GRAPROES", "PROM_OCUP")


@case("p10_guarded_ratio",
      csql("SELECT state_key, mun_key, coalesce(VPH_S_ELEC / NULLIF(VPH_PISOTI, 0), 0.0) AS r FROM roll", "roll"),
      rounding=r(9, "r"))
def p10(fx):
    from quarry.functions.exprs import guarded_ratio
    return CE.municipal_rollup(blocks(fx)).select("state_key", "mun_key",
                                                  guarded_ratio("VPH_S_ELEC", "VPH_PISOTI").alias("r"))


@case("p09_socio_indicators", csql("SELECT * FROM v05", "v05"), rounding=r(9, *RATIOS))
def p09(fx):
    return CE.municipal_indicators(blocks(fx), fx.census_coords)


@case("v05_municipal_indicators", csql("SELECT * FROM v05", "v05"), rounding=r(9, *RATIOS))
def v05(fx):
    return CE.municipal_indicators(blocks(fx), fx.census_coords)


@case("a03_collapse_max", csql("SELECT * FROM collapsed", "collapsed"), rounding=r(4, *ECO_MEASURES))
def a03(fx):
    e = C.keep_strata(fx.economic_census, "ID_ESTRATO")
    return e.groupBy("ENTIDAD", "MUNICIPIO", "CODIGO").agg(*[F.max(m).alias(m) for m in ECO_MEASURES])


@case("v21_economic_normaliser", csql("SELECT * FROM v21", "v21"), rounding=r(4, *ECO_MEASURES))
def v21(fx):
    return CE.economic_normaliser(fx.economic_census, fx.activity_catalogue, ECO_MEASURES)


@case("j05_activity_catalogue", csql("SELECT ENTIDAD, MUNICIPIO, CODIGO, DESC_CODIGO, CLASIFICADOR_CODIGO FROM v21",
                                     "v21"))
def j05(fx):
    return CE.economic_normaliser(fx.economic_census, fx.activity_catalogue, ECO_MEASURES).select(
        "ENTIDAD", "MUNICIPIO", "CODIGO", "DESC_CODIGO", "CLASIFICADOR_CODIGO")


@case("a04_activity_rollup", csql("SELECT * FROM a04", "a04"), rounding=r(4, *ECO_MEASURES))
def a04(fx):
    v = CE.economic_normaliser(fx.economic_census, fx.activity_catalogue, ECO_MEASURES)
    return CE.activity_rollup(v, ECO_MEASURES)


def _wide_sql(measures):
    cols = []
    for m in measures:
        for lab in LABELS:
            cols.append(f"coalesce(sum(CASE WHEN ACTIVIDAD = '{lab}' THEN {m} END), 0.0) AS \"{m} - {lab}\"")
        cols.append(f"coalesce(sum(CASE WHEN starts_with(ACTIVIDAD, 'RAMA -') THEN {m} END), 0.0) AS {m}")
    return "SELECT state_key, mun_key, " + ", ".join(cols) + " FROM a04 GROUP BY state_key, mun_key"


WIDE_MEASURES = tuple(ECO_MEASURES)


@case("u03_u04_activity_wide", csql(_wide_sql(WIDE_MEASURES), "a04"),
      rounding=r(4, *[f"{m} - {lab}" for m in WIDE_MEASURES for lab in LABELS], *WIDE_MEASURES))
def u03(fx):
    v = CE.economic_normaliser(fx.economic_census, fx.activity_catalogue, ECO_MEASURES)
    roll = CE.activity_rollup(v, ECO_MEASURES)
    return CE.activity_wide(roll, WIDE_MEASURES, LABELS)


@case("v05_with_economy",
      csql("SELECT v.*, " + ", ".join(f'coalesce(w."{c}", 0.0) AS "{c}"' for c in
                                      [f"{m} - {lab}" for m in WIDE_MEASURES for lab in LABELS] + list(WIDE_MEASURES))
           + " FROM v05 v LEFT JOIN (" + _wide_sql(WIDE_MEASURES) + ") w USING (state_key, mun_key)", "a04"),
      rounding=r(9, *RATIOS) | r(4, *[f"{m} - {lab}" for m in WIDE_MEASURES for lab in LABELS], *WIDE_MEASURES))
def v05e(fx):
    v = CE.economic_normaliser(fx.economic_census, fx.activity_catalogue, ECO_MEASURES)
    wide = CE.activity_wide(CE.activity_rollup(v, ECO_MEASURES), WIDE_MEASURES, LABELS)
    return CE.municipal_indicators(blocks(fx), fx.census_coords, economy=wide)


LOC_SQL = ("SELECT CASE WHEN c_custkey % 31 = 0 THEN 'N/D' ELSE CAST(c_nationkey + 1 AS VARCHAR) END AS ENTIDAD, "
           "CASE WHEN c_custkey % 37 = 0 THEN ' *' ELSE lpad(CAST(c_custkey % 4 + 1 AS VARCHAR), 3, '0') END AS MUN, "
           "CAST(c_custkey % 5 + 1 AS VARCHAR) AS LOC, c_name AS NOM_LOC, 'Activa' AS ESTATUS FROM customer")


@case("p06_parse_locality_keys",
      with_views("SELECT TRY_CAST(trim(ENTIDAD) AS INTEGER) AS state_key, TRY_CAST(trim(MUN) AS INTEGER) AS mun_key, "
                 "TRY_CAST(trim(LOC) AS INTEGER) AS loc_key, NOM_LOC AS loc FROM loc WHERE "
                 "TRY_CAST(trim(ENTIDAD) AS INTEGER) IS NOT NULL AND TRY_CAST(trim(MUN) AS INTEGER) IS NOT NULL AND "
                 "TRY_CAST(trim(LOC) AS INTEGER) IS NOT NULL", extra=dict(loc=LOC_SQL)))
def p06l(fx):
    """Localities table with non-numeric keys on purpose: parse three keys, drop failures, rename, drop status."""
    c = fx.table("customer")
    k = F.col("c_custkey")
    loc = c.select(
        F.when(k % 31 == 0, F.lit("N/D")).otherwise((F.col("c_nationkey") + 1).cast("string")).alias("ENTIDAD"),
        F.when(k % 37 == 0, F.lit(" *")).otherwise(F.lpad((k % 4 + 1).cast("string"), 3, "0")).alias("MUN"),
        (k % 5 + 1).cast("string").alias("LOC"), F.col("c_name").alias("NOM_LOC"), F.lit("Activa").alias("ESTATUS"))
    parsed = C.parse_int_keys(loc, ["ENTIDAD", "MUN", "LOC"]).drop("ESTATUS")
    return C.rename(parsed, {"ENTIDAD": "state_key", "MUN": "mun_key", "LOC": "loc_key", "NOM_LOC": "loc"})
