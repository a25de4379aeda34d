"""Census-scale tables: V05 (municipal indicators), V21 (economic census normaliser), V20, V22.

Block tables are the largest inputs: every step before the municipal
roll-up is a single projection / filter fused into the scan, the roll-up is
a partial + final aggregate, and the coordinate table is aggregated on its
own keys before the (small) result is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import guarded_ratio
from quarry.operators import clean as C
from quarry.operators.aggs import mean_coords
from quarry.operators.reshape import pivot_measures
from quarry.session import broadcast_if_small

MUN_KEYS = ["state", "state_key", "mun", "mun_key"]
ROLLUP_SUMS = ["POBTOT", "P_18YMAS", "P_60YMAS", "POB15_64", "POB65_MAS", "PDER_SS", "TVIVPARHAB", "VPH_C_SERV",
               "VPH_S_ELEC", "VPH_AGUAFV", "VPH_NODREN", "VPH_INTER", "VPH_PISOTI", "VPH_AUTOM",
               "PROM_OCUPxVIVPARH_CV", "VIVPARH_CV", "GRAPROESxPOBESC", "POBESC"]


def municipal_rollup(blocks: DataFrame) -> DataFrame:
    """P07 + P04 + A13 (carry) + P05 + A01: detail blocks to one row per municipality."""
    d = C.detail_rows(blocks, ["MUN", "LOC", "MZA"], "AGEB")
    # one projection (names are case-insensitive: NOM_MUN -> mun would collide with MUN in a rename chain)
    ren = {"NOM_ENT": "state", "ENTIDAD": "state_key", "NOM_MUN": "mun", "MUN": "mun_key"}
    d = d.select(*[F.col(c).alias(ren.get(c, c)) for c in d.columns])
    pobesc = F.col("POB15_64") + F.col("POB65_MAS")
    d = d.select(*d.columns, pobesc.alias("POBESC"), (F.col("GRAPROES") * pobesc).alias("GRAPROESxPOBESC"),
                 (F.col("PROM_OCUP") * F.col("VIVPARH_CV")).alias("PROM_OCUPxVIVPARH_CV"))
    d = C.normalise_keys(d, ["state_key", "mun_key"])
    return d.groupBy(*MUN_KEYS).agg(*[F.sum(m).alias(m) for m in ROLLUP_SUMS], F.count("MZA").alias("MZA"))


def municipal_indicators(blocks: DataFrame, coords: DataFrame, economy: DataFrame | None = None) -> DataFrame:
    """Municipal roll-up + mean coordinates (J03 left join, missing -> 0) + P10 + P09.

    With ``economy`` (the wide activity table of ``activity_wide``, keyed by
    state_key / mun_key) its columns are joined on and missing cells become 0.
    """
    m = municipal_rollup(blocks)
    cc = mean_coords(C.normalise_keys(coords, ["state_key", "mun_key"]), ["state_key", "mun_key"])
    j = m.join(broadcast_if_small(cc), ["state_key", "mun_key"], "left").na.fill(0.0, subset=["lat", "lon"])
    j = j.select(*j.columns, guarded_ratio("GRAPROESxPOBESC", "POBESC").alias("GRAPROES"),
                 guarded_ratio("PROM_OCUPxVIVPARH_CV", "VIVPARH_CV").alias("PROM_OCUP"))
    out = C.socio_indicators(j)
    if economy is not None:
        eco_cols = [c for c in economy.columns if c not in ("state_key", "mun_key")]
        out = out.join(broadcast_if_small(economy), ["state_key", "mun_key"], "left").na.fill(0.0, subset=eco_cols)
    return out


def economic_normaliser(eco: DataFrame, catalogue: DataFrame, measures: Sequence[str]) -> DataFrame:
    """P03 strata filter, A03 collapse by max, J05 catalogue left join."""
    e = C.keep_strata(eco, "ID_ESTRATO")
    e = e.groupBy("ENTIDAD", "MUNICIPIO", "CODIGO").agg(*[F.max(m).alias(m) for m in measures])
    return e.join(broadcast_if_small(catalogue), "CODIGO", "left")


def activity_rollup(eco: DataFrame, measures: Sequence[str]) -> DataFrame:
    """A04 + P08 + P22: sums per (state_key, mun_key, class, activity) for Rama / Subrama rows, labelled."""
    e = eco.filter((F.col("MUNICIPIO") != " ") & F.col("CLASIFICADOR_CODIGO").rlike("Rama|Subrama")) \
        .na.drop(subset=["MUNICIPIO", "CLASIFICADOR_CODIGO", "DESC_CODIGO"])
    e = e.select(F.expr("try_cast(ENTIDAD AS INT)").cast("string").alias("state_key"),
                 F.expr("try_cast(MUNICIPIO AS INT)").cast("string").alias("mun_key"),
                 "CLASIFICADOR_CODIGO", F.upper("DESC_CODIGO").alias("ACTIVIDAD"), *measures)
    g = e.groupBy("state_key", "mun_key", "CLASIFICADOR_CODIGO", "ACTIVIDAD").agg(*[F.sum(m).alias(m) for m in measures])
    label = F.when(F.col("CLASIFICADOR_CODIGO") == "Rama", F.concat(F.lit("RAMA - "), F.col("ACTIVIDAD"))) \
        .when(F.col("CLASIFICADOR_CODIGO") == "Subrama", F.concat(F.lit("SUBRAMA - "), F.col("ACTIVIDAD"))) \
        .otherwise(F.col("ACTIVIDAD"))
    return g.select("state_key", "mun_key", label.alias("ACTIVIDAD"), *measures)


def activity_wide(rollup: DataFrame, measures: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """U03 + U04: one column per (measure, activity) plus a per-measure RAMA subtotal."""
    return pivot_measures(rollup, ["state_key", "mun_key"], "ACTIVIDAD", measures, labels, subtotal_prefix="RAMA -")


def establishments(rows: DataFrame, catalogue: DataFrame, code: str = "codigo_act", band: str = "per_ocu",
                   more_word: str = "más") -> DataFrame:
    """Business rows with the five class-level titles (P19) and the staff upper bound (P20)."""
    out = C.class_levels(rows, code, catalogue)
    return out.withColumn("personal", C.band_upper(band, more_word=more_word))


def location_hierarchy(blocks: DataFrame, localities: DataFrame, municipalities: DataFrame,
                       states: DataFrame) -> DataFrame:
    """Block rows enriched up to locality, municipality and state (detail side kept).

    Each level is a dimension: joined left by broadcast, colliding names qualified.
    """
    out = blocks
    for dim, keys, pref in ((localities, ["state_key", "mun_key", "loc_key"], "loc_"),
                            (municipalities, ["state_key", "mun_key"], "mun_"),
                            (states, ["state_key"], "state_")):
        ren = dim.select(*keys, *[F.col(c).alias(pref + c) for c in dim.columns if c not in keys])
        out = out.join(broadcast_if_small(ren), keys, "left")
    return out
