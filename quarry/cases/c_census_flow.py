"""Cases of the census flow (R01-R04) on block tables that hold their published totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.cases import case, r
from quarry.operators import clean as C
from quarry.plans import census_flow as CF
from quarry.sources.fixtures import with_views

SUMS, MEANS = ["POBTOT", "P_18YMAS", "TVIVPARHAB"], ["GRAPROES", "PROM_OCUP"]
ALL = SUMS + MEANS
CODES = ["NOM_ENT", "ENTIDAD", "NOM_MUN", "MUN", "NOM_LOC", "LOC", "AGEB", "MZA"]
# Totals depart from the blocks' sums by a share of these codes; some groups have none.
SHARE = ("LOC", "MUN", "ENTIDAD", "ENTIDAD")
ABSENT = ("(ENTIDAD + MUN + LOC) % 11 = 0", "(ENTIDAD + LOC) % 13 = 0", "false", "false")


def published(fx):
    """Block rows and, below them, four kinds of total rows; localities 3 of municipality 2 have no name."""
    b = C.clean_sentinels(fx.census_blocks, ALL).select(*CODES, *ALL)
    out = b.withColumn("NOM_LOC", F.expr("CASE WHEN MUN = 2 AND LOC = 3 THEN NULL ELSE NOM_LOC END"))
    for i, keys in enumerate(CF.LEVELS):
        f = F.lit(1.0) + (F.col(SHARE[i]) % 7) / 100.0
        t = b.filter(CF.is_block()).filter(~F.expr(ABSENT[i])).groupBy("NOM_ENT", *(["NOM_MUN"] if "MUN" in keys else []), *keys) \
            .agg(*[(F.sum(m) * f).alias(m) for m in SUMS], *[(F.avg(m) * f).alias(m) for m in MEANS])
        out = out.unionByName(t.select("NOM_ENT", "ENTIDAD", *[F.col(c) if c in t.columns else d.alias(c) for c, d in (
            ("NOM_MUN", F.lit("Total")), ("MUN", F.lit(0)), ("LOC", F.lit(0)), ("AGEB", F.lit("0000")))],
            F.lit(CF.TOTAL_NAMES[i]).alias("NOM_LOC"), F.lit(0).alias("MZA"), *ALL))
    return out


# ------------------------------------------------------------------ SQL twin
BLOCK = "MZA <> 0 AND AGEB <> '0000' AND LOC <> 0 AND MUN <> 0"


def _sent(x):
    return f"(CASE WHEN trim({x}) IN ('*', 'N/D', 'N/A') THEN 0.0 ELSE TRY_CAST({x} AS DOUBLE) END)"


def _rows_sql() -> str:
    parts = [f"SELECT NOM_ENT, ENTIDAD, NOM_MUN, MUN, CASE WHEN MUN = 2 AND LOC = 3 THEN NULL ELSE NOM_LOC END AS NOM_LOC, LOC, AGEB, MZA, {', '.join(ALL)} FROM blk"]
    for i, keys in enumerate(CF.LEVELS):
        f = f"(1.0 + ({SHARE[i]} % 7) / 100.0)"
        code = lambda c, blank: c if c in keys else f"{blank} AS {c}"
        mun = "NOM_MUN" if "MUN" in keys else "'Total' AS NOM_MUN"
        group = ", ".join(["NOM_ENT", *keys] + (["NOM_MUN"] if "MUN" in keys else []))
        parts.append(f"SELECT NOM_ENT, ENTIDAD, {mun}, {code('MUN', 0)}, '{CF.TOTAL_NAMES[i]}' AS NOM_LOC, {code('LOC', 0)}, {code('AGEB', chr(39) + '0000' + chr(39))}, 0 AS MZA, "
                     + ", ".join([f"sum({m}) * {f} AS {m}" for m in SUMS] + [f"avg({m}) * {f} AS {m}" for m in MEANS])
                     + f" FROM blk WHERE {BLOCK} AND NOT ({ABSENT[i]}) GROUP BY {group}")
    return " UNION ALL ".join(parts)


def _level_sql(i: int, ratio: str) -> str:
    keys = CF.LEVELS[i]
    k = ", ".join(keys)
    src = f"(SELECT * FROM pub WHERE {BLOCK})" if i == 0 else f"f{i - 1}"
    aggs = ["count(*) AS n" if i == 0 else "sum(n) AS n"]
    for m in ALL:
        aggs.append(f"sum({m}) AS sx_{m}, sum({m}) AS c_{m}, count({m}) AS k_{m}" if i == 0 else
                    f"sum(sx_{m}) AS sx_{m}, sum(c_{m}) AS c_{m}, sum(CASE WHEN c_{m} IS NOT NULL THEN k_{m} END) AS k_{m}")
    outs = []
    for m in ALL:
        s = f"(c_{m} / NULLIF(k_{m}, 0))" if m in MEANS else f"coalesce(c_{m}, 0.0)"
        rr = f"coalesce(D_{m} / NULLIF({s}, 0), 1.0)" if ratio == "direct" else f"coalesce({s} / NULLIF(D_{m}, 0), 1.0)"
        ax = f"(sx_{m} / n)" if m in MEANS else f"sx_{m}"
        d = f"(({rr}) * {ax} - D_{m})" + ("" if m in MEANS and ratio == "direct" else " / n")
        outs.append(f"sx_{m}, ({rr}) * sx_{m} - n * ({d}) AS c_{m}, CASE WHEN ({d}) IS NOT NULL THEN n END AS k_{m}, {rr} AS r_{m}, {d} AS d_{m}")
    tot = ", ".join([f"sum({m}) AS D_{m}" for m in SUMS] + [f"avg({m}) AS D_{m}" for m in MEANS])
    return (f"SELECT {k}, n, {', '.join(outs)} FROM (SELECT {k}, {', '.join(aggs)} FROM {src} x GROUP BY {k}) g "
            f"LEFT JOIN (SELECT {k}, {tot} FROM pub WHERE NOM_LOC = '{CF.TOTAL_NAMES[i]}' GROUP BY {k}) t USING ({k})")


def _views(ratio: str = "reference") -> dict[str, str]:
    v = {"blk": f"SELECT {', '.join(CODES)}, {', '.join(f'{_sent(m)} AS {m}' for m in ALL)} FROM census_blocks", "pub": _rows_sql()}
    for i in range(len(CF.LEVELS)):
        v[f"f{i}"] = _level_sql(i, ratio)
    names = ", ".join(f"'{n}'" for n in CF.TOTAL_NAMES)
    v["ne"] = f"SELECT ENTIDAD, max(NOM_ENT) AS NOM_ENT FROM pub WHERE NOM_ENT NOT IN ({names}) GROUP BY 1"
    v["nm"] = f"SELECT ENTIDAD, MUN, max(NOM_MUN) AS NOM_MUN FROM pub WHERE NOM_MUN NOT IN ({names}) GROUP BY 1, 2"
    v["nl"] = f"SELECT ENTIDAD, MUN||'-'||LOC AS area, max(NOM_LOC) AS NOM_LOC FROM pub WHERE NOM_LOC NOT IN ({names}) GROUP BY 1, 2"
    v["flow"] = ("SELECT b.ENTIDAD, b.MUN, b.LOC, b.AGEB, b.MZA, " + ", ".join(f"b.{m} * f3.r_{m} - f3.d_{m} AS {m}" for m in ALL)
                 + ", coalesce(ne.NOM_ENT, 'N/A') AS NOM_ENT, coalesce(nm.NOM_MUN, 'N/A') AS NOM_MUN, coalesce(nl.NOM_LOC, 'N/A') AS NOM_LOC "
                 f"FROM (SELECT * FROM pub WHERE {BLOCK}) b LEFT JOIN f3 USING (ENTIDAD) LEFT JOIN ne USING (ENTIDAD) LEFT JOIN nm USING (ENTIDAD, MUN) "
                 "LEFT JOIN nl ON nl.ENTIDAD = b.ENTIDAD AND nl.area = b.MUN||'-'||b.LOC")
    return v


@case("r01_census_flow", with_views("SELECT * FROM flow", "census_blocks", extra=_views()), rounding=r(5, *ALL))
def r01_flow(fx):
    return CF.reconcile_published(published(fx), SUMS, MEANS)


@case("r01_census_flow_direct", with_views("SELECT * FROM flow", "census_blocks", extra=_views("direct")), rounding=r(5, *ALL))
def r01_flow_direct(fx):
    return CF.reconcile_published(published(fx), SUMS, MEANS, "direct")


@case("r03_census_closing", with_views(
    "SELECT ENTIDAD, reconciled, published, abs(reconciled / NULLIF(published, 0) - 1) < 0.01 AS ok FROM (SELECT ENTIDAD, sum(POBTOT) AS reconciled FROM flow GROUP BY 1) a "
    f"JOIN (SELECT ENTIDAD, sum(POBTOT) AS published FROM pub WHERE NOM_LOC = '{CF.TOTAL_NAMES[3]}' GROUP BY 1) b USING (ENTIDAD)", "census_blocks", extra=_views()),
    rounding=r(3, "reconciled", "published"))
def r03_flow(fx):
    p = published(fx)
    return CF.closing(p, CF.reconcile_published(p, SUMS, MEANS))


@case("r04_composite_names", with_views(
    "SELECT b.ENTIDAD, b.MUN||'-'||b.LOC AS area, coalesce(max(nl.NOM_LOC), 'N/A') AS NOM_LOC, count(*) AS blocks FROM (SELECT * FROM pub WHERE " + BLOCK + ") b "
    "LEFT JOIN nl ON nl.ENTIDAD = b.ENTIDAD AND nl.area = b.MUN||'-'||b.LOC GROUP BY 1, 2", "census_blocks", extra=_views()))
def r04_composite(fx):
    p = published(fx)
    named = CF.name_areas(p.filter(CF.is_block()), p)
    return named.groupBy("ENTIDAD", CF.locality_key().alias("area"), "NOM_LOC").agg(F.count(F.lit(1)).alias("blocks")).select("ENTIDAD", "area", "NOM_LOC", "blocks")


def _ratio_sql(src: str, group: str) -> str:
    g = ", ".join(f"sum({m}) FILTER (is_total) / NULLIF(sum({m}) FILTER (NOT is_total), 0) AS R_{m}" for m in SUMS)
    return f"(SELECT {group}, {g} FROM {src} GROUP BY {group})"


@case("r02_totals_by_name", with_views(
    "SELECT t.ENTIDAD, NOM_ENT, MUN, NOM_MUN, " + ", ".join(f"t.{m} * q.R_{m} AS {m}" for m in SUMS) + f" FROM towns t LEFT JOIN {_ratio_sql('towns', 'ENTIDAD')} q USING (ENTIDAD) WHERE NOT is_total",
    "census_blocks", extra={**_views(), "fine": f"SELECT *, NOM_LOC IS NOT DISTINCT FROM '{CF.TOTAL_NAMES[2]}' AS is_total FROM pub WHERE ({BLOCK}) OR NOM_LOC = '{CF.TOTAL_NAMES[2]}'",
                            "towns": "SELECT x.ENTIDAD, NOM_ENT, x.MUN, NOM_MUN, false AS is_total, " + ", ".join(f"sum(x.{m}) * any_value(q.R_{m}) AS {m}" for m in SUMS)
                            + f" FROM fine x LEFT JOIN {_ratio_sql('fine', 'ENTIDAD, MUN')} q USING (ENTIDAD, MUN) WHERE NOT is_total GROUP BY ALL UNION ALL "
                            "SELECT ENTIDAD, NOM_ENT, MUN, NOM_MUN, true, " + ", ".join(SUMS) + f" FROM pub WHERE NOM_LOC = '{CF.TOTAL_NAMES[3]}'"}),
    rounding=r(4, *SUMS))
def r02_by_name(fx):
    return CF.municipal_by_name(published(fx), SUMS)
