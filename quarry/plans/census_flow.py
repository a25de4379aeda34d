"""Census reconciliation as one flow (R01-R04): published totals are rows of the block table itself.

A block file holds detail rows and, told apart by their locality name, the
published totals of block groups (AGEB), localities, municipalities and states.
One grouped scan takes the statistics of the blocks and all four kinds of totals
side by side; each coarser level sums the level below, so the chain is four
group-bys over shrinking tables without a join, for all states at once.  The
detail rows are read a second time for ``x * r - d`` with the state's factors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.reconcile import closing_check, level_factors, ratio_normalise, split_by_name
from quarry.session import broadcast_if_small

# Fixed values of the block files: names of the total rows from fine to coarse, blank codes.
TOTAL_NAMES = ("Total AGEB urbana", "Total de la localidad urbana", "Total del municipio", "Total de la entidad")
LEVELS = (("ENTIDAD", "MUN", "LOC", "AGEB"), ("ENTIDAD", "MUN", "LOC"), ("ENTIDAD", "MUN"), ("ENTIDAD",))
NO_AGEB, NO_NAME = "0000", "N/A"


def is_block() -> Column:
    return (F.col("MZA") != 0) & (F.col("AGEB") != NO_AGEB) & (F.col("LOC") != 0) & (F.col("MUN") != 0)


def state_factors(rows: DataFrame, sums: Sequence[str], means: Sequence[str] = (), ratio: str = "reference") -> DataFrame:
    """(ENTIDAD, r_m, d_m per measure): the chain from block groups to states."""
    measures = [*sums, *means]
    block = F.coalesce(is_block(), F.lit(False))
    aggs = [F.sum(F.when(block, 1).otherwise(0)).alias("n")]
    for m in measures:
        x = F.when(block, F.col(m))
        aggs += [F.sum(x).alias(f"sx_{m}"), F.sum(x).alias(f"c_{m}"), F.count(x).alias(f"k_{m}")]
        for i, name in enumerate(TOTAL_NAMES):
            t = F.when(F.col("NOM_LOC") == name, F.col(m))
            aggs += [F.sum(t).alias(f"P{i}_{m}"), F.count(t).alias(f"N{i}_{m}")]
    g = rows.groupBy(*LEVELS[0]).agg(*aggs)
    for i, keys in enumerate(LEVELS):
        if i:
            carried = [F.sum("n").alias("n")]
            for m in measures:
                c = F.col(f"c_{m}")
                carried += [F.sum(f"sx_{m}").alias(f"sx_{m}"), F.sum(c).alias(f"c_{m}"), F.sum(F.when(c.isNotNull(), F.col(f"k_{m}"))).alias(f"k_{m}")]
                carried += [F.sum(f"{p}{j}_{m}").alias(f"{p}{j}_{m}") for j in range(i, len(LEVELS)) for p in "PN"]
            g = g.groupBy(*keys).agg(*carried)
        cols = [*keys, "n"]
        for m in measures:
            mean = m in means
            published = F.try_divide(F.col(f"P{i}_{m}"), F.col(f"N{i}_{m}")) if mean else F.when(F.col(f"N{i}_{m}") > 0, F.col(f"P{i}_{m}"))
            r, d, given = level_factors(F.col("n"), F.col(f"sx_{m}"), F.col(f"c_{m}"), F.col(f"k_{m}"), published, mean, ratio)
            cols += [f"sx_{m}", given.alias(f"c_{m}"), F.when(d.isNotNull(), F.col("n")).alias(f"k_{m}"), r.alias(f"r_{m}"), d.alias(f"d_{m}")]
            cols += [f"{p}{j}_{m}" for j in range(i + 1, len(LEVELS)) for p in "PN"]
        g = g.select(*cols)
    return g.select("ENTIDAD", *[f"{f}_{m}" for m in measures for f in "rd"])


def locality_key() -> Column:
    """``MUN-LOC``, the composite key of locality names."""
    return F.concat_ws("-", F.col("MUN").cast("string"), F.col("LOC").cast("string"))


def area_names(rows: DataFrame, key: Column, name_col: str) -> DataFrame:
    """(ENTIDAD, area, name): one name per area and state, totals' names left out."""
    named = rows.filter(F.col(name_col).isNotNull() & ~F.col(name_col).isin(*TOTAL_NAMES))
    return named.groupBy("ENTIDAD", key.alias("area")).agg(F.max(name_col).alias("name"))


def name_areas(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """NOM_ENT by state, NOM_MUN by municipality, NOM_LOC by ``MUN-LOC``; ``N/A`` when the table names none."""
    out = blocks.drop("NOM_ENT", "NOM_MUN", "NOM_LOC")
    for col, key in (("NOM_ENT", F.col("ENTIDAD").cast("string")), ("NOM_MUN", F.col("MUN").cast("string")), ("NOM_LOC", locality_key())):
        names = broadcast_if_small(area_names(rows, key, col).withColumnRenamed("name", f"__{col}"))
        out = out.withColumn("area", key).join(names, ["ENTIDAD", "area"], "left").withColumn(col, F.coalesce(f"__{col}", F.lit(NO_NAME))).drop("area", f"__{col}")
    return out


def reconcile_published(rows: DataFrame, sums: Sequence[str], means: Sequence[str] = (), ratio: str = "reference") -> DataFrame:
    """R01 + R04: the block rows with reconciled measures and names; measures are null where the state has no total."""
    measures = [*sums, *means]
    factors = broadcast_if_small(state_factors(rows, sums, means, ratio))
    blocks = rows.filter(is_block()).join(factors, "ENTIDAD", "left")
    other = [c for c in rows.columns if c not in measures]
    done = blocks.select(*other, *[(F.col(m) * F.col(f"r_{m}") - F.col(f"d_{m}")).alias(m) for m in measures])
    return name_areas(done, rows)


def closing(rows: DataFrame, reconciled: DataFrame, measure: str = "POBTOT", tol: float = 1e-2) -> DataFrame:
    """Reconciled against published state totals."""
    totals = rows.filter(F.col("NOM_LOC") == TOTAL_NAMES[3]).groupBy("ENTIDAD").agg(F.sum(measure).alias(measure))
    return closing_check(reconciled, totals, ["ENTIDAD"], measure, tol)


def write_states(reconciled: DataFrame, path: str, fmt: str = "parquet") -> None:
    """All states in one write, a folder per state."""
    reconciled.write.partitionBy("ENTIDAD").mode("overwrite").format(fmt).option("header", True).save(path)


def municipal_by_name(rows: DataFrame, measures: Sequence[str]) -> DataFrame:
    """R02 in two steps: localities scaled to municipality totals, municipalities to state totals, told apart by name."""
    fine = rows.filter(is_block() | F.col("NOM_LOC").isin(*TOTAL_NAMES[2:]))
    keys = ["ENTIDAD", "NOM_ENT", "MUN", "NOM_MUN"]
    sums = [F.sum(m).alias(m) for m in measures]
    local = split_by_name(fine, "NOM_LOC", TOTAL_NAMES[2]).groupBy(*keys, "LOC", "NOM_LOC", "is_total").agg(*sums)
    towns = ratio_normalise(local, ["ENTIDAD", "MUN"], measures).groupBy(*keys).agg(*sums).withColumn("is_total", F.lit(False))
    states = fine.filter(F.col("NOM_LOC") == TOTAL_NAMES[3]).select(*keys, *measures, F.lit(True).alias("is_total"))
    return ratio_normalise(towns.unionByName(states), ["ENTIDAD"], measures)
