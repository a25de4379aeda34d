"""Projection, filter and cleaning operators P01-P25.

Every multi-column operator builds ONE ``select`` (never a loop of
``withColumn``), so 222 measure columns stay a single projection that
Catalyst collapses into the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import c, guarded_ratio, safe_div
from quarry.session import broadcast_if_small

# Sentinel texts used for suppressed / unavailable census cells.
SENTINELS = ("*", "N/D", "N/A")

# Spanish month abbreviations used in price-sheet headers.
MONTHS = ("ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEP", "OCT", "NOV", "DIC")

# Barrel -> litre and thousand-barrel -> barrel factors.
LITRES_PER_BARREL = 158.98730272810
BARRELS_PER_THOUSAND = 1e3

# Accented capitals and their plain forms.
ACCENTED = "ÁÉÍÓÚÜÑ"
PLAIN = "AEIOUUN"


def _project(df: DataFrame, repl: Mapping[str, Column]) -> DataFrame:
    return df.select(*[repl[x].alias(x) if x in repl else F.col(x) for x in df.columns])


# ------------------------------------------------------------------ P01 / P02
def clean_sentinels(df: DataFrame, cols: Iterable[str], sentinels: Sequence[str] = SENTINELS,
                    strict: bool = False) -> DataFrame:
    """Sentinel text -> 0, other text -> double (NULL when unparsable); ``strict`` fills NULL with 0."""
    def conv(x: str) -> Column:
        v = F.when(F.trim(F.col(x)).isin(*sentinels), F.lit(0.0)).otherwise(
            F.expr(f"try_cast(`{x}` AS DOUBLE)"))
        return F.coalesce(v, F.lit(0.0)) if strict else v
    return _project(df, {x: conv(x) for x in cols})


def label_missing(df: DataFrame, cols: Iterable[str], sentinels: Sequence[str] = SENTINELS,
                  fill: str = "N/A") -> DataFrame:
    """Missing or sentinel labels -> 'N/A'."""
    return _project(df, {x: F.when(F.col(x).isNull() | F.trim(F.col(x)).isin(*sentinels), F.lit(fill))
                         .otherwise(F.col(x)) for x in cols})


# ------------------------------------------------------------------ P03
def keep_strata(df: DataFrame, col: str, keep: Sequence[int] = (0, 99)) -> DataFrame:
    """Blank / missing stratum -> 0, keep only the listed strata."""
    v = F.coalesce(F.expr(f"try_cast(nullif(trim(`{col}`), '') AS INT)"), F.lit(0))
    return _project(df, {col: v}).filter(F.col(col).isin(*keep))


# ------------------------------------------------------------------ P04 / P05
def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """P04."""
    return df.withColumnsRenamed(dict(mapping))


def normalise_keys(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Numeric-text keys through int and back (drops leading zeros)."""
    return _project(df, {x: F.expr(f"try_cast(`{x}` AS INT)").cast("string") for x in cols})


# ------------------------------------------------------------------ P06
def parse_int_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Safe integer parse, rows where any key fails are dropped."""
    out = _project(df, {x: F.expr(f"try_cast(trim(`{x}`) AS INT)") for x in cols})
    return out.na.drop(subset=list(cols))


# ------------------------------------------------------------------ P07
def detail_rows(df: DataFrame, level_cols: Sequence[str], block_col: str | None = None,
                blank_block: str = "0000", complete: Sequence[str] | None = None) -> DataFrame:
    """All level codes > 0, block code not blank; then drop incomplete rows."""
    cond = F.lit(True)
    for x in level_cols:
        cond = cond & (F.col(x) > 0)
    if block_col:
        cond = cond & (F.col(block_col) != blank_block)
    return df.filter(cond).na.drop("any", subset=list(complete) if complete else None)


# ------------------------------------------------------------------ P08
def text_filter(df: DataFrame, col: str, regex: str | None = None, contains: str | None = None,
                not_contains: str | None = None) -> DataFrame:
    """Regex alternation, substring and negated substring."""
    cond = F.lit(True)
    if regex:
        cond = cond & F.col(col).rlike(regex)
    if contains:
        cond = cond & F.col(col).contains(contains)
    if not_contains:
        cond = cond & ~F.col(col).contains(not_contains)
    return df.filter(cond)


# ------------------------------------------------------------------ P09 / P10
def socio_indicators(df: DataFrame) -> DataFrame:
    """The 15 socio-economic ratios and differences."""
    col = F.col
    pea = col("P_18YMAS") - col("P_60YMAS")
    pnea = col("POBTOT") - pea
    houses = col("TVIVPARHAB")
    s_serv = houses - col("VPH_C_SERV")
    s_inter = houses - col("VPH_INTER")
    return df.select(
        "*",
        pea.alias("PEA"), pnea.alias("PNEA"),
        (col("POB15_64") + col("POB65_MAS")).alias("POBEST"),
        safe_div(pnea, pea).alias("CES"),
        safe_div(col("PDER_SS"), col("POBTOT")).alias("SST"),
        s_serv.alias("VPH_S_SERV"),
        safe_div(s_serv, houses).alias("VSB"),
        safe_div(col("VPH_S_ELEC"), houses).alias("VSE"),
        safe_div(col("VPH_AGUAFV"), houses).alias("VSA"),
        safe_div(col("VPH_NODREN"), houses).alias("VSD"),
        s_inter.alias("VPH_S_INTER"),
        safe_div(s_inter, houses).alias("VSI"),
        safe_div(col("VPH_PISOTI"), houses).alias("PDT"),
        col("GRAPROES").alias("GES"),
        col("PROM_OCUP").alias("DENS_HAB"))


def carry_weighted(df: DataFrame, out: str, num: str, den: str) -> DataFrame:
    """P10 / A13 tail: guarded ratio of two summed columns (inf / NaN -> 0)."""
    return _project(df, {out: guarded_ratio(num, den)}) if out in df.columns else \
        df.withColumn(out, guarded_ratio(num, den))


# ------------------------------------------------------------------ P12 / P13 / P14 / P15
def barrels_to_litres(x: Column) -> Column:
    """P12."""
    return x * F.lit(LITRES_PER_BARREL)


def month_number(x: Column) -> Column:
    """Spanish month abbreviation -> 1..12 (NULL when unknown)."""
    m = F.create_map(*[v for i, name in enumerate(MONTHS) for v in (F.lit(name), F.lit(i + 1))])
    return m[F.upper(F.trim(x))]


def parse_dmy(x: Column) -> Column:
    """dd/MM/yyyy text -> date (NULL when malformed)."""
    return F.to_date(F.try_to_timestamp(x, F.lit("dd/MM/yyyy")))


def date_parts(df: DataFrame, col: str) -> DataFrame:
    """Year, month, month and year period starts, weekday (Monday = 0)."""
    d = F.col(col).cast("date")
    return df.select("*", F.year(d).alias("year"), F.month(d).alias("month"),
                     F.trunc(d, "MM").alias("period_m"), F.trunc(d, "YYYY").alias("period_y"),
                     F.weekday(d).alias("weekday"))


# ------------------------------------------------------------------ P19 / P20 / P21 / P22
CLASS_LEVELS = (("SECTOR", 2), ("SUBSECTOR", 3), ("RAMA", 4), ("SUBRAMA", 5), ("CLASE", 6))


def class_levels(df: DataFrame, code: str, catalogue: DataFrame, levels=CLASS_LEVELS) -> DataFrame:
    """Title of each code prefix (2..6 characters) from one catalogue table.

    The catalogue (code, title) is a dimension: joined once per level, each a
    broadcast-size lookup; a missing title stays NULL.
    """
    out = df
    for name, n in levels:
        cat = catalogue.select(F.col("code").alias(f"_k{n}"), F.col("title").alias(name))
        out = out.withColumn(f"_k{n}", F.substring(code, 1, n)).join(broadcast_if_small(cat), f"_k{n}", "left") \
            .drop(f"_k{n}")
    return out


def band_upper(x: ColumnOrName, more_word: str = "más", more_value: int = 500) -> Column:
    """P20: largest integer in a size-band label, the word for 'more' read as ``more_value``."""
    t = F.replace(c(x), F.lit(more_word), F.lit(str(more_value)))
    nums = F.regexp_extract_all(t, F.lit(r"(\d+)"), 1)
    return F.array_max(F.transform(nums, lambda v: v.cast("int")))


def plain_upper(x: ColumnOrName, space: str = "_") -> Column:
    """Upper case, accents stripped, spaces replaced."""
    u = F.upper(c(x))
    return F.replace(F.translate(u, ACCENTED, PLAIN), F.lit(" "), F.lit(space))


def prefix_label(label: ColumnOrName, cls: ColumnOrName, when_class: str, prefix: str) -> Column:
    """``prefix - label`` for rows of a given class."""
    return F.when(c(cls) == when_class, F.concat_ws(" - ", F.lit(prefix), c(label))).otherwise(c(label))


# ------------------------------------------------------------------ P23
def last_percentage(text: ColumnOrName, reference_pattern: bool = False) -> Column:
    """Last percentage in a text as a fraction, -1 when none.

    ``reference_pattern`` keeps one digit before the point (``12.5%`` -> 0.025).
    """
    pat = r"(\d\.\d*)%" if reference_pattern else r"(\d+(?:\.\d*)?)%"
    found = F.regexp_extract_all(c(text), F.lit(pat), 1)
    last = F.when(F.size(found) > 0, F.element_at(found, -1))
    return F.coalesce(last.cast("double") / 100.0, F.lit(-1.0))


# ------------------------------------------------------------------ P24 / P25
def flag_ge(a: ColumnOrName, b: ColumnOrName) -> Column:
    """P24."""
    return (c(a) >= c(b)).cast("int")


ColumnOrName = Column | str
