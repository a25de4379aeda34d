"""Freight lanes and site cost tables: V06, V08, V09, V10, V11 with J09, J13-J15, U06, O02, A14.

Sizes: ``sites`` (plants, one row each) and ``periods`` are small dimension
tables; markets / locations grow with the data.  Every product in this
module pairs a growing table with one of those two, whose rows are counted
first and travel in blocks (``attach_bounded``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.exprs import capacity_policy, haversine, safe_div
from quarry.session import broadcast_if_small

# Trip size (L), fuel and gasoline densities (kg/L) of the freight rate.
PIPE_LITRES = 20000.0
FUEL_DENSITY = 0.8508
GASOLINE_DENSITY = 0.7489

# Cost escalators per period.
FIXED_ESCALATOR = 1.05
VARIABLE_ESCALATOR = 1.09
TAX = 0.35


def base_rate(mxn_per_ton_km: float) -> float:
    """Cost per km-litre: per ton-km rate x tons per trip / litres per trip."""
    tons_per_trip = PIPE_LITRES * ((FUEL_DENSITY + GASOLINE_DENSITY) / 2 / 1000)
    return mxn_per_ton_km * tons_per_trip / PIPE_LITRES


BLOCK_ROWS = 1000  # rows of the small side that travel as one array
SALTS = 32


def attach_bounded(df: DataFrame, small: DataFrame, name: str = "_b", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Expand each row of ``df`` by every row of a small table (periods, sites, cases).

    The small table's rows are counted first.  Up to ``block_rows`` they are
    folded into one array by a scalar subquery and exploded next to each row.
    A larger table is cut into blocks of about that size; each row of ``df``
    meets every block by an equi-join on (block, salt), so no task holds the
    whole table and no size is refused.
    """
    cols = small.columns
    n = small.count()
    as_struct = F.struct(*cols)
    if n <= block_rows:
        arr = small.agg(F.collect_list(as_struct)).scalar()
        ex = df.select(*df.columns, F.explode(arr).alias(name))
    else:
        blocks = -(-n // block_rows)
        packed = small.groupBy(F.pmod(F.xxhash64(*cols), F.lit(blocks)).alias("_block")).agg(F.collect_list(as_struct).alias("_rows")) \
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")) \
            .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        ex = left.join(packed, ["_block", "_salt"]).select(*df.columns, F.explode("_rows").alias(name))
    return ex.select(*df.columns, *[F.col(f"{name}.{c}").alias(c) for c in cols])


# ------------------------------------------------------------------ J09
def lane_distances(sites: DataFrame, markets: DataFrame) -> DataFrame:
    """Great-circle km from every site (source) to every market (destination).

    ``sites`` / ``markets``: (state, name, lat, lon).  The site list is the
    bounded side (plants), attached to the market rows by broadcast.
    """
    s = sites.select(F.col("state").alias("source_state"), F.col("name").alias("source"),
                     F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    m = markets.select(F.col("state").alias("destination_state"), F.col("name").alias("destination"),
                       F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"))
    x = attach_bounded(m, s, "_site")
    return x.select("source_state", "source", "destination_state", "destination",
                    haversine("s_lon", "s_lat", "d_lon", "d_lat").alias("kms"))


# ------------------------------------------------------------------ J14 / J15 / V06
def in_states(locations: DataFrame, overrides: DataFrame, state: str = "state") -> DataFrame:
    """Locations whose state appears in an override table (left semi join)."""
    return locations.join(F.broadcast(overrides.select(F.col("state").alias(state)).distinct()), state, "left_semi")


def freight_costs(lanes: DataFrame, rate: float, pair_rates: DataFrame | None = None,
                  state_rates: DataFrame | None = None, locations: DataFrame | None = None,
                  sites: DataFrame | None = None) -> DataFrame:
    """Rate per lane with overrides, freight = kms x rate.

    ``pair_rates(source_state, destination_state, rate)`` apply to directed state pairs.
    ``state_rates(state, rate)`` apply where an end lies in the state and the
    rate is still the base; when both ends qualify, the end that comes first
    wins: locations before sites that are no location, then by name and state.
    The order is a comparison of (group, name, state) inside the row, so no
    location is numbered or broadcast; the rates have one row per state.
    """
    x = lanes.withColumn("freightxkms", F.lit(rate))
    if pair_rates is not None:
        pr = pair_rates.select("source_state", "destination_state", F.col("rate").alias("_pr"))
        x = x.join(F.broadcast(pr), ["source_state", "destination_state"], "left") \
            .withColumn("freightxkms", F.coalesce(F.col("_pr"), F.col("freightxkms"))).drop("_pr")
    if state_rates is not None:
        src = state_rates.select(F.col("state").alias("source_state"), F.col("rate").alias("_sr"))
        dst = state_rates.select(F.col("state").alias("destination_state"), F.col("rate").alias("_dr"))
        x = x.join(F.broadcast(src), "source_state", "left").join(F.broadcast(dst), "destination_state", "left")
        if locations is not None and sites is not None:
            only = sites.select("state", "name").distinct().join(locations.select("state", "name"), ["state", "name"], "left_anti") \
                .select(F.col("state").alias("source_state"), F.col("name").alias("source"), F.lit(1).alias("_sg"))
            x = x.join(broadcast_if_small(only), ["source_state", "source"], "left")
        else:
            x = x.withColumn("_sg", F.lit(0))
        first = F.struct(F.coalesce("_sg", F.lit(0)), F.col("source"), F.col("source_state")) \
            <= F.struct(F.lit(0), F.col("destination"), F.col("destination_state"))
        pick = F.when(F.col("_sr").isNull(), F.col("_dr")).when(F.col("_dr").isNull(), F.col("_sr")) \
            .when(first, F.col("_sr")).otherwise(F.col("_dr"))
        untouched = F.col("freightxkms") == F.lit(rate)
        x = x.withColumn("freightxkms", F.when(untouched & pick.isNotNull(), pick).otherwise(F.col("freightxkms"))) \
            .drop("_sr", "_dr", "_sg")
    return x.select("source_state", "source", "destination_state", "destination", "kms", "freightxkms",
                    (F.col("kms") * F.col("freightxkms")).alias("freight"))


# ------------------------------------------------------------------ V08 / J13 / U06
def site_costs(sites: DataFrame, periods: DataFrame, fixed_base: float, fixed_ratio: float,
               variable_base: float, variable_ratio: float, storage_base: float, storage_ratio: float,
               safety_base: float, safety_ratio: float) -> DataFrame:
    """V08 (J13, U06, S10 rows, P11): site cost table by period.

    ``sites(state, mun, lat, lon, daily_capacity, profile)``; imports carry an
    infinite capacity and profile 0.  Costs are escalated for T >= 1; NULL /
    NaN -> 0, +inf -> 1e25 (P11).  Imports: inf x 0 = NaN -> 0 fixed cost.
    """
    cap = F.col("daily_capacity")
    prof = F.col("profile")
    is_imp = F.col("mun") == "Imports"
    fixed = F.when(is_imp & (prof == 0), F.lit(float("nan"))).otherwise(cap * F.lit(fixed_ratio) * prof * 30) \
        + F.lit(fixed_base)
    variable = F.when(is_imp, F.lit(0.0)).otherwise(
        F.lit(variable_base) + F.lit(variable_ratio) * prof * F.exp(-cap / 1e7))
    storage = cap * F.lit(storage_ratio) + F.lit(storage_base)
    safety = cap * F.lit(safety_ratio) + F.lit(safety_base)
    base = sites.select("state", "mun", "lat", "lon", "daily_capacity", fixed.alias("fixed"),
                        variable.alias("variable"), storage.alias("storage"), safety.alias("safety_inventory"))
    x = attach_bounded(base, periods.select("T", "days"), "_p")
    t = F.col("T")
    out = x.select(
        "state", "mun", "lat", "lon", "daily_capacity",
        (F.col("fixed") * F.pow(F.lit(FIXED_ESCALATOR), t)).alias("fixed"),
        (F.col("variable") * F.pow(F.lit(VARIABLE_ESCALATOR), t)).alias("variable"),
        "storage", "safety_inventory", "T", "days",
        (F.col("daily_capacity") * F.col("days")).alias("capacity"))
    num = ["lat", "lon", "daily_capacity", "fixed", "variable", "storage", "safety_inventory", "capacity"]
    return out.select(*[capacity_policy(c).alias(c) if c in num else F.col(c) for c in out.columns])


# ------------------------------------------------------------------ V09 / O02 / A14
MARKET = ["T", "state", "market"]


def market_sourcing(demand: DataFrame, lanes: DataFrame, inflation: float = 0.06,
                    imports_discount: float = 0.1, sources: DataFrame | None = None) -> DataFrame:
    """Per (T, state, market, source) demand, price and inflated lane cost, imports priced from the market.

    ``demand(T, state, market, demand, price)``; lanes are matched on the
    destination's state and name, so markets of one name in two states stay
    apart.  A lane with a missing cost -> 30 + 10 x max lane cost; with
    ``sources`` (one row per plant), a plant without any lane to the market ->
    2 x max lane cost.  The largest lane cost is one aggregate.  Lanes are dealt
    out by market: a broadcast demand would leave them, times the periods, in
    the few tasks that read the markets.
    """
    mx = lanes.agg(F.max("freight")).scalar()
    ln = lanes.select("source", F.col("destination_state").alias("state"), F.col("destination").alias("market"), "freight",
                      F.lit(True).alias("_lane"))
    if sources is None:
        tasks = int(demand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        j = demand.join(ln.repartition(tasks, "state", "market"), ["state", "market"])
    else:
        cand = attach_bounded(demand, sources.select(F.col("name").alias("source")), "_src")
        j = cand.join(ln, ["state", "market", "source"], "left")
    cost = F.when(F.col("_lane").isNull(), F.lit(2.0) * mx).otherwise(
        F.coalesce(F.col("freight"), F.lit(30.0) + F.lit(10.0) * mx)) * F.pow(F.lit(1.0 + inflation), F.col("T"))
    plants = j.select(*MARKET, "source", "demand", "price", cost.alias("cost"))
    imports = demand.select(*MARKET, F.lit("Imports").alias("source"), "demand", "price",
                            (F.col("price") * F.lit(1.0 - imports_discount)).alias("cost"))
    return plants.unionByName(imports)


def cheapest_source(sourcing: DataFrame) -> DataFrame:
    """Cheapest source per (T, state, market); ties broken by source name."""
    return sourcing.groupBy(*MARKET).agg(
        F.min_by(F.struct("cost", "source"), F.struct("cost", "source")).alias("_b")).select(
        *MARKET, F.col("_b.source").alias("source"), F.col("_b.cost").alias("cost"))


def lane_summary(sourcing: DataFrame) -> DataFrame:
    """Min, mean, median, max sourcing cost over sources per (T, state, market)."""
    return sourcing.groupBy(*MARKET).agg(
        F.min("cost").alias("freight_min"), F.avg("cost").alias("freight_mean"),
        F.median("cost").alias("freight_median"), F.max("cost").alias("freight_max"))


# ------------------------------------------------------------------ V10
def market_margin(sales: DataFrame, sourcing: DataFrame, demand: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per (T, state, market, source) freight cost, revenue and margin; unmet demand per market.

    ``sales(T, state, market, source, sales)``, ``demand(T, state, market,
    demand, price)``.  Every sale and every market has its row: revenue takes
    the market's price; a sale without a lane has NULL freight and margin; a
    market without sales leaves its whole demand unmet.
    """
    lane = sourcing.select(*MARKET, "source", "cost")
    price = demand.select(*MARKET, "price")
    m = sales.join(lane, [*MARKET, "source"], "left").join(price, MARKET, "left").select(
        *MARKET, "source", "sales", (F.col("sales") * F.col("cost")).alias("freight"),
        (F.col("sales") * F.col("price")).alias("revenue"))
    m = m.withColumn("margin", F.col("revenue") - F.col("freight"))
    sold = sales.groupBy(*MARKET).agg(F.sum("sales").alias("sold"))
    unmet = demand.select(*MARKET, "demand").join(sold, MARKET, "left") \
        .select(*MARKET, (F.col("demand") - F.coalesce("sold", F.lit(0.0))).alias("unmet"))
    return m, unmet


# ------------------------------------------------------------------ V11
def project_costs(projects: DataFrame) -> DataFrame:
    """Per plant: INITIAL and STRATEGIC capex and the expansion increment (one conditional aggregation)."""
    t = F.col("type")
    return projects.groupBy(F.col("mun").alias("plant")).agg(
        F.coalesce(F.sum(F.when(t == "INITIAL", F.col("capex"))), F.lit(0.0)).alias("capex_initial"),
        F.coalesce(F.sum(F.when(t == "STRATEGIC", F.col("capex"))), F.lit(0.0)).alias("capex_strategic"),
        F.coalesce(F.max(F.when(t == "STRATEGIC", F.col("increment"))), F.lit(0.0)).alias("increment"))


DEFAULT_DECISIONS = {"STATE": 1, "SWITCH": 0, "LAYOFF": 0, "a0": 1, "c0": 0, "INITIAL_CAPEX": 0,
                     "STRATEGIC_CAPEX": 0}


def plant_waterfall(site_cost: DataFrame, margins: DataFrame, decisions: DataFrame | None = None,
                    projects: DataFrame | None = None, min_months: float = 3.0, capex_years: float = 20.0,
                    annual: bool = True) -> DataFrame:
    """Plant result table per (T, plant).

    costs = switch cost (the site's safety inventory) x SWITCH + FIXED x LAYOFF x months (/12 if annual)
            + FIXED x STATE + VARIABLE x production;
    ebitda = revenue - costs - freight; capex = initial capex x INITIAL_CAPEX + strategic capex x STRATEGIC_CAPEX;
    dep = (a0 x initial capex + c0 x strategic capex) / years (/12 if monthly), a0 / c0 = opening
    availability / expansion; nopat = 0.65 (ebitda - dep); fcf = nopat + dep - capex;
    utilisation = production / capacity; expansion capacity = capacity x max(0, increment - 1).
    ``decisions(T, plant, STATE, SWITCH, LAYOFF, a0, c0, INITIAL_CAPEX, STRATEGIC_CAPEX)`` default to a
    running plant with no investment; ``projects(mun, type, capex, increment)``.
    """
    roll = margins.groupBy("T", F.col("source").alias("plant")).agg(
        F.sum("sales").alias("production"), F.sum("revenue").alias("revenues"), F.sum("freight").alias("freight"))
    sc = site_cost.select("T", F.col("mun").alias("plant"), "fixed", "variable", "capacity",
                          F.col("safety_inventory").alias("switch_unit"))
    j = sc.join(roll, ["T", "plant"], "left").na.fill(0.0, subset=["production", "revenues", "freight"])
    if decisions is not None:
        j = j.join(decisions, ["T", "plant"], "left")
        j = j.na.fill({k: v for k, v in DEFAULT_DECISIONS.items()})
    else:
        j = j.select("*", *[F.lit(v).alias(k) for k, v in DEFAULT_DECISIONS.items()])
    if projects is not None:
        j = j.join(broadcast_if_small(project_costs(projects)), "plant", "left") \
            .na.fill(0.0, subset=["capex_initial", "capex_strategic", "increment"])
    else:
        j = j.select("*", F.lit(0.0).alias("capex_initial"), F.lit(0.0).alias("capex_strategic"),
                     F.lit(0.0).alias("increment"))
    col = F.col
    months = min_months / 12.0 if annual else min_months
    costs = (col("switch_unit") * col("SWITCH") + col("fixed") * col("LAYOFF") * F.lit(months)
             + col("fixed") * col("STATE") + col("variable") * col("production"))
    capex = col("capex_initial") * col("INITIAL_CAPEX") + col("capex_strategic") * col("STRATEGIC_CAPEX")
    dep = (col("a0") * col("capex_initial") + col("c0") * col("capex_strategic")) / \
        F.lit(capex_years if annual else capex_years * 12)
    x = j.select("T", "plant", "capacity", "production", "revenues", "freight", capex.alias("capex"),
                 costs.alias("costs"), dep.alias("depreciation"),
                 (col("capacity") * F.greatest(F.lit(0.0), col("increment") - 1)).alias("expansion_capacity"))
    x = x.withColumn("ebitda", col("revenues") - col("costs") - col("freight"))
    nopat = (col("ebitda") - col("depreciation")) * F.lit(1 - TAX)
    return x.select("*", nopat.alias("nopat")).select(
        "*", (col("nopat") + col("depreciation") - col("capex")).alias("fcf_wo_nwc"),
        safe_div(col("production"), col("capacity")).alias("utilization"))


def markets_by_period(panel: DataFrame, periods: DataFrame, keys: Sequence[str] = ("state", "mun")) -> DataFrame:
    """DEMAND / PRICE per (T, state, market): annual litres and volume-weighted price (A09 + J12)."""
    g = panel.groupBy(F.year("date").cast("int").alias("date"), *keys).agg(
        F.sum("litres").alias("demand"), safe_div(F.sum(F.col("price") * F.col("litres")), F.sum("litres")).alias("price"))
    g = g.join(F.broadcast(periods.select("T", "date")), "date")
    return g.select("T", F.col(keys[0]).alias("state"), F.col(keys[1]).alias("market"), "demand", "price")
