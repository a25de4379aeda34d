"""quarry: demand-planning and project-valuation operators on Spark DataFrames.

Every operator is a function from DataFrames (plus column names and
parameters) to a DataFrame.  Nothing is collected to the driver; the
plans are left to Catalyst and AQE.

Sub-packages
    functions   column-expression helpers (safe division, haversine, normal CDF, seeded draws)
    sources     readers / writers with explicit schemas, driver-table fixtures
    operators   relational building blocks (cleaning, joins, aggregates, windows, reshape, stats, forecast, reconcile)
    plans       composite jobs (price/volume panel, costing, plan audit, valuation)
    streaming   incremental ingestion of scenario result files
    cases       registered queries with their DuckDB oracle SQL
"""

from quarry.session import get_spark  # noqa: F401

__all__ = ["get_spark"]
