"""kitlend: lending and visits analytics as Spark DataFrame jobs.

Every operator takes a ``Lending`` (the eight tables as lazy DataFrames) and
returns a DataFrame; ``kitlend.plans.catalog`` registers the named queries
with their DuckDB oracle SQL.
"""

__version__ = "0.1.0"
