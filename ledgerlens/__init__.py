"""ledgerlens: audit statistics over Spark DataFrames.

Every operator takes a DataFrame and returns a DataFrame. Work over rows is
expressed with built-in Spark SQL expressions, aggregations, joins and
windows so Catalyst can prune, push down and plan it; Python only touches
small result tables (p-values) or per-group sufficient statistics.
"""

__version__ = "0.1.0"
