"""blockyard: order-flow, stock and telemetry analytics on Spark DataFrames.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a column
function ``Column -> Column``) built from Spark SQL built-ins, so Catalyst
plans it, pushes filters and projections into the parquet scans, and
whole-stage codegen runs it on the JVM.
"""

__version__ = "0.1.0"
