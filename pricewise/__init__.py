"""pricewise: PySpark-native cleaning, profiling, modelling and time-series
operators for marketplace listings and daily price series.

Every operator takes and returns ``pyspark.sql.DataFrame`` objects and is
expressed with built-in Spark SQL functions, aggregates and windows. Python
code runs inside tasks only where Spark has no built-in (per-partition running
sums, small per-series solves, tree building), and only small fitted
statistics (k x k Gram matrices, quantile edges, category levels) are ever
brought to the driver.
"""

from pricewise.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["build_session", "checkpoint_dir"]
