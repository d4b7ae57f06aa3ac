"""shelfcast: retail sales analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns DataFrames; planning and
execution are left to Catalyst, AQE and the Spark runtime.  Small scalars
(detected column roles, fill values, series lengths) are the only values that
travel to the driver.
"""

from shelfcast.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
