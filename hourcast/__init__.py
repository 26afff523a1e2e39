"""hourcast: Spark-native hourly time-series features, forecasting and monitoring.

Every operator is a function from DataFrame(s) to DataFrame built from
Catalyst expressions (windows, joins, aggregates); nothing collects data
rows to the driver.
"""

from hourcast.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
