"""seriesspark: Spark-native time-series analytics.

Plain ``DataFrame -> DataFrame`` functions. Nothing here collects data to the
driver; every operator is a lazy Spark plan.
"""

from seriesspark.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
__version__ = "0.1.0"
