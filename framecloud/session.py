"""Runtime settings the plans in this package are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins on (frame, pixel) of two sides that both lie by frame need no exchange.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # A kept table is laid by frame already; adaptive planning would forget that.
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "false",
    # Samples keep up to a few thousand rows per frame; let the early limit apply to them.
    "spark.sql.optimizer.windowGroupLimitThreshold": "8192",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
