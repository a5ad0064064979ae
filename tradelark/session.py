"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime SQL settings. Each one is about plan quality, never about results.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split an oversized join partition even when the aggregate behind it could
    # have reused the join's partitioning: one more exchange beats one giant task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sets and medians aggregate in a hash table up to this many groups per task
    # before they fall back to sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    # Filter the large side of a shuffled join by the keys of the small side.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}

# Settings that only take effect before the first query of a session.
START_SETTINGS = {
    "spark.ui.enabled": "false",
    # Do not record the Python call site of every expression: building a large plan
    # takes about half the time without it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def apply_runtime_settings(spark: SparkSession) -> SparkSession:
    """Put the settings above on a session that somebody else created, but for those it chose itself."""
    chosen = spark.conf.getAll
    for key, value in RUNTIME_SETTINGS.items():
        if key not in chosen:
            spark.conf.set(key, value)
    return spark


def build_session(
    app: str = "tradelark",
    *,
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session for jobs started from this package's command line."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    settings = {**START_SETTINGS, **RUNTIME_SETTINGS, **(extra or {})}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
