"""Session defaults that the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    # Runtime re-planning: coalesce small shuffle partitions, split skewed ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name="kmerweave", master=None, **conf):
    """Builds (or reuses) a session. Cluster settings such as the number of
    shuffle partitions and ``spark.checkpoint.dir`` stay with the caller."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
