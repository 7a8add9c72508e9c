"""SparkSession factory with the settings every job in this package expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "foliospark", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; explicit ``conf`` wins over the defaults.

    On a cluster leave ``master`` unset and let spark-submit decide. Shuffle
    parallelism is only pinned for local masters; elsewhere AQE coalesces from
    whatever ``spark.sql.shuffle.partitions`` the cluster configures.
    """
    builder = SparkSession.builder.appName(app)
    settings = dict(DEFAULTS)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            settings["spark.sql.shuffle.partitions"] = os.environ.get("FOLIOSPARK_PARTITIONS", "8")
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
