"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Hash joins without a sort wherever every partition of the build side is this small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128m",
    "spark.sql.session.timeZone": "UTC",
    # Call sites in error messages double the time it takes to build a plan in Python.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str, master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with adaptive execution on.

    On a cluster leave ``master`` to spark-submit and give ``shuffle_partitions`` as an
    upper bound (several thousand for 100 TB): adaptive execution merges what is small.
    """
    builder = SparkSession.builder.appName(app)
    settings = {**ADAPTIVE, **conf}
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
