"""Session settings the jobs are tuned for."""

from pyspark.sql import SparkSession

# Adaptive execution picks the number of shuffle partitions, turns joins whose side proves
# small into broadcast joins, and splits partitions that hold a hot key.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Tables that are cut by person serve joins by person and day, or by person and visit, as they are.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def local_session(app_name="ehrseq", cores="*", shuffle_partitions=8, **extra):
    """A session on this machine, for tests and trials. On a cluster use the given session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    options = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "8g",
        # Recording the call site of every column costs a quarter of the planning time.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
