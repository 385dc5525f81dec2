"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# AQE does the size-checked work at run time: it turns a join into a broadcast
# only when the measured side is small and splits hot partitions otherwise.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot partition even where that costs a further shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
# Fixed when a session starts. Call sites in error texts cost a stack walk for
# every expression that is built.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def report_session(app_name: str = "tallyboard", **extra: str) -> SparkSession:
    """A session with the settings above; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **START_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that somebody else made."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data, which every executor must see.

    It is the one the cluster names in ``spark.checkpoint.dir``; where none is
    named, one below the warehouse, which a cluster shares as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/intermediate").rstrip("/")


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared checkpoint folder and read it back."""
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint(eager=True)
