"""SparkSession settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution splits skewed join partitions, turns small joins into
# broadcasts from measured sizes and coalesces tiny shuffle partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(
    app: str,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    checkpoint_dir: str | None = None,
    **conf: str,
) -> SparkSession:
    """Session with :data:`DEFAULTS`; leave ``master`` unset under spark-submit.

    On a cluster set ``shuffle_partitions`` to two or three times the number of
    executor cores (adaptive execution merges what is too small) and
    ``checkpoint_dir`` to a folder every executor can reach.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if checkpoint_dir:
        settings["spark.checkpoint.dir"] = checkpoint_dir
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
