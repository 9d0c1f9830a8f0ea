"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", app: str = "choicemill", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A session with the settings the library relies on; on a cluster, use the cluster's own."""
    return (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for written stages: the one the session names.

    Only a local session may leave it out, and then uses a folder in its warehouse; a cluster session
    without the setting is an error, since executors on other machines could not read what is written.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/choicemill-{spark.sparkContext.applicationId}"
