"""The session that tests, the bench and small tools use; a cluster brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def share_code(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver did; a cluster gets it by ``--py-files``."""
    known = spark.sparkContext.environment
    paths = [x for x in known.get("PYTHONPATH", "").split(os.pathsep) if x]
    if _ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "factloom", memory: str = "8g") -> SparkSession:
    """A local session with UTC times, Arrow exchange and adaptive execution."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    share_code(spark)
    return spark
