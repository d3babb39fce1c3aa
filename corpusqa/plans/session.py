"""Session settings the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from corpusqa.sources.tables import SPREAD

# Names and values are Spark's own; a cluster's submit settings win over these.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Call sites of single column expressions are of no use here, and slow to record.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g",
                  app: str = "corpusqa", **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.driver.memory", os.environ.get("CORPUSQA_DRIVER_MEMORY", memory))
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config(SPREAD, str(cores if str(cores).isdigit() else partitions)))
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
