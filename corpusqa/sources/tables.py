"""Tables that already hold texts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``, a file or a directory of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Session setting: the number of partitions that ``spread`` deals tables to. Unset: as the files are split.
SPREAD = "spark.corpusqa.spread"


def spread(df: DataFrame) -> DataFrame:
    """Deal a table that Spark cannot split to more tasks, where the session asks for it.

    The test tables are one file with one row group each. A large corpus comes in enough
    splits; its session leaves ``SPREAD`` unset and nothing is moved.
    """
    parts = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(parts)) if parts else df


def scratch_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Only on a single machine, where every folder is shared, does a temporary one stand in for it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusqa-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet into the scratch folder and read back: computed once, however often it is
    used, and an executor that is lost later costs no more than reading the files again."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/corpusqa-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
