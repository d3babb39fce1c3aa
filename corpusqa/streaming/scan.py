"""Documents that keep arriving.

Every per-document operator is a projection with a generator: no shuffle, no
state, no watermark.  It therefore runs on ``readStream`` as it stands; this
module only names the source, the sink and where progress is kept.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_documents(spark: SparkSession, folder: str, schema: StructType | str,
                   source: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of document files that land in a folder."""
    reader = spark.readStream.format(source).schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def progress_folder(spark: SparkSession, name: str) -> str:
    """Where a stream keeps its progress: in the folder the cluster names."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir is not set; pass a checkpoint folder")
    return posixpath.join(root, "streams", name)


def write_available(found: DataFrame, path: str, name: str, checkpoint: str | None = None,
                    partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    """Write all that has arrived, then stop; the next call goes on from there."""
    writer = (found.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation",
                      checkpoint or progress_folder(found.sparkSession, name))
              .trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start(path)
