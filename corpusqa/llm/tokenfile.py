"""Operator 9: token ids as flat binary files with 64-bit document offsets.

A data set is a folder of parts in ascending doc_id order. A part is three flat files that can be
memory-mapped:

* ``part-<n>-<attempt>.ids``: token ids, little-endian unsigned 16-bit if the vocabulary fits, else 32-bit;
* ``part-<n>-<attempt>.idx``: 64-bit offsets, one more than documents, counted from the part's first id;
* ``part-<n>-<attempt>.doc``: 64-bit document ids (the smallest integer stands for null).

``manifest`` (Parquet, one row a part) names the files of the attempt that counts and the part's first
place in the whole: prefix sums over the parts' totals. It is written after the parts, so what failed attempts
left is never read.

The documents are range-partitioned by doc_id once; that is the only shuffle. Parts are written by the tasks
through ``pyarrow.fs``, so the folder may be any store it knows; a local one is memory-mapped for reading.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusqa.llm.shared import lean, plain_path, shared_folder, small_batches, store
from corpusqa.llm.tokens import encoded

NO_ID = np.iinfo(np.int64).min
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_PART = "part int, file string, n_docs long, n_ids long"


def write(docs: DataFrame, folder: str, tokenizer: str, kind: str = "byte", end_id: int = 2, width: int = 2,
          parts: int | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into ``folder`` and returns the manifest as it was written.

    ``width`` is the bytes of an id (2 or 4); an id that does not fit raises an error. ``parts`` defaults to
    ``spark.sql.shuffle.partitions``.

    Null or empty text: the end id alone. Null doc_id: first. Repeated rows or ids: each row is a
    document; equal ids follow each other, dealt to parts by a hash of their text and in order of text within a part. Empty table: an empty manifest.
    """
    if width not in (2, 4):
        raise ValueError("an id has 2 or 4 bytes")
    folder = plain_path(folder)
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    largest = (1 << 8 * width) - 1

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = store(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        files, total, count = None, 0, 0
        for batch in small_batches(batches):
            if files is None:
                disk.create_dir(root, recursive=True)
                files = [disk.open_output_stream(f"{root}/{name}.{end}") for end in ("ids", "idx", "doc")]
                files[1].write(np.zeros(1, "<i8").tobytes())
            sizes = []
            for ids in encoded(batch.column(1).to_pylist(), tokenizer, kind, end_id):
                if width == 2:
                    wide = np.frombuffer(ids, "<u4")
                    if wide.max() > largest:
                        raise ValueError("an id does not fit the width of the file")
                    ids = wide.astype("<u2").tobytes()
                files[0].write(ids)
                sizes.append(len(ids) // width)
            files[1].write((total + np.cumsum(sizes, dtype="<i8")).tobytes())
            files[2].write(np.array([NO_ID if d is None else d for d in batch.column(0).to_pylist()], "<i8").tobytes())
            total, count = total + sum(sizes), count + len(sizes)
        if files is not None:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [count], "n_ids": [total]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text").mapInArrow(lean(put), _PART)
    made.write.parquet(f"{folder}/parts")
    done = spark.read.schema(_PART).parquet(f"{folder}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    based = done.withColumns({
        "first_id": F.coalesce(F.sum("n_ids").over(before), F.lit(0)),
        "first_doc": F.coalesce(F.sum("n_docs").over(before), F.lit(0)),
        "width": F.lit(width)})
    based.write.parquet(f"{folder}/manifest")
    return spark.read.schema(based.schema).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document of a data set, from its files: ``ROWS``; ``start`` is the offset in the
    whole, the crc is of the ids as unsigned 32-bit integers."""
    folder = plain_path(folder)
    manifest = spark.read.parquet(f"{folder}/manifest")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = store(folder)
        for batch in batches:
            for p in batch.to_pylist():
                path, kind = f"{root}/{p['file']}", f"<u{p['width']}"
                whole = lambda end, t: np.frombuffer(disk.open_input_stream(f"{path}.{end}").read(), t)
                offsets, keys = whole("idx", "<i8"), whole("doc", "<i8")
                local = isinstance(disk, pafs.LocalFileSystem)
                mapped = np.memmap(f"{path}.ids", dtype=kind, mode="r") if local else None
                remote = None if local else disk.open_input_file(f"{path}.ids")
                for at in range(0, len(keys), 4096):
                    ends = offsets[at : at + 4097]
                    span = mapped[ends[0] : ends[-1]] if local else np.frombuffer(
                        remote.read_at(int(ends[-1] - ends[0]) * p["width"], int(ends[0]) * p["width"]), kind)
                    crcs = [zlib.crc32(span[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0])]
                    ids = keys[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, mask=ids == NO_ID), pa.array(ends[:-1] + p["first_id"]), pa.array(np.diff(ends)),
                         pa.array(crcs, pa.int64())], schema=_ROWS)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = manifest.select("file", "first_id", "width")
    return columns.repartition(n, "file").mapInArrow(get, ROWS)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/corpusqa-tokens-{uuid.uuid4().hex}"
