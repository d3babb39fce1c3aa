"""Operator 4: packing by power-of-two decomposition.

A document of ``n`` ids becomes ``n // 2048`` pieces of 2048 ids and, for the rest, one piece for each bit of
its length, largest first. Every piece is a sequence of its own whose length is a power of two, so no
sequence crosses documents and none is padded. Equal lengths form a bucket: a training step takes all its
sequences from one bucket.

Documents never meet, so there is no shuffle: one pass that encodes and cuts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.llm.shared import lean, small_batches
from corpusqa.llm.tokens import encoded

PIECES = ("doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
          "bucket int, offset long")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()),
                    ("offset", pa.int64())])


def lengths(n: int, longest: int = 2048) -> list[int]:
    """Lengths of the pieces of ``n`` ids: powers of two, largest first."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence is a power of two")
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, longest: int = 2048,
         with_ids: bool = True) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text): ``PIECES`` and ``sequence_id``.

    ``tokenizer`` is the path of a tokenizer file that every executor has. ``ids`` are little-endian unsigned
    32-bit integers (null without ``with_ids``), ``bucket`` is the base-2 logarithm of the length,
    ``sequence_id`` is unique and the same for every run over the same input files.

    Null or empty text: the end id alone, one piece. Null doc_id: packed like any other. Repeated rows: each
    row is a document. Empty table: no rows. Other columns are not read.
    """
    lengths(0, longest)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            keys = batch.column(0).to_pylist()
            out: list[list] = [[] for _ in _ARROW]
            for key, ids in zip(keys, encoded(batch.column(1).to_pylist(), tokenizer, kind, end_id)):
                at, total = 0, len(ids) // 4
                for n in lengths(total, longest):
                    piece = ids[4 * at : 4 * (at + n)]
                    row = (key, at, n, piece if with_ids else None, zlib.crc32(piece), total, n.bit_length() - 1, 0)
                    for column, value in zip(out, row):
                        column.append(value)
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW)], schema=_ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(cut), PIECES).withColumn("sequence_id", F.monotonically_increasing_id())


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each sequence length, so that a loader reads batches of equal length."""
    pieces.write.partitionBy("bucket").parquet(path)


def unpacked(pieces: DataFrame) -> DataFrame:
    """(doc_id, doc_tokens, n_pieces, sizes_ok): the round trip as counts, for checks."""
    return pieces.groupBy("doc_id").agg(
        F.max("doc_tokens").alias("doc_tokens"), F.count("*").alias("n_pieces"),
        (F.sum("length") == F.max("doc_tokens")).alias("sizes_ok"))


def ids_of(piece: bytes) -> np.ndarray:
    return np.frombuffer(piece, dtype="<u4")
