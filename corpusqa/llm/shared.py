"""Helpers that the operators of this subpackage share: tables, scratch tables, words, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.sources.tables import scratch_folder as shared_folder, written as kept  # noqa: F401

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def plain_path(path: str) -> str:
    """file:/x as file:///x."""
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def crc_of(key: str | Column) -> Column:
    """crc32 of a key as decimal text: how labelled rows are held out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) if isinstance(key, str) else F.crc32(key.cast("string").cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), element by element."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


class WordHashes(dict):
    """64-bit hashes of words; the first ``limit`` different words are remembered, about 110 bytes each."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased. On bytes, ``lower`` and ``split`` touch
    ASCII only, which is the rule wanted here."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of ``n`` words in a row; of all words, if there are fewer."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = hashes[: len(hashes) - n + 1]
    for i in range(1, n):
        out = mix(out) + hashes[i : len(hashes) - n + 1 + i]
    return np.unique(mix(out + U64(n)))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that few long texts are held as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` as the function of a task that leaves no free memory behind in its worker process, which the tasks of later
    stages use again: what is freed goes back to the system."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return task


def root_of(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component, for ``n`` nodes and links between two index lists."""
    low = np.arange(n)
    while True:
        a, b = low[left], low[right]
        differ = a != b
        if not differ.any():
            return low
        a, b = a[differ], b[differ]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while True:  # follow to the root
            up = low[low]
            if np.array_equal(up, low):
                break
            low = up


def components(links: DataFrame, tag: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the component's smallest node.

    Each round hooks every node to its smallest neighbour, halves the paths and contracts the links to
    those between different roots. At least half of the nodes with links disappear in a round,
    so the rounds are logarithmic. All state is written tables; a hub of any degree is only ever a key of
    an aggregate or the long side of a join that Spark may split.
    """
    edges = kept(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        f"{tag}-links",
    )
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("up"))
        up = kept(up, f"{tag}-up")
        over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
        level = kept(up.join(over, "up").select("node", F.col("over").alias("up")), f"{tag}-level")
        levels.append(level)
        a, b = level.toDF("a", "ra"), level.toDF("b", "rb")
        edges = kept(
            edges.join(a, "a").join(b, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            f"{tag}-links",
        )
    if not levels:
        kind = dict(edges.dtypes)["a"]
        return edges.select(F.col("a").alias("node"), F.col("b").cast(kind).alias("root"))
    # The maps only hold the nodes that still had links: the others keep what they have.
    out = levels[0].toDF("node", "root")
    for level in levels[1:]:
        out = out.join(level.toDF("root", "next"), "root", "left").select(
            "node", F.coalesce("next", "root").alias("root"))
    return out
