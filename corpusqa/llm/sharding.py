"""Operator 10: shards by extendible hashing. DataFrame functions only.

A row's address is 60 bits of a hash of its id and text. The directory is indexed by the leading bits:
a bucket that is over the byte limit is split on one more bit, and only such buckets are. So a shard is a
prefix: the shortest one on the row's address whose rows fit.

The directory is built from sums, ``STRIDE`` bits at a time: one aggregate gives the cells of the next
``STRIDE`` bits below the buckets that are still too large, and their roll-up gives all depths
between. At most ``2 ** STRIDE`` cells for each such bucket come out of it, whatever the number of rows.
Rows find their shard by a join on each level's prefix: no row is shuffled while a level has at most
``BROADCAST`` cells, and by an equi-join beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusqa.llm.shared import kept

BITS, STRIDE = 60, 12
#: Cells of a level (24 bytes each) that may be broadcast.
BROADCAST = 65_536


def address(doc_id: str = "doc_id", text: str = "text") -> Column:
    body = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), body)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(bits: Column, depth: int | Column) -> Column:
    """The first ``depth`` bits."""
    return F.expr(f"shiftright(`{bits}`, {BITS} - {depth})") if isinstance(depth, int) else F.call_function("shiftright", F.col(bits), F.lit(BITS) - depth)


def directory(sizes: DataFrame, limit: int) -> list[tuple[DataFrame, int]]:
    """Levels of the directory of ``sizes`` (address, bytes): (cell, shard, depth) with the level's bits.

    ``shard`` is ``2 ** depth + prefix``, null where the next level decides. A bucket is not split further if
    it fits or is a single row.
    """
    levels: list[tuple[DataFrame, int]] = []
    rows, low = sizes, 0
    while low < BITS:
        high = low + STRIDE
        cells = kept(
            rows.groupBy(_prefix("address", high).alias("cell"))
            .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "cells")
        depths = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(low + (low > 0)), F.lit(high))).alias("depth"))
        at = F.call_function("shiftright", F.col("cell"), (F.lit(high) - F.col("depth")).cast("int"))
        depths = depths.withColumn("bucket", at)
        fits = depths.groupBy("depth", "bucket").agg(F.sum("bytes").alias("all_bytes"), F.sum("n").alias("all_n")).where(
            (F.col("all_bytes") <= limit) | (F.col("all_n") == 1)).select("depth", "bucket")
        leaf = depths.join(fits, ["depth", "bucket"]).groupBy("cell").agg(F.min("depth").alias("depth"))
        level = kept(cells.select("cell").join(leaf, "cell", "left"), "level")
        levels.append((level, high))
        rest = level.where("depth is null").select(F.col("cell").alias("_cell"))
        if rest.isEmpty():
            break
        rows, low = rows.join(_sized(rest), _prefix("address", high) == F.col("_cell"), "left_semi"), high
    return levels


def _sized(cells: DataFrame) -> DataFrame:
    return F.broadcast(cells) if cells.count() <= BROADCAST else cells


def shard(docs: DataFrame, limit: int = 256 << 20) -> DataFrame:
    """``docs`` with ``shard`` (long), ``shard_depth`` (int), ``shard_part`` (long) and ``n_bytes`` (long).

    ``n_bytes`` is the UTF-8 length of ``text``. The rows of one (shard, shard_part) have at most ``limit`` bytes
    together, or are one row that is larger.

    Null text: 0 bytes. Null doc_id: addressed by its text. Wholly repeated rows share an address and no
    bit splits them; only if together they are over the limit are they dealt into numbered parts of what
    fits, counted within each input partition (``shard_part``, else 0). Empty table: no rows. Columns of
    ``docs`` with these names are replaced; others may have any names.
    """
    made = ("shard", "shard_depth", "shard_part", "n_bytes")
    names = [n for n in docs.columns if n not in made]
    out = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), address().alias("_address"),
                      F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    result = ["row.*", "n_bytes", "shard_depth", "shard", "shard_part"]
    sizes = kept(out.select(F.col("_address").alias("address"), F.col("n_bytes").alias("bytes")), "sizes")
    depth = F.lit(None).cast("int")
    levels = directory(sizes, limit)
    for k, (level, high) in enumerate(levels):
        cells = level.where("depth is not null").select(F.col("cell").alias(f"_cell{k}"), F.col("depth").alias(f"_depth{k}"))
        out = out.join(_sized(cells), _prefix("_address", high) == F.col(f"_cell{k}"), "left")
        depth = F.coalesce(depth, F.col(f"_depth{k}"))
    out = out.withColumn("shard_depth", F.coalesce(depth, F.lit(BITS)).cast("int"))
    number = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("shard_depth")) + F.call_function(
        "shiftright", F.col("_address"), F.lit(BITS) - F.col("shard_depth"))
    out = out.withColumn("shard", number).drop(*(f"_{n}{k}" for n in ("cell", "depth") for k in range(len(levels))))
    last, bits = levels[-1]
    if bits < BITS or last.where("depth is null").isEmpty():
        return out.withColumn("shard_part", F.lit(0).cast("long")).select(*result)
    stuck = last.where("depth is null").select(F.col("cell").alias("_cell"))
    split = out.withColumn("_in", F.spark_partition_id())
    some = split.join(_sized(stuck), F.col("_address") == F.col("_cell"), "left_semi")
    nth = F.row_number().over(Window.partitionBy("_address", "_in").orderBy("n_bytes"))
    room = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("n_bytes")))
    some = some.withColumn("shard_part", (F.col("_in") * F.lit(1 << 32) + F.floor((nth - 1) / room)).cast("long"))
    others = split.join(_sized(stuck), F.col("_address") == F.col("_cell"), "left_anti").withColumn("shard_part", F.lit(0).cast("long"))
    return others.unionByName(some).select(*result)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard."""
    sharded.write.partitionBy("shard", "shard_part").parquet(path)


def sql(limit: int) -> str:
    return f"""
WITH a AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS address
  FROM documents
), b AS (
  SELECT a.*, d::INTEGER AS depth, address >> ({BITS} - d) AS bucket FROM a, range(0, {BITS} + 1) r(d)
), fits AS (
  SELECT depth, bucket FROM b GROUP BY depth, bucket HAVING sum(n_bytes) <= {limit} OR count(*) = 1
)
SELECT doc_id, n_bytes, min(depth) AS shard_depth,
       (1::BIGINT << min(depth)) + (address >> ({BITS} - min(depth))) AS shard, 0::BIGINT AS shard_part
FROM b JOIN fits USING (depth, bucket) GROUP BY doc_id, n_bytes, address
"""
