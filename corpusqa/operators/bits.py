"""Which rows may have a key of a given set?  A bit filter, applied where the rows lie.

A key sets one bit of a table of 64-bit words, built by a hash aggregate.  The table has at most
``MOST_BITS`` bits, about 40 MB as a broadcast relation, whatever the data.  A row whose bit is not set has none of the
keys; some others pass by chance, so what is left still has to meet the keys themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MOST_BITS = 1 << 26
#: Bits for each key: one other row in as many passes by chance.
PER_KEY = 16


def _cell(hashed: Column, bits: int) -> Column:
    return hashed.bitwiseAND(F.lit(bits - 1).cast("bigint"))


def sift(rows: DataFrame, hashed: Column, keys: DataFrame, key_hash: Column, n_keys: int) -> DataFrame:
    """The ``rows`` whose hash is that of one of ``keys``, and a few others.

    ``hashed`` and ``key_hash`` are 64-bit hashes of the same value on both sides; ``n_keys`` is the number of
    keys.  Of more keys than the bits can tell apart nothing is left out.
    """
    bits = 1 << max(10, (PER_KEY * max(n_keys, 1) - 1).bit_length())
    if bits > MOST_BITS:
        bits = MOST_BITS
        if 2 * n_keys > bits:
            return rows
    cell = _cell(key_hash, bits)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit").cast("int"))
    words = (keys.select(F.shiftright(cell, 6).alias("_word"), cell.bitwiseAND(F.lit(63).cast("bigint")).alias("_bit"))
             .groupBy("_word").agg(F.bit_or(one).alias("_bits")))
    held = rows.withColumn("_cell", _cell(hashed, bits)).withColumn("_word", F.shiftright("_cell", 6))
    met = held.join(F.broadcast(words), "_word")
    return met.filter(F.getbit("_bits", F.col("_cell").bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1).select(*rows.columns)
