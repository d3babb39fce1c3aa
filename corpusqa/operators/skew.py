"""Joining many rows with one fact per key, when some keys hold most of the rows.

A key that holds a third of all rows would make one task do a third of the work.
Adaptive execution does not split it here, because the facts come out of an
aggregate.  But the facts know how many rows each key has, so:

* a key with more than a 10,000th of all rows is hot; there are fewer than 10,000
  of those whatever the data, so they are broadcast and met without a shuffle;
* all other keys are joined by shuffle, where none can outgrow a task; the rows
  that have met their fact are spread at random over that shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

PARTS = 10_000
SALTS = 4096


def attach(rows: DataFrame, facts: DataFrame, key: str, n: str,
           spread_by: Sequence[str], parts: int = PARTS) -> DataFrame:
    """Inner join on ``key``.  ``facts`` has one row per key, with the number of
    ``rows`` of that key in ``n``; ``spread_by`` are columns that tell rows apart."""
    payload = [c for c in facts.columns if c != key]
    limit = facts.agg((F.sum(n) / parts).alias("limit")).scalar()

    def side(condition, name: str) -> DataFrame:
        # Zero, since n is at least one, but nothing the optimizer can fold: a
        # literal would end up in the join condition, and the shuffle would be by
        # the key alone.
        zero = F.least(F.col(n), F.lit(0)).cast("int")
        return facts.filter(condition).select(
            F.col(key), zero.alias("_salt"), F.struct(*payload).alias(name))

    hot = side(F.col(n) > limit, "_hot").drop("_salt")
    cold = side(F.col(n) <= limit, "_cold")
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(
        F.pmod(F.hash(*spread_by), F.lit(SALTS)) + 1)
    tagged = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt)
    met = tagged.join(cold, [key, "_salt"], "left").withColumn("_fact", F.coalesce("_hot", "_cold"))
    return met.filter(F.col("_fact").isNotNull()).select(
        *rows.columns, *[F.col("_fact")[c].alias(c) for c in payload])
