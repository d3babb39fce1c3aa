"""Top-k reports and total orders.

A top-k report is ``orderBy`` with ``limit``, ties by id, so Spark keeps k rows per task and never sorts the corpus.
A total order deals the rows to ranges, numbers each range by itself and adds the rows of all
ranges before it: no task sees more than a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusqa import values as V
from corpusqa.functions import text as TX
from corpusqa.sources.tables import written


def top(df: DataFrame, by: str, k: int, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def head_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                k: int = 3, lines: int = V.SAMPLE_LINES) -> DataFrame:
    """The first lines of the ``k`` largest documents."""
    split = TX.splitlines(F.col(text_col))
    sample = F.array_join(F.slice(split, 1, lines), "\n")
    found = docs.select(id_col, TX.one_row(F.struct(
        F.size(split).alias("lines"), sample.alias("sample"))))
    return top(found, "lines", k, [id_col])


def numbered(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "position",
             parts: int | None = None) -> DataFrame:
    """Adds the place of each row in ``order``, from 1, in all or in its group ``by``.

    The order should tell all rows apart: rows that it does not fall into one range.  Groups may be of any
    size, one that holds most rows too.
    """
    spark = df.sparkSession
    whole = [*[F.asc(c) for c in by], *order]
    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Written first: finding the ranges reads the rows once more, and they may be costly to make.
    rows = written(df, "rows")
    ranged = written(rows.repartitionByRange(n, *whole).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*whole))
    placed = ranged.withColumn("_inside", inside).join(F.broadcast(offsets), "_range").withColumn(
        name, (F.col("_inside") + F.col("_before")).cast("bigint")).drop("_range", "_inside", "_before")
    if not by:
        return placed.select(*df.columns, name)
    placed = written(placed, "numbered")
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in by]
    first = placed.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min(name).alias("_first"))
    joined = placed.join(written(first, "firsts"), same)
    return joined.withColumn(name, F.col(name) - F.col("_first") + 1).select(*df.columns, name)


def chunks(df: DataFrame, by: str, item: str, size: int = 1000) -> DataFrame:
    """Members of each group as numbered lists of at most ``size``: ``by``, chunk (from 1), n, ``item``s in order."""
    place = numbered(df.select(by, item), [F.asc(item)], [by])
    return (place.withColumn("chunk", F.floor((F.col("position") - 1) / size) + 1)
            .groupBy(by, "chunk").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(item)).alias(f"{item}s")))
