"""Operator 3: lines that repeat across documents, as keep bitmaps. DataFrame functions only.

1. Every line that is long enough becomes a fixed-width row: 128-bit hash of its key, document, position.
   These rows, never text, are what is shuffled and sorted.
2. Keys that hold more than a 10,000th of all rows, of which there are fewer than 10,000, are summed
   up with partial aggregation and their rows are decided where they lie, by a broadcast of that bounded list.
3. All other rows are range-partitioned by hash with a secondary sort by document and position, and each key's
   rows are streamed: the first document is the one that keeps its lines.
4. What comes back is a bitmap for each document that loses lines, run-length compressed: the runs of
   lines that stay. Texts are joined with their bitmap once, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusqa.llm.shared import kept

#: A key with more than this share of all rows is decided by broadcast.
HOT = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    """A text without line ends is one line; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def ascii_lower(text: Column) -> Column:
    """A-Z only. On pure ASCII ``lower`` does the same and is much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc, body, at): long lines of documents that have an id. ``body`` tells apart different texts
    under one id."""
    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").alias("doc"), F.xxhash64("text").alias("body"),
        F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("at", "line"))
    rows = rows.select("doc", "body", "at", F.btrim("line", F.lit(" \t\n\x0b\x0c\r")).alias("key"))
    return rows.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "body", "at")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, body, n_dropped, dropped): a row for each document that loses lines; ``dropped`` holds the
    runs of its lost lines as (first, length), counted from 0: a run-length compressed bitmap.

    A key is a line stripped of ASCII white space with A-Z lower-cased. Keys of at least ``min_chars``
    code points in at least ``min_docs`` different documents lose all lines but those in the document
    with the largest id.

    Null or empty text: no long line, nothing lost. Null doc_id: takes no part, keeps all. Rows that share an id
    count as one document and are decided alike. Empty table: no rows. Other columns are not read.
    """
    rows = kept(occurrences(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), min_chars), "lines")
    total = rows.count()
    sums = rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > total / HOT)
    hot = F.broadcast(kept(sums.select("h1", "h2"), "hot-lines"))
    per_doc = rows.join(hot, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    frequent = kept(per_doc.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("keeper")), "frequent")
    of_hot = rows.join(F.broadcast(frequent.where(F.col("docs") >= min_docs)), ["h1", "h2"]).where("doc <> keeper")

    cold = rows.join(hot, ["h1", "h2"], "left_anti")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = Window.partitionBy("h1", "h2")
    order = key.orderBy(F.desc("doc"), "at")
    streamed = (
        cold.repartitionByRange(parts, "h1", "h2")
        .withColumn("nth", F.dense_rank().over(key.orderBy(F.desc("doc"))))
        .withColumn("keeper", F.first("doc").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("docs", F.max("nth").over(key)))  # a cold key's rows are few
    of_cold = streamed.where((F.col("docs") >= min_docs) & (F.col("doc") != F.col("keeper")))
    lost = of_cold.select("doc", "body", "at").unionAll(of_hot.select("doc", "body", "at"))
    return lost.groupBy("doc", "body").agg(F.array_sort(F.collect_set("at")).alias("ats")).select(
        "doc", "body", F.size("ats").cast("long").alias("n_dropped"), _runs(F.col("ats")).alias("dropped"))


def _runs(ats: Column) -> Column:
    """Sorted positions as runs (first, length)."""
    firsts = F.filter(ats, lambda x, i: (i == 0) | (F.get(ats, i - 1) != x - 1))
    lasts = F.filter(ats, lambda x, i: (i == F.size(ats) - 1) | (F.get(ats, i + 1) != x + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("length")))


def _left(all_lines: Column, runs: Column) -> Column:
    """The lines outside the runs."""
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["first"] + r["length"]))
    ends = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(all_lines)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(all_lines, a + 1, b - a)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the lost lines taken out of ``text``, and ``_n_lines``, ``_n_dropped``, which
    replace columns of these names. Other columns may have any names.

    Rows without a bitmap keep their text as it is, null included."""
    names = [n for n in docs.columns if n not in ("_n_lines", "_n_dropped")]
    # The bitmaps grow with the corpus, so this is a merge join at every size. Null ids are spread by their texts.
    b = bitmaps.hint("merge").select("doc", "body", "n_dropped", "dropped")
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    joined = rows.join(b, (F.col("id") == F.col("doc")) & (F.col("key") == F.col("body")), "left")
    whole = F.col("row.text")
    split = lines(whole)
    text = F.when(F.col("dropped").isNull(), whole).otherwise(F.array_join(_left(split, F.col("dropped")), "\n"))
    return joined.select(
        *(text.alias("text") if n == "text" else F.col("row").getField(n).alias(n) for n in names),
        F.size(split).cast("long").alias("_n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("_n_dropped"))


def digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, i, line, trim(translate(line, '{_UPPER}', '{_LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), flagged AS (
  SELECT l.*, keeper IS NOT NULL AND keeper <> doc_id AS dropped FROM lines l LEFT JOIN frequent USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
