"""Source trees, decoding, the encoding census and requirement files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusqa import values as V
from corpusqa.operators import paths as P
from corpusqa.sources import tree

# Workers get the functions by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(tree)


def list_sources(spark: SparkSession, root: str,
                 languages: dict[str, Sequence[str]] = V.COARSE_LANGUAGES,
                 ignored: Sequence[str] = V.IGNORED_DIRECTORIES,
                 names: Sequence[str] = ()) -> DataFrame:
    """All source files under ``root``: path, rel_path, length.  The listing is done by tasks.

    Ignored and dot directories are not entered; dot files and files of unknown
    extension are left out, but for those listed in ``names``.
    """
    extensions = sorted({e for es in languages.values() for e in es})
    return tree.list_files(spark, root, extensions, names, ignored)


def scan_files(spark: SparkSession, root: str,
               languages: dict[str, Sequence[str]] = V.COARSE_LANGUAGES,
               ignored: Sequence[str] = V.IGNORED_DIRECTORIES,
               names: Sequence[str] = (), max_bytes: int | None = None) -> DataFrame:
    """``list_sources`` with their content, null above ``max_bytes``."""
    return tree.read_files(list_sources(spark, root, languages, ignored, names), root, max_bytes=max_bytes)


def scan_filter(files: DataFrame, path: Column,
                languages: dict[str, Sequence[str]] = V.COARSE_LANGUAGES,
                ignored: Sequence[str] = V.IGNORED_DIRECTORIES) -> DataFrame:
    """The same selection on a table whose paths are relative to the root."""
    folders = F.split(P.dirname(path), "/")
    pruned = F.exists(folders, lambda s: s.isin(*ignored) | s.startswith("."))
    known = [e for es in languages.values() for e in es]
    return files.filter(~pruned & ~P.basename(path).startswith(".")
                        & F.lower(P.extension(path)).isin(*known))


# ------------------------------------------------------------------ decoding

def encoding_label(content: Column) -> Column:
    """Encoding of a file from its bytes: byte-order mark, ASCII, UTF-8 or other."""
    head = F.hex(F.substring(content, 1, 4))
    text = content.cast("string")
    return (
        F.when(F.octet_length(content) == 0, "N/A (Empty)")
        .when(head.startswith("EFBBBF"), "UTF-8-SIG")
        .when(head.isin("FFFE0000", "0000FEFF"), "UTF-32")
        .when(head.startswith("FFFE") | head.startswith("FEFF"), "UTF-16")
        .when(F.is_valid_utf8(text),
              F.when(F.octet_length(content) == F.char_length(text), "ascii").otherwise("utf-8"))
        .otherwise("other")
    )


def decode(content: Column, errors: str = "replace") -> Column:
    """Bytes to text; invalid bytes become U+FFFD (``replace``) or go (``ignore``)."""
    label = encoding_label(content)
    utf8 = F.make_valid_utf8(content.cast("string"))
    if errors == "ignore":
        utf8 = F.translate(utf8, "\ufffd", "")
    return (F.when(label == "UTF-16", F.decode(content, "UTF-16"))
            .when(label == "UTF-32", F.decode(content, "UTF-32"))
            .when(label == "UTF-8-SIG", F.substr(utf8, F.lit(2)))
            .otherwise(utf8))


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def encoding_census(docs: DataFrame, content: Column) -> DataFrame:
    """Documents per encoding, with the share of all in percent."""
    counts = docs.groupBy(encoding_label(content).alias("encoding")).agg(
        F.count(F.lit(1)).alias("n"))
    return with_share(counts, "n")


def with_share(counts: DataFrame, n: str) -> DataFrame:
    """Add ``percentage`` of the total, to one decimal.

    The total is a scalar subquery: any number of labels stays where it is.
    """
    total = counts.agg(F.sum(n)).scalar()
    return counts.withColumn("percentage", F.bround(F.col(n) / total * 100, 1))


def requirement_files(files: DataFrame, project: Column, name: Column) -> DataFrame:
    """Each project's first requirement file, by the fixed order of names."""
    order = F.array_position(F.array(*[F.lit(n) for n in V.REQUIREMENT_FILES]), name)
    return (files.select("*", project.alias("project"), order.alias("_order"))
            .filter(F.col("_order") > 0)
            .withColumn("_rank", F.row_number().over(
                Window.partitionBy("project").orderBy("_order")))
            .filter(F.col("_rank") == 1).drop("_order", "_rank"))
