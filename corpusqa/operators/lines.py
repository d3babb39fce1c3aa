"""Line tables: numbered lines, line classes, counts, commented-out islands."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusqa import values as V
from corpusqa.functions import linecodes as LC, text as TX
from corpusqa.functions.locate import positions
from corpusqa.functions.patterns import java


def _split(text: Column, mode: str) -> Column:
    return TX.splitlines(text) if mode == "splitlines" else TX.lines(text)


def explode_lines(docs: DataFrame, id_cols: Sequence[str] = ("doc_id",),
                  text_col: str = "text", mode: str = "newline") -> DataFrame:
    """One row per line: ids, line_no (from 1), line."""
    return docs.select(
        *id_cols, F.inline(TX.numbered(_split(F.col(text_col), mode), "line_text"))
    ).select(*id_cols, F.col("line").alias("line_no"), F.col("line_text").alias("line"))


def line_count(text: Column, mode: str = "newline") -> Column:
    return F.size(_split(text, mode))


def line_classes(docs: DataFrame, id_cols: Sequence[str] = ("doc_id",),
                 text_col: str = "text", lang: Column | None = None,
                 style: LC.CommentStyle = LC.BASIC_STYLE,
                 comment: str = LC.BASIC_COMMENT, mode: str = "splitlines") -> DataFrame:
    """One row per line with its class: blank, comment or code."""
    lang = F.lit("") if lang is None else lang
    code = LC.codes(_split(F.col(text_col), mode), lang, style)
    classes = F.transform(
        LC.tokens(LC.annotate(code)),
        lambda c, i: F.struct(
            (i + 1).alias("line_no"),
            F.when(c.startswith("b"), "blank")
            .when(c.rlike(f"^(?:{comment})$"), "comment").otherwise("code").alias("class"),
        ),
    )
    return docs.select(*id_cols, F.inline(classes))


def file_stats(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text",
               lang: Column | None = None, style: LC.CommentStyle = LC.BASIC_STYLE,
               max_lines: int | None = None) -> DataFrame:
    """Per document: lines, code, comments, blank.  Documents over ``max_lines``, if given, are out."""
    lang = F.lit("") if lang is None else lang

    def count(code: Column) -> Column:
        blank = F.length(code) - F.length(F.replace(code, F.lit("b"), F.lit("")))
        comments = LC.count_codes(LC.annotate(code), LC.BASIC_COMMENT)
        return F.struct(
            F.length(code).alias("lines"),
            F.greatest(F.lit(0), F.length(code) - blank - comments).alias("code"),
            comments.alias("comments"),
            blank.alias("blank"),
        )

    counted = TX.let(
        TX.splitlines(F.col(text_col)),
        lambda ls: F.when(F.lit(True) if max_lines is None else F.size(ls) <= max_lines,
                          F.array(TX.let(LC.codes(ls, lang, style), count))),
    )
    return docs.select(*keep, F.inline(counted))


def size_guard(docs: DataFrame, text_col: str = "text",
               max_lines: int = V.MAX_FILE_LINES) -> DataFrame:
    """Corpus counts: found, analyzed and skipped for size."""
    n = line_count(F.col(text_col), "splitlines")
    return docs.agg(
        F.count(F.lit(1)).alias("files_found"),
        F.count_if(n <= max_lines).alias("files_analyzed"),
        F.count_if(n > max_lines).alias("files_skipped"),
    )


def long_lines(docs: DataFrame, id_cols: Sequence[str] = ("doc_id",), text_col: str = "text",
               limit: int = V.LONG_LINE_CHARS) -> DataFrame:
    """Issues: lines whose stripped length is over the limit."""
    return docs.select(*id_cols, F.inline(long_line_issues(F.col(text_col), limit)))


def issue(category: str, name: str, description: Column | str, severity: str,
          line: Column, context: Column | None = None) -> Column:
    """One issue struct, always the same field order and types."""
    text = F.lit(description) if isinstance(description, str) else description
    return F.struct(
        F.lit(category).alias("category"), F.lit(name).alias("type"),
        text.alias("description"), F.lit(severity).alias("severity"),
        line.cast("int").alias("line"),
        (F.lit(None) if context is None else context).cast("string").alias("context"),
    )


def long_line_issues(text: Column, limit: int = V.LONG_LINE_CHARS) -> Column:
    name, category, severity, description = V.LONG_LINE
    # A line can only be long when its raw length is, so strip few lines.
    long = F.filter(TX.numbered(TX.lines(text)),
                    lambda x: (F.length(x["text"]) > limit)
                    & (F.length(TX.strip(x["text"])) > limit))
    return F.transform(long, lambda x: issue(category, name, description, severity, x["line"]))


def file_metrics(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text",
                 lang: Column | None = None,
                 style: LC.CommentStyle = LC.ADVANCED_STYLE) -> DataFrame:
    """Per document: loc, comment lines, their share, mean length of non-blank lines."""
    lang = F.lit("") if lang is None else lang

    def measure(ls: Column) -> Column:
        lengths = F.transform(
            F.filter(ls, lambda x: ~TX.is_blank(x)), lambda x: F.length(x))
        return F.struct(
            F.size(ls).alias("loc"),
            TX.let(LC.codes(ls, lang, style), LC.density_comments).alias("comment_lines"),
            F.size(lengths).alias("filled_lines"),
            F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("filled_chars"),
        )

    counted = docs.select(*keep, TX.one_row(TX.let(TX.lines(F.col(text_col)), measure)))
    return counted.select(
        *keep, "loc", "comment_lines",
        (F.col("comment_lines") / F.col("loc")).alias("comment_density"),
        F.when(F.col("filled_lines") > 0, F.col("filled_chars") / F.col("filled_lines"))
        .otherwise(0.0).alias("avg_line_length"),
    )


# ------------------------------------------------------------------- islands

def code_like(line: Column) -> Column:
    """Does a comment line hold something that looks like code?"""
    plain = [p.lstrip("\\") for p in V.CODE_INDICATORS if len(p.lstrip("\\")) == 1]
    rest = [java(p) for p in V.CODE_INDICATORS if len(p.lstrip("\\")) > 1]
    tests = [line.contains(c) for c in plain] + [line.rlike("|".join(rest))]
    return reduce(lambda a, b: a | b, tests)


def islands(codes: Column) -> Column:
    """array<struct<line, end_line, n>>: runs of two or more hits between breaks.

    ``codes`` holds one character per line: ``k`` a hit, ``n`` and ``b`` lines
    that neither extend nor break a run, anything else a break.
    """
    def read(marked: Column) -> Column:
        starts, ends = positions(marked, "F"), positions(marked, "L")
        inner = F.regexp_extract_all(marked, F.lit("F[bnk]*L"), F.lit(0))
        return F.transform(
            F.arrays_zip(starts.alias("s"), ends.alias("e"), inner.alias("r")),
            lambda z: F.struct(
                z["s"].alias("line"), z["e"].alias("end_line"),
                (F.length(F.regexp_replace(z["r"], "[bn]", ""))).alias("n"),
            ),
        )

    return TX.let(F.regexp_replace(codes, "k([bnk]*)k", "F$1L"), read)


def comment_islands(text: Column, lang: Column, style: LC.CommentStyle = LC.ADVANCED_STYLE,
                    looks_like_code: Callable[[Column], Column] = code_like) -> Column:
    """Islands of comment lines that look like code."""
    def coded(ls: Column) -> Column:
        kinds = LC.tokens(LC.annotate(LC.codes(ls, lang, style)))
        return F.array_join(F.zip_with(ls, kinds, lambda raw, kind: (
            F.when(kind.startswith("b"), "b")
            .when(~kind.rlike(f"^(?:{LC.ADVANCED_COMMENT})$"), "|")
            .when(looks_like_code(LC.strip_marker(TX.strip(raw), lang, style)), "k")
            .otherwise("n")
        )), "")

    return islands(TX.let(TX.lines(text), coded))


def commented_code_issues(text: Column, lang: Column,
                          style: LC.CommentStyle = LC.ADVANCED_STYLE) -> Column:
    return F.transform(comment_islands(text, lang, style), lambda r: issue(
        V.CODE_SMELLS, "commented_code",
        F.format_string("Commented-out code block (lines %d-%d)", r["line"], r["end_line"]),
        "low", r["line"],
    ))
