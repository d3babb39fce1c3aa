"""Duplicate blocks: equal windows of clean lines, anywhere in the corpus.

``find`` reads the texts once and writes a 16-byte digest and a location per window.  Everything else
starts from these rows.  No text is shuffled: samples are read by a second scan that knows where to look.
A block copied into a third of the corpus is one partial-aggregate row per map
task.  Locations are rows, not a list in one cell, so no group has to fit
anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from corpusqa import values as V
from corpusqa.functions import linecodes as LC, text as TX
from corpusqa.functions.patterns import DIGIT, WORD
from corpusqa.operators.bits import sift
from corpusqa.operators.lexicon import word_count
from corpusqa.operators.skew import PARTS, attach
from corpusqa.sources.tables import written

# Three word characters in a row that are not digits.
_LETTERS = f"[{WORD}&&[^{DIGIT}]]{{3}}"


def clean_lines(text: Column, lang: Column,
                style: LC.CommentStyle = LC.DUPLICATE_STYLE) -> Column:
    """array<struct<line, text>>: stripped lines that are neither blank nor comment."""
    def keep(ls: Column) -> Column:
        kinds = LC.tokens(LC.annotate(LC.codes(ls, lang, style)))
        paired = F.zip_with(TX.numbered(ls), kinds, lambda x, k: F.struct(
            x["line"].alias("line"), TX.strip(x["text"]).alias("text"), k.alias("kind")))
        return F.transform(
            F.filter(paired, lambda x: x["kind"].rlike(LC.KEPT_LINE)),
            lambda x: F.struct(x["line"].alias("line"), x["text"].alias("text")))

    return TX.let(TX.lines(text), keep)


def block_at(clean: Column, start: Column, size: int) -> Column:
    return F.array_join(F.transform(F.slice(clean, start, size), lambda x: x["text"]), "\n")


def digest(block: Column) -> Column:
    """128 bits, as 16 bytes: collisions stay out of reach at any corpus size."""
    return F.unhex(F.md5(block))


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            lang: Column | None = None, style: LC.CommentStyle = LC.DUPLICATE_STYLE,
            size: int = V.WINDOW_LINES, min_chars: int = V.WINDOW_MIN_CHARS,
            mark_first: bool = False) -> DataFrame:
    """One row per sliding window: id, key, clean_start, line.  No shuffle.

    ``mark_first`` adds ``first``: 1 for each key's first window in a document, else 0.
    """
    lang = F.lit("") if lang is None else lang

    # Length and letters of a block follow from those of its lines, so the text
    # is measured once, not once per window that covers it.
    def measured(clean: Column) -> Column:
        return F.transform(clean, lambda x: F.struct(
            x["line"].alias("line"), x["text"].alias("text"),
            F.length(x["text"]).alias("chars"),
            x["text"].rlike(_LETTERS).alias("letters")))

    def chars(part: Column) -> Column:
        return F.aggregate(part, F.lit(size - 1), lambda a, x: a + x["chars"])

    def slide(clean: Column) -> Column:
        starts = F.when(F.size(clean) >= size,
                        F.sequence(F.lit(1), F.size(clean) - (size - 1)))
        parts = F.filter(
            F.transform(starts, lambda i: F.struct(
                i.alias("clean_start"), F.slice(clean, i, size).alias("part"))),
            lambda w: (chars(w["part"]) >= min_chars)
            & F.exists(w["part"], lambda x: x["letters"]))
        found = F.transform(parts, lambda w: F.struct(
            digest(F.array_join(F.transform(w["part"], lambda x: x["text"]), "\n")).alias("key"),
            w["clean_start"].alias("clean_start"),
            F.element_at(w["part"], 1)["line"].alias("line")))
        return _marked_firsts(found) if mark_first else found

    return docs.select(id_col, F.inline(TX.let(
        measured(clean_lines(F.col(text_col), lang, style)), slide)))


def _marked_firsts(found: Column) -> Column:
    """In windows sorted by key and start, the first one of each key."""
    def is_first(ws: Column, w: Column, i: Column) -> Column:
        return (i == 0) | (F.element_at(ws, F.greatest(i, F.lit(1)))["key"] != w["key"])

    return TX.let(F.array_sort(found), lambda ws: F.transform(ws, lambda w, i: F.struct(
        *[w[c].alias(c) for c in ("key", "clean_start", "line")],
        is_first(ws, w, i).cast("int").alias("first"))))


def _sample_id(df: DataFrame, id_col: str) -> Column:
    """A fixed-width stand-in for the id, so that its minimum has a flat buffer."""
    if isinstance(df.schema[id_col].dataType, IntegralType):
        return F.col(id_col).cast("bigint")
    return F.xxhash64(id_col)


def duplicate_keys(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Blocks seen more than once: key, n_locations and one place to read it.

    All buffers are fixed-width, so this is one hash aggregate with a map-side
    half, whatever the skew.
    """
    return (found.select("key", "clean_start", _sample_id(found, id_col).alias("sample_id"))
            .groupBy("key").agg(
                F.count(F.lit(1)).alias("n_locations"),
                F.min("sample_id").alias("sample_id"),
                F.min_by("clean_start", "sample_id").alias("sample_start"))
            .filter(F.col("n_locations") > 1))


@dataclass(frozen=True)
class Duplicates:
    """What every question about duplicate blocks starts from, computed once.

    ``windows`` are the rows of ``windows`` with ``first``, ``keys`` those of ``duplicate_keys``; both
    are written tables without text.
    """

    windows: DataFrame
    keys: DataFrame
    n_keys: int
    id_col: str

    def repeated(self, firsts: bool = False) -> DataFrame:
        """Windows of duplicated blocks, and a few others: most unique windows end here, before any shuffle."""
        rows = self.windows.filter(F.col("first") == 1) if firsts else self.windows
        return sift(rows, F.xxhash64("key"), self.keys, F.xxhash64("key"), self.n_keys)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         lang: Column | None = None, style: LC.CommentStyle = LC.DUPLICATE_STYLE,
         size: int = V.WINDOW_LINES, min_chars: int = V.WINDOW_MIN_CHARS) -> Duplicates:
    """Reads the texts once.  The functions below take the result as ``found``; without it they call this."""
    found = written(windows(docs, id_col, text_col, lang, style, size, min_chars, mark_first=True), "windows")
    keys = written(duplicate_keys(found, id_col), "duplicate-keys")
    return Duplicates(found, keys, keys.count(), id_col)


def duplicate_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lang: Column | None = None,
                     style: LC.CommentStyle = LC.DUPLICATE_STYLE,
                     size: int = V.WINDOW_LINES, min_chars: int = V.WINDOW_MIN_CHARS,
                     snippet_chars: int = V.SNIPPET_CHARS, found: Duplicates | None = None) -> DataFrame:
    """One row per duplicated block: key, lines, tokens, n_locations, code_snippet.

    A second scan reads the samples: bit filters pick the documents and the places in them, the block is
    clipped there, and only the snippets go on to meet their keys.
    """
    found = found or find(docs, id_col, text_col, lang, style, size, min_chars)
    wanted = found.keys
    lang_value = F.lit("") if lang is None else lang
    texts = docs.select(_sample_id(docs, id_col).alias("sample_id"), lang_value.alias("_lang"),
                        F.col(text_col).alias("_text"))
    by_doc, by_place = F.xxhash64("sample_id"), F.xxhash64("sample_id", F.col("sample_start").cast("int"))
    samples = sift(texts, by_doc, wanted, by_doc, found.n_keys)

    def blocks(clean: Column) -> Column:
        starts = F.when(F.size(clean) >= size, F.sequence(F.lit(1), F.size(clean) - (size - 1)))
        return F.transform(starts, lambda i: F.struct(i.alias("sample_start"), block_at(clean, i, size).alias("block")))

    placed = samples.select("sample_id", F.inline(TX.let(clean_lines(F.col("_text"), F.col("_lang"), style), blocks)))
    read = sift(placed, by_place, wanted, by_place, found.n_keys).select(
        digest(F.col("block")).alias("key"), "sample_id", "sample_start",
        word_count(F.col("block")).alias("tokens"), TX.clip(F.col("block"), snippet_chars).alias("code_snippet"))
    # A stand-in may belong to two documents: only the right one has the text.  Documents that share an id have it twice.
    return read.join(wanted, ["key", "sample_id", "sample_start"]).dropDuplicates(["key"]).select(
        F.lower(F.hex("key")).alias("key"), F.lit(size).alias("lines"), "tokens", "n_locations", "code_snippet")


def duplicate_locations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        lang: Column | None = None,
                        style: LC.CommentStyle = LC.DUPLICATE_STYLE,
                        size: int = V.WINDOW_LINES,
                        min_chars: int = V.WINDOW_MIN_CHARS, parts: int = PARTS,
                        found: Duplicates | None = None) -> DataFrame:
    """Every location of every duplicated block, one row each; ``parts`` as in ``attach``."""
    found = found or find(docs, id_col, text_col, lang, style, size, min_chars)
    keys = found.keys.select("key", "n_locations")
    return attach(found.repeated(), keys, "key", "n_locations", [id_col, "clean_start"], parts).select(
        F.lower(F.hex("key")).alias("key"), id_col, "clean_start",
        (F.col("clean_start") + (size - 1)).alias("clean_end"), "line", "n_locations")


def duplicate_smells(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lang: Column | None = None,
                     style: LC.CommentStyle = LC.DUPLICATE_STYLE,
                     size: int = V.WINDOW_LINES,
                     min_chars: int = V.WINDOW_MIN_CHARS, found: Duplicates | None = None) -> DataFrame:
    """One issue per (block, document), at the document's first location."""
    found = found or find(docs, id_col, text_col, lang, style, size, min_chars)
    keys = found.keys.select("key", "n_locations")
    hit = attach(found.repeated(firsts=True), keys, "key", "n_locations", [id_col, "clean_start"])
    return hit.select(
        id_col, F.lit(V.CODE_SMELLS).alias("category"), F.lit("duplicate_code").alias("type"),
        F.format_string(f"Part of duplicated code block ({size} lines) found in %d location(s)",
                        F.col("n_locations")).alias("description"),
        F.lit("high").alias("severity"), F.col("clean_start").alias("line"),
        F.lit(None).cast("string").alias("context"),
    )
