"""Comment and string segments, keyword references, task markers, word counts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusqa import values as V
from corpusqa.functions import text as TX
from corpusqa.functions.locate import matches
from corpusqa.functions.patterns import AFTER_WORD, BEFORE_WORD, WORD, WORD_RUN, java, literal

# Where a line comment ends: at its line's end, or ("to_end") at the text's end.
_REST = {"line": r"[^\n]*+\n?", "to_end": r"(?s:.*+)"}
_BLOCK = r"(?s:/\*.*?\*/)"
_COMMENT_STARTS = ("#", "//", "/*")
_STRING_STARTS = ('"', "'", "`")
_SEGMENTS = "array<struct<line:int,text:string>>"
_STRINGS = (r'(?s:""".*?""")', r"(?s:'''.*?''')", r'(?s:".*?")', r"(?s:'.*?')", r"(?s:`.*?`)")


def comment_pattern(scope: str = "line") -> str:
    # The look-ahead turns most characters down with one test.
    return rf"(?=[#/])(?:(?:#|//){_REST[scope]}|{_BLOCK})"


def segment_pattern(scope: str = "line") -> str:
    """Comments first, then string literals, in one alternation."""
    parts = "|".join((comment_pattern(scope), *_STRINGS))
    return rf"(?=[#/\"'`])(?:{parts})"


# Written into "/*" where no "*/" follows, once more than a text has it in a row.
_NO_END = "\uffff"


def _segments(text: Column, pattern: str, starts: Sequence[str]) -> Column:
    """``matches`` of a pattern with block comments, in time linear in the text.  Each match starts with one of ``starts``,
    so that a plain substring search skips most texts of prose.

    Each ``/*`` without a ``*/`` behind it would be looked at to the text's end, only to fail;
    behind the last ``*/`` they are made unlike a comment for the search.
    """
    def searched(t: Column) -> Column:
        last = F.instr(F.reverse(t), "/*")  # from the end; 0 if there is no "*/"
        head = F.when(last > 0, F.length(t) - last + 1).otherwise(0)
        runs = F.transform(F.regexp_extract_all(t, F.lit(f"{_NO_END}++"), F.lit(0)), lambda r: F.length(r))
        longest = F.when(t.contains(_NO_END), F.array_max(runs)).otherwise(0)
        found = F.struct(head.alias("head"), F.concat(F.lit("/"), F.repeat(F.lit(_NO_END), longest + 1), F.lit("*")).alias("mask"))

        def masked(f: Column) -> Column:
            return F.struct(F.concat(F.left(t, f["head"]), F.replace(F.substr(t, f["head"] + 1), F.lit("/*"), f["mask"])).alias("text"),
                            f["mask"].alias("mask"))

        return F.when(t.contains("/*"), TX.let(found, masked)).otherwise(F.struct(t.alias("text"), F.lit("").alias("mask")))

    def of(t: Column) -> Column:
        found = TX.let(searched(t), lambda s: F.transform(matches(s["text"], pattern), lambda m: F.struct(
            m["line"].alias("line"), F.replace(m["text"], s["mask"], F.lit("/*")).alias("text"))))
        return F.when(~TX.has_any(t, starts), F.array().cast(_SEGMENTS)).otherwise(found)

    return TX.let(text, of)


def _keyword_pattern(word: str) -> str:
    p = literal(word)
    return java(p if " " in word else rf"\b{p}\b", ignore_case=True)


def lexicon_hits(text: Column, words: Sequence[str] = V.KEYWORDS, scope: str = "line",
                 limit: int = V.CONTEXT_CHARS) -> Column:
    """array<struct<line, keyword, context>>: each word once per segment that has it."""
    any_word = "|".join(f"(?:{_keyword_pattern(w)})" for w in words)
    segments = F.filter(_segments(text, segment_pattern(scope), (*_COMMENT_STARTS, *_STRING_STARTS)),
                        lambda s: s["text"].rlike(any_word))
    return F.flatten(F.transform(segments, lambda s: F.transform(
        F.filter(
            F.array(*[F.when(s["text"].rlike(_keyword_pattern(w)), F.lit(w)) for w in words]),
            lambda w: w.isNotNull(),
        ),
        lambda w: F.struct(s["line"].alias("line"), w.alias("keyword"),
                           TX.clip(_trim_break(s["text"]), limit, strip_after=True).alias("context")),
    )))


def lexicon_refs(docs: DataFrame, words: Sequence[str] = V.KEYWORDS,
                 id_cols: Sequence[str] = ("doc_id",), text_col: str = "text",
                 scope: str = "line", limit: int = V.CONTEXT_CHARS) -> DataFrame:
    """One row per (comment or string segment, word in it): ids, line, keyword, context."""
    return docs.select(*id_cols, F.inline(lexicon_hits(F.col(text_col), words, scope, limit)))


def first_hit(docs: DataFrame, words: Sequence[str] = V.KEYWORDS,
              id_cols: Sequence[str] = ("doc_id",), text_col: str = "text",
              scope: str = "line") -> DataFrame:
    """Per document with hits: how many, and the first one."""
    def summary(hits: Column) -> Column:
        first = F.array_min(F.transform(hits, lambda h: F.struct(
            h["line"].alias("line"), h["keyword"].alias("keyword"))))
        return F.struct(F.size(hits).alias("n"), first["line"].alias("first_line"),
                        first["keyword"].alias("first_keyword"))

    hits = TX.let(lexicon_hits(F.col(text_col), words, scope), summary)
    return docs.select(*id_cols, TX.one_row(hits, lambda r: r["n"] > 0))


def lexicon_rollup(refs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Hits per document and in all; ``total`` is 1 for that row."""
    return refs.rollup(id_col).agg(F.grouping_id().alias("total"), F.count(F.lit(1)).alias("n"))


def _trim_break(segment: Column) -> Column:
    return F.regexp_replace(segment, r"\n\z", "")


def marker_counts(text: Column, markers: Sequence[str] = V.TASK_MARKERS,
                  scope: str = "line") -> Column:
    """array<struct<marker, n>>: comments that hold each marker, zero counts too."""
    return TX.let(_segments(text, comment_pattern(scope), _COMMENT_STARTS), lambda comments: F.array(*[
        F.struct(
            F.lit(m).alias("marker"),
            F.size(F.filter(comments, lambda c: c["text"].rlike(
                java(r"(?:\W|^)" + literal(m) + r"[:\s]", ignore_case=True)))).alias("n"),
        ) for m in markers
    ]))


def task_markers(docs: DataFrame, markers: Sequence[str] = V.TASK_MARKERS,
                 id_cols: Sequence[str] = ("doc_id",), text_col: str = "text",
                 scope: str = "line") -> DataFrame:
    """Rows ids, marker, n for the markers a document has."""
    counts = F.filter(marker_counts(F.col(text_col), markers, scope), lambda c: c["n"] > 0)
    return docs.select(*id_cols, F.inline(counts))


def marker_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("marker").agg(F.sum("n").alias("n"))


_TWO_UNITS = r"[\x{10000}-\x{10ffff}]"


def wildcard_count(text: Column, words: Sequence[str] = V.WILDCARD_WORDS) -> Column:
    """Whole-word hits of all words; ``*`` stands for any word characters."""
    def total(patterns: Sequence[str]) -> Column:
        return sum((F.regexp_count(text, F.lit(p)) for p in patterns), F.lit(0))

    # Behind a letter of two code units a word may start inside another word: each word is counted by itself.
    return F.when(text.rlike(_TWO_UNITS), total([_wildcard_pattern(w) for w in words])).otherwise(
        total(_wildcard_patterns(words)))


def _wildcard_patterns(words: Sequence[str]) -> list[str]:
    """Patterns whose hits add up to those of all words, as few as can be.

    A word of letters, digits and ``*`` fits nothing but one whole word, so words that start with different letters
    never fit the same one and are looked for together.
    """
    groups: list[dict[str, str]] = []  # first letter: the rest of the pattern
    alone = []
    for word in map(_collapse, words):
        if not re.fullmatch("[A-Za-z][A-Za-z0-9_*]*", word):
            alone.append(_wildcard_pattern(word))
            continue
        first = word[0].lower()
        group = next((g for g in groups if first not in g), None)
        if group is None:
            groups.append(group := {})
        group[first] = java(r"\w*".join(literal(part) for part in word[1:].split("*")))
    return [_merged(g) for g in groups] + alone


def _merged(group: dict[str, str]) -> str:
    by_rest: dict[str, str] = {}
    for first, rest in group.items():
        by_rest[rest] = by_rest.get(rest, "") + first
    branches = "|".join(f"(?<=[{firsts}]){rest}{AFTER_WORD}" for rest, firsts in by_rest.items())
    # The first letter is tried before the word boundary: it fails sooner.
    firsts = "".join(group)
    return f"(?iu)[{firsts}](?<![{WORD}][{firsts}])(?:{branches})"


def _wildcard_pattern(word: str) -> str:
    word = _collapse(word)
    if word == "*":
        return WORD_RUN
    body = java(r"\w*".join(literal(part) for part in word.split("*")))
    if word.startswith("*"):
        return f"(?iu){BEFORE_WORD}{body}{AFTER_WORD}"
    # The first letter is tried before the word boundary: it fails sooner.
    start = literal(word[0])
    return f"(?iu){start}(?<![{WORD}]{start}){body[len(start):]}{AFTER_WORD}"


def _collapse(word: str) -> str:
    while "**" in word:
        word = word.replace("**", "*")
    return word


def wildcard_counts(docs: DataFrame, words: Sequence[str] = V.WILDCARD_WORDS,
                    id_cols: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Rows ids, n for the documents with at least one hit."""
    n = F.struct(wildcard_count(F.col(text_col), words).alias("n"))
    return docs.select(*id_cols, TX.one_row(n, lambda r: r["n"] > 0))


# Possessive forms: a shorter take would end inside a word and fail the boundary.
NAMING_PATTERNS = {
    "snake": r"\b[a-z0-9]++(?:_[a-z0-9]++)++\b",
    "camel": r"\b[a-z]++(?:[A-Z][a-z0-9]*+)++\b",
    "pascal": r"\b[A-Z][a-z0-9]++(?:[A-Z][a-z0-9]*+)*+\b",
    "screaming": r"\b[A-Z0-9]++(?:_[A-Z0-9]++)++\b",
}
# The capital is tried before the word boundary: it fails sooner.
_PASCAL = f"[A-Z](?<![{WORD}][A-Z])[a-z0-9]++(?:[A-Z][a-z0-9]*+)*+{AFTER_WORD}"


def naming_columns(text: Column) -> list[Column]:
    """Counts of each style; what a style cannot do without is looked for first."""
    def count(name: str) -> Column:
        return F.regexp_count(text, F.lit(java(NAMING_PATTERNS[name])))

    columns = {
        "snake": F.when(~text.contains("_"), 0).otherwise(count("snake")),
        "camel": F.when(~text.rlike("[A-Z](?<=[a-z][A-Z])"), 0).otherwise(count("camel")),
        "pascal": F.regexp_count(text, F.lit(_PASCAL)),
        "screaming": F.when(~text.contains("_"), 0).otherwise(count("screaming")),
    }
    return [columns[name].alias(name) for name in NAMING_PATTERNS]


def naming_styles(docs: DataFrame, id_cols: Sequence[str] = ("doc_id",),
                  text_col: str = "text") -> DataFrame:
    return docs.select(*id_cols, *naming_columns(F.col(text_col)))


def identifiers(text: Column) -> Column:
    """All identifier tokens: words that start with an ASCII letter or underscore."""
    return F.regexp_extract_all(text, F.lit(java(r"\b[a-zA-Z_]\w*+")), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_RUN))


def top_tokens(text: Column, k: int = V.TOP_TOKENS) -> Column:
    """array<struct<token, n>>: the document's most frequent tokens.

    Sorted and counted inside the row, so a document's own counts need no
    shuffle; ties go to the smaller token.
    """
    ranked = F.array_sort(F.transform(
        TX.run_lengths(identifiers(text)),
        lambda r: F.struct((-r["n"]).alias("neg"), r["value"].alias("token")),
    ))
    return F.transform(F.slice(ranked, 1, k), lambda r: F.struct(
        r["token"].alias("token"), (-r["neg"]).alias("n")))


def token_topk(docs: DataFrame, id_cols: Sequence[str] = ("doc_id",), text_col: str = "text",
               k: int = V.TOP_TOKENS) -> DataFrame:
    """Rows ids, token, n: top ``k`` tokens of each document."""
    return docs.select(*id_cols, F.inline(top_tokens(F.col(text_col), k)))


def token_totals(docs: DataFrame, text_col: str = "text", k: int | None = None) -> DataFrame:
    """Corpus token counts: exact, or the sum of each document's top ``k``."""
    if k is None:
        return (docs.select(F.explode(identifiers(F.col(text_col))).alias("token"))
                .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    return (docs.select(F.inline(top_tokens(F.col(text_col), k)))
            .groupBy("token").agg(F.sum("n").alias("n")))
