"""Lexical blanking: strings and comments out, line numbers kept.

One alternation consumes strings and comments from left to right, so a quote in
a comment or a comment sign in a string is read correctly.  Possessive, unrolled
forms keep Java's matcher out of recursion on long literals.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from corpusqa.functions.text import let

INSIDE = "\u0001"  # starts a line that began inside a string

# The look-ahead turns most characters down with one test.
PYTHON = (
    r"(?s)(?=['\"#])(?:'''[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+'''"
    r'|"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+"""'
    r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
    r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
    r"|#[^\n]*+)"
)
BRACES = (
    r"(?s)(?=['\"`/])(?:/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/|//[^\n]*+"
    r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
    r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
    r"|`[^`\\]*+(?:\\.[^`\\]*+)*+`)"
)


def blank(text: Column, pattern: str, *comments: str) -> Column:
    """Strings become ``0``, matches that start with one of ``comments`` vanish; line breaks stay."""
    def stand_in(m: Column) -> Column:
        breaks = F.when(~m.contains("\n"), "").otherwise(F.regexp_replace(m, r"[^\n]+", ""))
        comment = reduce(or_, [m.startswith(c) for c in comments])
        return F.when(comment, breaks).otherwise(
            F.concat(F.lit("0"), F.replace(breaks, F.lit("\n"), F.lit("\n" + INSIDE))))

    def of(clean: Column) -> Column:
        gaps = F.split(clean, pattern, -1)
        found = F.regexp_extract_all(clean, F.lit(pattern), F.lit(0))
        # One gap more than matches: the last pair has no match.
        return F.array_join(F.zip_with(
            gaps, found, lambda g, m: F.concat(g, F.coalesce(stand_in(m), F.lit("")))), "")

    # The text may be costly to make and is read twice.
    return let(text, lambda t: let(F.when(t.contains(INSIDE), F.translate(t, INSIDE, "\u0002")).otherwise(t), of))


def blank_python(text: Column) -> Column:
    return blank(text, PYTHON, "#")


def blank_braces(text: Column) -> Column:
    return blank(text, BRACES, "/*", "//")
