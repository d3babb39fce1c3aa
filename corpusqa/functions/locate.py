"""Where does a pattern match?  Line numbers in one pass, without a UDF.

A sentinel is written in front of every match and the marked text is split into
lines; the sentinels on a line are the matches that start there.  That is linear
in the text, also for patterns that run over a line end.  The pattern itself runs
once; what is read back afterwards is found by the sentinel.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusqa.functions.text import let, lines, strip

SENTINEL = "\u0001"
END = "\u0002"
# A text that has these characters itself is searched with each written as two others.
_ESCAPE = "\u0003"
_ESCAPED = ((_ESCAPE, _ESCAPE + "\u0005"), (SENTINEL, _ESCAPE + "\u0004"), (END, _ESCAPE + "\u0006"))


def unmarked(text: Column) -> Column:
    """The text without the sentinel, ready to be marked."""
    out = text
    for char, pair in _ESCAPED:
        out = F.replace(out, F.lit(char), F.lit(pair))
    return F.when(text.rlike(f"[{SENTINEL}{END}{_ESCAPE}]"), out).otherwise(text)


def restored(text: Column) -> Column:
    """What ``unmarked`` has written for a text, or for a part of it, as it was."""
    out = text
    for char, pair in reversed(_ESCAPED):
        out = F.replace(out, F.lit(pair), F.lit(char))
    return F.when(text.contains(_ESCAPE), out).otherwise(text)


def mark(clean: Column, pattern: str, lead: bool = False) -> Column:
    """Write the sentinel in front of every match.  With ``lead`` the match is the pattern's group ``hit``, and a
    group ``lead`` stands before it."""
    return F.regexp_replace(clean, pattern, f"${{lead}}{SENTINEL}${{hit}}" if lead else SENTINEL + "$0")


def _hit_rows(marked: Column) -> Column:
    rows = F.transform(lines(marked), lambda x, i: F.struct((i + 1).alias("line"), x.alias("raw")))
    return F.filter(rows, lambda h: h["raw"].contains(SENTINEL))


def _count(raw: Column) -> Column:
    return F.length(raw) - F.length(F.replace(raw, F.lit(SENTINEL), F.lit("")))


def hit_lines(marked: Column) -> Column:
    """array<struct<line:int, n:int, context:string>>: lines where matches start."""
    return F.transform(_hit_rows(marked), lambda h: F.struct(
        h["line"].alias("line"),
        _count(h["raw"]).alias("n"),
        strip(restored(F.replace(h["raw"], F.lit(SENTINEL), F.lit("")))).alias("context"),
    ))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<line:int, text:string>>: every match with its first line."""
    def read(marked: Column) -> Column:
        starts = F.flatten(F.transform(
            _hit_rows(marked), lambda h: F.array_repeat(h["line"], _count(h["raw"]))))
        found = F.regexp_extract_all(marked, F.lit(f"{SENTINEL}([^{END}]*+)"), F.lit(1))
        return F.zip_with(starts, found, lambda n, m: F.struct(n.alias("line"), restored(m).alias("text")))

    return let(F.regexp_replace(unmarked(text), pattern, SENTINEL + "$0" + END), read)


def positions(codes: Column, char: str) -> Column:
    """1-based positions of one character in a string of line codes."""
    chars = F.transform(F.split(codes, ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("i")))
    return F.transform(F.filter(chars, lambda x: x["c"] == char), lambda x: x["i"])
