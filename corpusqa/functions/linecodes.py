"""Comment state as a string of line codes.

Whether a line lies in a block comment depends on the lines before it.  Instead
of exploding the lines and running a window over them (a shuffle of the whole
corpus), each document gets a string with one code character per line, and one
regex replacement carries the open block forward.  It is linear in the number
of lines and needs no exchange.

Codes: ``b`` blank, ``p`` plain, ``o`` opens a block, ``c`` closes one, ``x``
closes and then opens again on the same line; ``m O C X`` are the same with a
comment marker at the start.  In an annotated string an ``i`` follows each line
at whose start a block is open.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from corpusqa import values as V
from corpusqa.functions.text import let, strip

_CARRY = r"(?:(?<=[oO])|(?!^)\G(?<![cCxX]))(.)"

# Which annotated codes count as a comment line, per reading.
BASIC_COMMENT = "[OmCX]i?|oi?|[cxp]i"
ADVANCED_COMMENT = "[mOCX]i?|oi?|pi"
KEPT_LINE = "^[pc]$"


@dataclass(frozen=True)
class CommentStyle:
    """Comment markers per language, and which languages have block comments.

    ``block_languages`` of None gives every language block comments.
    """

    markers: Mapping[str, Sequence[str]]
    default: Sequence[str] = V.DEFAULT_MARKERS
    block_languages: Sequence[str] | None = V.BLOCK_LANGUAGES
    block_open: str = "/*"
    block_close: str = "*/"


BASIC_STYLE = CommentStyle({}, V.BASIC_MARKERS, None)
ADVANCED_STYLE = CommentStyle(V.LINE_MARKERS)
DUPLICATE_STYLE = CommentStyle(
    V.DUPLICATE_MARKERS, block_languages=V.DUPLICATE_BLOCK_LANGUAGES
)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _starts(line: Column, markers: Sequence[str]) -> Column:
    return _any([line.startswith(m) for m in markers])


def has_marker(line: Column, lang: Column, style: CommentStyle) -> Column:
    """Does a stripped line start with a comment marker of its language?"""
    groups: dict[tuple[str, ...], list[str]] = {}
    for language, markers in style.markers.items():
        groups.setdefault(tuple(markers), []).append(language)
    hit = _starts(line, style.default)
    for markers, languages in groups.items():
        hit = F.when(lang.isin(*languages), _starts(line, markers)).otherwise(hit)
    return hit


def strip_marker(line: Column, lang: Column, style: CommentStyle) -> Column:
    """Drop the first marker that fits, and the space after it."""
    def cut(markers: Sequence[str]) -> Column:
        out = line
        for m in reversed(list(markers)):
            out = F.when(line.startswith(m),
                         strip(F.substr(line, F.lit(len(m) + 1)))).otherwise(out)
        return out

    groups: dict[tuple[str, ...], list[str]] = {}
    for language, markers in style.markers.items():
        groups.setdefault(tuple(markers), []).append(language)
    hit = cut(style.default)
    for markers, languages in groups.items():
        hit = F.when(lang.isin(*languages), cut(markers)).otherwise(hit)
    return hit


def codes(lines: Column, lang: Column, style: CommentStyle) -> Column:
    """Code string, one character per line, not annotated yet."""
    def code(raw: Column) -> Column:
        return let(strip(raw), lambda s: F.when(s == "", "b").otherwise(coded(s)))

    def coded(s: Column) -> Column:
        marker = has_marker(s, lang, style)
        closes = s.contains(style.block_close)
        opens = s.contains(style.block_open)
        after_open = F.substr(s, F.instr(s, style.block_open) + len(style.block_open))
        reopens = closes & opens & ~after_open.contains(style.block_close)
        event = (F.when(reopens, "x").when(closes, "c").when(opens, "o").otherwise("p"))
        if style.block_languages is not None:
            event = F.when(lang.isin(*style.block_languages), event).otherwise("p")
        return F.when(marker, F.translate(event, "pocx", "mOCX")).otherwise(event)

    return F.array_join(F.transform(lines, code), "")


def annotate(code: Column) -> Column:
    """Carry open blocks forward: ``i`` after each line that starts inside one."""
    return F.regexp_replace(code, _CARRY, "$1i")


def tokens(annotated: Column) -> Column:
    """One element per line of an annotated string."""
    return F.regexp_extract_all(annotated, F.lit(".i?"), F.lit(0))


def count_codes(annotated: Column, pattern: str) -> Column:
    """How many lines have a code that fits ``pattern``."""
    return F.regexp_count(annotated, F.lit(pattern))


def density_comments(code: Column) -> Column:
    """Comment lines of the density reading.

    It starts from the block state left at the end of the file, so an
    unterminated block also covers the lines up to the first block event.
    """
    inside = count_codes(annotate(code), "[mOCX]i?|[bpocx]i")
    lead = F.regexp_extract(code, "^([bpm]*[oOcCxX])", 1)
    wrapped = F.length(F.regexp_replace(lead, "[mOCX]", ""))
    return inside + F.when(code.rlike("[oO][bpm]*$"), wrapped).otherwise(0)
