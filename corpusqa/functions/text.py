"""Strip, split and bind: the pieces every document-local expression uses."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from corpusqa.functions.patterns import SPACE_CHARS

# Breaks of Python's splitlines() other than a plain newline; CR LF is one break.
BREAKS = r"[\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}](?:(?<=\r)\n)?"
BREAK_CHARS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside one expression.

    A lambda variable is evaluated one time per row.  A column made by an
    earlier ``select`` is not safe for this: the optimizer may inline it into a
    lambda, where it would be computed again for each element.
    """
    return F.transform(F.array(value), body).getItem(0)


def fold(items: Column, start: Mapping[str, Column], found: Mapping[str, str],
         step: Callable[[Column, Column], Column], chunk: int = 256) -> Column:
    """struct of the ``start`` fields and the ``found`` arrays after ``step`` has seen every item.

    ``step`` takes such a struct and an item and returns the next struct, with its fields in
    this order.  ``found`` (names and element types) only grows.  A step may copy its state,
    so items are folded by the chunk, each beginning with nothing found: a long document
    does not copy all its earlier results for every line.
    """
    def empty(element: str) -> Column:
        return F.array().cast(f"array<{element}>")

    part = "struct<" + ",".join(f"{n}:array<{kind}>" for n, kind in found.items()) + ">"

    def over(a: Column, some: Column) -> Column:
        begin = F.struct(*[a[n].alias(n) for n in start],
                         *[empty(kind).alias(n) for n, kind in found.items()])
        return F.aggregate(some, begin, step, lambda s: F.struct(
            *[s[n].alias(n) for n in start],
            F.concat(a["_parts"], F.array(F.struct(*[s[n].alias(n) for n in found]))).alias("_parts")))

    def chunks(xs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(chunk))
        return F.transform(starts, lambda i: F.slice(xs, i, chunk))

    def gathered(a: Column, name: str) -> Column:
        return F.flatten(F.transform(a["_parts"], lambda p: p[name])).alias(name)

    first = F.struct(*[c.alias(n) for n, c in start.items()], empty(part).alias("_parts"))
    return F.aggregate(let(items, chunks), first, over, lambda a: F.struct(
        *[a[n].alias(n) for n in start],
        *[gathered(a, n) for n in found]))


def one_row(values: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """Generator of one row from a struct, or of none when ``keep`` says no.

    A filter on a computed column is pushed below it and computes it again, and
    so does each ``struct.field``; a generator evaluates its input once.
    """
    row = F.array(values)
    return F.inline(row if keep is None else F.filter(row, keep))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def has_any(text: Column, parts: Sequence[str]) -> Column:
    return reduce(or_, [text.contains(p) for p in parts])


def lines(text: Column) -> Column:
    """Lines by newline only; a final newline gives a final empty line."""
    return F.split(text, "\n", -1)


def splitlines(text: Column) -> Column:
    """Lines by every Unicode line break; no empty line after a final break."""
    def cut(unix: Column) -> Column:
        body = F.when(unix.endswith("\n"), F.substr(unix, F.lit(1), F.length(unix) - 1)
                      ).otherwise(unix)
        return F.when(unix != "", F.split(body, "\n", -1)).otherwise(
            F.array().cast("array<string>"))

    def unix(t: Column) -> Column:
        # Most texts have newlines only; a plain search is cheaper than the pattern.
        return F.when(has_any(t, BREAK_CHARS), F.regexp_replace(t, BREAKS, "\n")).otherwise(t)

    return let(text, lambda t: let(unix(t), cut))


def numbered(items: Column, name: str = "text") -> Column:
    """array<T> -> array<struct<line:int, name:T>>, counted from 1."""
    return F.transform(
        items, lambda x, i: F.struct((i + 1).alias("line"), x.alias(name))
    )


def clip(text: Column, n: int, strip_after: bool = False) -> Column:
    """First ``n`` characters, with an ellipsis when something was cut."""
    head = F.substring(text, 1, n)
    return F.concat(strip(head) if strip_after else head,
                    F.when(F.length(text) > n, "...").otherwise(""))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def run_lengths(items: Column) -> Column:
    """array<string> -> array<struct<n:int, value:string>>, one per distinct value.

    Sorts, then reads the counts off the run ends: O(n log n), no shuffle.
    """
    def at_ends(xs: Column) -> Column:
        n = F.size(xs)
        ends = F.filter(
            F.sequence(F.lit(1), n),
            lambda i: (i == n) | (F.element_at(xs, i) != F.element_at(xs, F.least(i + 1, n))),
        )
        return let(ends, lambda es: F.transform(
            es,
            lambda e, j: F.struct(
                (e - F.when(j > 0, F.element_at(es, F.greatest(j, F.lit(1)))).otherwise(0)).alias("n"),
                F.element_at(xs, e).alias("value"),
            ),
        ))

    return F.when(F.size(items) > 0, let(F.array_sort(items), at_ends)).otherwise(
        F.array().cast("array<struct<n:int,value:string>>")
    )
