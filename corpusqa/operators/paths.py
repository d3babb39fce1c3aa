"""Path algebra and language lookup, on columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from corpusqa import values as V


def normalise(path: Column) -> Column:
    """Forward slashes, no doubled ones."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/{2,}", "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Last suffix of the base name; leading dots are part of the name."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.substr(path, F.lit(1), F.length(path) - F.length(extension(path)))


def relative(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(
        basename(path))


def language_of(path: Column, languages: Mapping[str, Sequence[str]] = V.COARSE_LANGUAGES) -> Column:
    """Language by file extension, ``Unknown`` if there is none."""
    pairs = [x for lang, exts in languages.items() for e in exts for x in (F.lit(e), F.lit(lang))]
    return F.coalesce(F.create_map(*pairs)[F.lower(extension(path))], F.lit("Unknown"))
