"""Import extraction, import resolution and the link graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusqa.functions import text as TX
from corpusqa.functions.blanking import blank_python
from corpusqa.functions.patterns import AFTER_WORD, WORD, java
from corpusqa.operators import paths as P
from corpusqa.operators.skew import attach
from corpusqa.sources.tables import written

_MODULE = f"[{WORD}.]"


def python_imports(text: Column, keep_dots: bool = False) -> Column:
    """array<string>: modules a Python text imports, distinct.

    Strings and comments are blanked first.  Leading dots of a relative import
    are dropped, and an import with nothing but dots with them, unless asked for.
    """
    code = F.replace(blank_python(text), F.lit("\\\n"), F.lit(" "))
    plain = F.regexp_extract_all(code, F.lit(r"(?md)(?:^|[;:])[ \t]*import[ \t]+([^\n;]+)"), F.lit(1))
    names = F.flatten(F.transform(plain, lambda s: F.transform(
        F.split(s, ","), lambda n: F.regexp_extract(TX.strip(n), f"^{_MODULE}+", 0))))
    froms = F.transform(
        F.regexp_extract_all(code, F.lit(
            rf"(?md)(?:^|[;:])[ \t]*from[ \t]*([. \t]*{_MODULE}*)[ \t]+import{AFTER_WORD}"), F.lit(1)),
        lambda m: F.regexp_replace(m, r"[ \t]", ""))
    if not keep_dots:
        froms = F.transform(froms, lambda m: F.regexp_replace(m, r"^\.+", ""))
    return _distinct(F.concat(names, froms))


def loose_imports(text: Column) -> Column:
    """Fallback: any word after ``from`` or ``import``."""
    return _distinct(F.regexp_extract_all(
        text, F.lit(java(r"(?:from|import)\s+([\w\.]+)")), F.lit(1)))


def javascript_imports(text: Column) -> Column:
    """ES module imports and ``require`` calls."""
    es = java(r"import\s+.*from\s+['\"]([^'\"]+)['\"]")
    require = java(r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")
    return _distinct(F.concat(
        F.regexp_extract_all(text, F.lit(es), F.lit(1)),
        F.regexp_extract_all(text, F.lit(require), F.lit(1))))


def pattern_imports(text: Column, pattern: str) -> Column:
    """Group 1 of every match of a Java pattern."""
    return _distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def _distinct(names: Column) -> Column:
    return F.filter(F.array_distinct(names), lambda m: m != "")


def dependencies(text: Column, lang: Column) -> Column:
    """Modules by the language's own way of importing; none for other languages."""
    return (F.when(lang == "Python", python_imports(text))
            .when(lang.isin("JavaScript", "TypeScript"), javascript_imports(text))
            .otherwise(F.array().cast("array<string>")))


def edges_of(docs: DataFrame, modules: Column, id_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rows ids, module.  Distinct in each document, so no shuffle is needed."""
    return docs.select(*id_cols, F.explode(modules).alias("module"))


def node_id(path: Column) -> Column:
    """A stable id that needs no global numbering."""
    return F.md5(path)


def link_nodes(files: DataFrame, path: str = "path", root: str = "") -> DataFrame:
    """Graph nodes: id, label (path in the project), title (full path)."""
    p = F.col(path)
    label = P.normalise(P.relative(p, root) if root else p)
    return files.select(node_id(p).alias("id"), label.alias("label"), p.alias("title")).distinct()


def _base_path(path: Column, module: Column, root: str) -> Column:
    """Where a module would be, without its file suffix."""
    dots = F.length(F.regexp_extract(module, r"^\.*", 0))
    name = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    folders = F.split(P.dirname(path), "/")
    up = F.array_join(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - dots + 1, F.lit(0))), "/")
    prefix = F.when(dots > 0, up).otherwise(F.lit(root.rstrip("/")))
    return F.concat_ws("/", F.when((prefix != "") | (dots == 0) & F.lit(bool(root)), prefix),
                       F.when(name != "", name))


def path_key(path: Column) -> Column:
    """16 bytes that stand for a path, so that paths are compared and shuffled at one width."""
    return F.unhex(F.md5(path))


def link_graph(files: DataFrame, deps: DataFrame, path: str = "path", root: str = "",
               suffix: str = ".py", package: str = "/__init__.py") -> DataFrame:
    """Edges between files: from_path, to_path.

    A module is the file ``<module><suffix>``, or else ``<module><package>``, of
    the corpus.  Modules are resolved once each, not once per import, into a written table, so a
    module that everything imports costs one lookup, and the imports get the
    answer back by the skew-safe join.  Files that import nothing are nodes too.
    """
    base = _base_path(F.col(path), F.col("module"), root)
    wanted = written(deps.select(F.col(path).alias("from_path"), base.alias("base")).select(
        "from_path", path_key(F.concat("base", F.lit(suffix))).alias("as_file"),
        path_key(F.concat("base", F.lit(package))).alias("as_package")), "imports")
    # A module of no file stays in, without a path: such a module may be the hot one.
    modules = wanted.groupBy("as_file", "as_package").agg(F.count(F.lit(1)).alias("n"))
    paths = files.select(F.col(path).alias("found")).distinct().select(path_key(F.col("found")).alias("key"), "found")
    file, folder = paths.toDF("as_file", "file"), paths.toDF("as_package", "folder")
    facts = written(modules.join(file, "as_file", "left").join(folder, "as_package", "left").select(
        "as_file", "n", F.coalesce("file", "folder").alias("to_path")), "modules")
    return (attach(wanted.select("from_path", "as_file"), facts, "as_file", "n", ["from_path"])
            .filter(F.col("from_path") != F.col("to_path"))
            .select("from_path", "to_path").distinct())
