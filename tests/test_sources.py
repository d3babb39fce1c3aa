"""Trees of files, decoding, paths, imports, advisories."""

import json

import pytest
from pyspark.sql import functions as F

from corpusqa import values as V
from corpusqa.operators import advisories as A, deps as D, paths as P
from corpusqa.plans import passes
from corpusqa.sources import files as SF, tree as T

TREE = {
    "app.py": b"import utils\nfrom models.user import User\nimport flask\n",
    "utils.py": b"import os, datetime as dt\n",
    "models/user.py": b"from sqlalchemy import *\n",
    "models/__init__.py": b"",
    "UPPER.PY": b"x = 1\n",
    "notes.txt": b"no source",
    "Makefile": b"all:",
    ".hidden.py": b"x",
    ".cache/a.py": b"x",
    "node_modules/b.js": b"x",
    "sub/build/c.py": b"x",
    "sub/web/page.html": b"<p>",
    "requirements.txt": b"flask==1.0.0\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, content in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return str(root)


KEPT = {"app.py", "utils.py", "models/user.py", "models/__init__.py", "UPPER.PY", "sub/web/page.html"}


def test_scan(spark, tree):
    assert {r.rel_path for r in SF.scan_files(spark, tree).collect()} == KEPT
    assert {r.rel_path for r in SF.scan_files(spark, "file:" + tree).collect()} == KEPT
    paths = spark.createDataFrame([(n,) for n in TREE], "path string")
    assert {r.path for r in SF.scan_filter(paths, F.col("path")).collect()} == KEPT


def test_scan_in_small_splits(spark, tree):
    listed = T.list_files(spark, tree, [".py"], ignored=["build"])
    df = T.read_files(listed, tree, split_bytes=5000, max_bytes=30)
    assert df.rdd.getNumPartitions() > 1
    big = {r.rel_path: r.content for r in df.collect()}
    assert big["app.py"] is None and big["utils.py"] == bytearray(TREE["utils.py"])


def test_many_nested_folders_are_listed_by_tasks(spark, tmp_path):
    """A chain of 60, 300 side by side, and one that holds most files; few directories for a task."""
    want, chain = set(), tmp_path
    for i in range(60):
        chain = chain / f"d{i}"
        chain.mkdir()
        (chain / "c.py").write_text("x")
        want.add(str((chain / "c.py").relative_to(tmp_path)))
    for i in range(300):
        (tmp_path / "wide" / f"w{i}").mkdir(parents=True)
        (tmp_path / "wide" / f"w{i}" / "w.py").write_text("x" * i)
        want.add(f"wide/w{i}/w.py")
    (tmp_path / "many").mkdir()
    for i in range(2500):
        (tmp_path / "many" / f"m{i}.py").write_text("")
        want.add(f"many/m{i}.py")
    for deep, most in ((7, 20), (1000, 10_000)):
        got = [r.rel_path for r in T.list_files(spark, str(tmp_path), [".py"], deep=deep, most=most).collect()]
        assert len(got) == len(want) and set(got) == want
    assert SF.scan_files(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == 60 + sum(range(300))


def test_empty_tree(spark, tmp_path):
    assert SF.scan_files(spark, str(tmp_path)).count() == 0


def test_requirement_file(spark, tree):
    files = SF.scan_files(spark, tree, names=V.REQUIREMENT_FILES)
    assert "requirements.txt" in {r.rel_path for r in files.collect()}
    rows = spark.createDataFrame(
        [("a/pyproject.toml",), ("a/requirements.in",), ("b/requirements.txt",),
         ("b/pyproject.toml",), ("c/setup.py",)], "path string")
    got = SF.requirement_files(rows, P.dirname(F.col("path")), P.basename(F.col("path"))).collect()
    assert {r.path for r in got} == {"a/requirements.in", "b/requirements.txt"}


BYTES = [
    (b"", "N/A (Empty)", ""), (b"abc", "ascii", "abc"), ("é".encode(), "utf-8", "é"),
    (b"\xef\xbb\xbfabc", "UTF-8-SIG", "abc"), ("aé".encode("utf-16"), "UTF-16", "aé"),
    (b"a\xffb", "other", "a�b"),
]


def test_encodings(spark):
    rows = spark.createDataFrame([(i, b) for i, (b, _, _) in enumerate(BYTES)], "i int, b binary")
    got = rows.select("i", SF.encoding_label(F.col("b")).alias("label"),
                      SF.decode(F.col("b")).alias("text"),
                      SF.decode(F.col("b"), "ignore").alias("kept")).collect()
    for r in got:
        assert (r.label, r.text) == BYTES[r.i][1:]
    assert {r.i: r.kept for r in got}[5] == "ab"
    census = {r.encoding: (r.n, r.percentage) for r in SF.encoding_census(rows, F.col("b")).collect()}
    assert census["ascii"] == (1, 16.7) and len(census) == 6


def test_paths(spark):
    rows = spark.createDataFrame([("a/b.tar.gz",), (".bashrc",), ("x/.y.py",), ("a..b",), ("A/B.TSX",),
                                  ("c\\d//e.h",), ("none",)], "p string")
    p = P.normalise(F.col("p"))
    got = [tuple(r) for r in rows.select(
        p, P.dirname(p), P.basename(p), P.extension(p), P.stem(p), P.language_of(p),
        P.language_of(p, V.FINE_LANGUAGES)).collect()]
    assert got == [
        ("a/b.tar.gz", "a", "b.tar.gz", ".gz", "a/b.tar", "Unknown", "Unknown"),
        (".bashrc", "", ".bashrc", "", ".bashrc", "Unknown", "Unknown"),
        ("x/.y.py", "x", ".y.py", ".py", "x/.y", "Python", "Python"),
        ("a..b", "", "a..b", ".b", "a.", "Unknown", "Unknown"),
        ("A/B.TSX", "A", "B.TSX", ".TSX", "A/B", "JavaScript", "TypeScript"),
        ("c/d/e.h", "c/d", "e.h", ".h", "c/d/e", "C/C++", "C/C++"),
        ("none", "", "none", "", "none", "Unknown", "Unknown"),
    ]


IMPORTS = '''import a.b, c as d
from e.f import (g,
   h)
from . import sibling
from .rel import x; import tail
from ..up.two import y
try: import inline
except ImportError: pass
"""
import in_string
"""
# import in_comment
import cont, \\
    inued
importer = 1
from star import *
'''


def test_python_imports(docs):
    frame = docs([IMPORTS])
    plain = frame.select(D.python_imports(F.col("text"))).first()[0]
    assert sorted(plain) == sorted(
        ["a.b", "c", "e.f", "rel", "tail", "up.two", "inline", "cont", "inued", "star"])
    dotted = frame.select(D.python_imports(F.col("text"), keep_dots=True)).first()[0]
    assert {".", ".rel", "..up.two"} <= set(dotted)
    loose = frame.select(D.loose_imports(F.col("text"))).first()[0]
    assert "in_string" in loose and "e.f" in loose


def test_javascript_imports(docs):
    frame = docs([("JavaScript", "import x from 'a'\nimport {y,\n z} from \"b\"\nconst c = require( 'c' )\n"
                   "import w from 'a'")])
    assert sorted(frame.select(D.dependencies(F.col("text"), F.col("lang"))).first()[0]) == ["a", "c"]


def test_graph(spark, tree):
    corpus = passes.read_corpus(spark, tree)
    requirements = spark.createDataFrame(
        [("p", "flask==1.0.0"), ("p", "requests>=2.20"), ("q", "# none"), ("q", "Flask == 2.0")],
        "project string, line string")
    table = spark.createDataFrame(
        [("flask", "<1.0.1", "old", "1"), ("flask", "<9", "ignored", "41002"),
         ("requests", "<9", "not pinned", "2")],
        "package string, affected string, description string, id string")
    out = passes.dependency_pass(corpus, requirements, table)
    assert {(r.from_path, r.to_path) for r in out["edges"].collect()} == {
        ("app.py", "utils.py"), ("app.py", "models/user.py")}
    assert {r.label for r in out["nodes"].collect()} == KEPT - {"sub/web/page.html"}
    assert [(r.project, r.id) for r in out["findings"].collect()] == [("p", "1")]
    assert {r.project: r.status for r in out["status"].collect()} == {"p": "Vulnerable", "q": "Secure"}


def test_relative_and_package_targets(spark):
    files = spark.createDataFrame([(p,) for p in (
        "/r/a/b/m.py", "/r/a/b/n.py", "/r/a/__init__.py", "/r/a/c.py", "/r/top.py", "/r/a/b/__init__.py")],
        "path string")
    deps = spark.createDataFrame([
        ("/r/a/b/m.py", ".n"), ("/r/a/b/m.py", "..c"), ("/r/a/b/m.py", ".."), ("/r/a/b/m.py", "a"),
        ("/r/a/b/m.py", "a.b.m"), ("/r/a/b/m.py", "top"), ("/r/a/b/m.py", "missing"),
        ("/r/a/b/m.py", ".")], "path string, module string")
    got = {r.to_path for r in D.link_graph(files, deps, root="/r").collect()}
    assert got == {"/r/a/b/n.py", "/r/a/c.py", "/r/a/__init__.py", "/r/top.py", "/r/a/b/__init__.py"}


def test_version_ranges(spark):
    cases = [("1.0", ">=1.0,<1.4", True), ("1.4", ">=1.0,<1.4", False), ("1.10", "<1.9", False),
             ("1.9", "<1.10", True), ("1.0.0", "==1", True), ("2", "<1|>=2", True), ("1.5", "<1|>=2", False),
             ("3.1", "!=3.1", False), ("0.9", ">=1.0", False), ("1.4", "<=1.4.0", True)]
    rows = spark.createDataFrame(cases, "v string, r string, want boolean")
    bad = rows.filter(A.in_range(F.col("v"), F.col("r")) != F.col("want")).collect()
    assert bad == []
    status = A.scan_status(spark.createDataFrame([("a",), ("b",)], "project string"),
                           spark.createDataFrame([("b",)], "project string"),
                           spark.createDataFrame([], "project string"))
    assert {r.project: r.status for r in status.collect()} == {"a": "No File", "b": "Secure"}


def test_requirement_lines(spark):
    rows = spark.createDataFrame([("Zope.Interface[x] == 5.0 ; python_version > '3'",), ("-r other",),
                                  ("plain",), ("a>=1,<2  # c",)], "line string")
    got = [(r.package, r.operator, r.installed) for r in A.parse_requirements(rows).collect()]
    assert got == [("zope-interface", "==", "5.0"), ("plain", "", ""), ("a", ">=", "1")]


def test_passes_on_a_tree(spark, tree, tmp_path):
    from corpusqa.operators import report

    corpus = passes.read_corpus(spark, tree)
    basic = passes.basic_pass(corpus)
    assert basic["totals"].first().files == len(KEPT)
    assert {r.lang for r in basic["languages"].collect()} == {"Python", "HTML"}
    out = passes.advanced_pass(corpus)
    issues = out["issues"].collect()
    assert [(i.doc_id, i.type) for i in issues] == [("models/user.py", "import_star")]
    details = {r.doc_id: json.loads(r.details_json) for r in out["file_details"].collect()}
    assert details["models/user.py"]["all_issues"]["code_smells"][0]["type"] == "import_star"
    report.write_issues(out["issues"], str(tmp_path / "issues"))
    assert spark.read.parquet(str(tmp_path / "issues")).count() == 1
    report.write_details(out["file_details"], str(tmp_path / "details"))
    assert spark.read.text(str(tmp_path / "details")).count() == len(KEPT)
    assert out["metrics"].first().files == len(KEPT)
    assert {(r.doc_id, r.module) for r in out["dependencies"].collect()} >= {("app.py", "flask")}
    assert passes.lexicon_pass(corpus)["personas"].count() == len(KEPT)


def test_versions(spark):
    from corpusqa.operators import advisories

    cases = [("1.0rc1", "<1.0", True), ("1.0", "<1.0rc1", False), ("1.5", "~=1.4", True), ("2.0", "~=1.4", False), ("1.4", "==1.*", True), ("1.0", "*", True),
             ("v1.2", "<1.3", True), ("1!1.0", "<2.0", False), ("1.0.post1", ">1.0", True), ("1.0.dev1", "<1.0a1", True), ("1.0+local", "==1.0", True),
             ("1.123456789012345678901", "==1.123456789012345678902", False), ("1.10", ">1.9", True), ("1.0.0", "==1", True), ("1.4", ">=2|<1.5,>1.3", True),
             ("1.0a1.dev1", "<2.0", True), ("1.0.post1.dev2", "<2.0", True), ("1.4.0-SNAPSHOT", "<2.0", True), ("v1.4.3", "~=1.4.2", True),
             ("v1.4.1", "==1.4.*", True), ("1.4rc1", "==1.4.*", True), ("2.3", "~=2.2.post3", True), ("1.0a1.dev1", ">=1.0a1", False),
             ("1.0.post1.dev2", "<1.0.post1", True), ("1.0.post1.dev2", ">1.0", True), ("1.0.dev3", "<1.0a1.dev1", True), ("1", "==1.0.*", True),
             ("1.40", "==1.4.*", False), ("1!1.4", "==1.4.*", False), ("1!1.4", "~=1!1.2", True), ("1.0-1", "==1.0.post1", True), ("1.5", "!=1.4.*", True),
             ("1.4.7", "!=1.4.*", False), ("1.4", "what|<2", True), ("1.4", "what,<1", False), ("", "*", True), (" 1.4 ", "", True),
             # The third answer.
             ("1.4", "what", None), ("deadbeef", "<2.0", None), ("", "<2.0", None), ("1.4", "~=1", None), ("1.4", "<=1.*", None),
             ("1.4", "<1.4-x-y", None), ("1." + "9" * 39, ">1", None), (None, "<2.0", None), ("1.4", "what,>1", None), ("=;1", "<2", None)]
    rows = spark.createDataFrame(cases, "v string, r string, want boolean")
    from pyspark.sql import functions as F

    got = advisories.in_range(F.col("v"), F.col("r"))
    assert [tuple(r) for r in rows.select("*", got.alias("got")).where("not (got <=> want)").collect()] == []


def test_unreadable_is_reported(spark):
    installed = spark.createDataFrame([("p", "x", "1.0"), ("q", "x", "deadbeef"), ("r", "x", "3.0"), ("s", "y", "1")], "project string, package string, installed string")
    table = spark.createDataFrame([("x", "<2.0", "d", "A"), ("y", "what", "d", "B")], "package string, affected string, description string, id string")
    found = A.advisory_match(installed, table)
    assert {(r.project, r.answer) for r in found.collect()} == {("p", "affected"), ("q", "unreadable"), ("s", "unreadable")}
    projects = installed.select("project")
    status = A.scan_status(projects, projects, found)
    assert {(r.project, r.status, r.n_findings) for r in status.collect()} == {
        ("p", "Vulnerable", 1), ("q", "Error", 0), ("r", "Secure", 0), ("s", "Error", 0)}


def test_long_documents_stay(spark):
    from corpusqa.operators import lines

    docs = spark.createDataFrame([(1, "x\n" * 100_001), (2, "x\n" * 10)], "doc_id long, text string")
    assert sorted(r.lines for r in lines.file_stats(docs).collect()) == [10, 100_001]


def test_linked_directories_are_not_followed(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("x = 1\n")
    (tmp_path / "a" / "back").symlink_to(tmp_path, target_is_directory=True)
    found = T.read_files(T.list_files(spark, str(tmp_path)), str(tmp_path))
    assert [r["rel_path"] for r in found.select("rel_path").collect()] == ["a/x.py"]
