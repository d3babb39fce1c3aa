"""Column builders against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusqa import values as V
from corpusqa.functions import linecodes as LC, text as TX
from corpusqa.functions.blanking import blank_python
from corpusqa.functions.locate import matches
from corpusqa.functions.patterns import SPACE_CHARS, java
from corpusqa.operators import lines as L, rules as R

PIECES = ["if True", "x = x", "a == b", "\n", " ", "eval (", "password = 'p'", "é", "return\nNone",
          "naïve_x", "==", "while  True", "\r\n", "\t", "def f(a=[])", "import *", "from m import *",
          "except :", "$('", "foo", "innerHTML=", " ", "run x + y", "query ${", "$"]


def random_texts(n, seed, pieces=PIECES, size=25):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def test_split_and_strip(spark, docs):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd e\x85f", " \t x　\xa0",
             "\r\n", "a\n\r"] + random_texts(60, 1)
    got = docs(texts).select(
        "doc_id", TX.splitlines(F.col("text")).alias("s"), TX.lines(F.col("text")).alias("l"),
        TX.strip(F.col("text")).alias("t")).collect()
    for r in got:
        text = texts[r.doc_id]
        assert r.s == text.splitlines()
        assert r.l == text.split("\n")
        assert r.t == text.strip()
    assert all(c.isspace() for c in SPACE_CHARS)


ALL_RULES = V.ISSUE_RULES + V.SIMPLE_CODE_RULES


def test_matches_equal_finditer(spark, docs):
    texts = random_texts(200, 2)
    frame = docs(texts)
    got = frame.select("doc_id", *[
        matches(F.col("text"), java(r.pattern, ignore_case=r.ignore_case)).alias(f"r{i}")
        for i, r in enumerate(ALL_RULES)]).collect()
    seen = set()
    for row in got:
        text = texts[row.doc_id]
        for i, rule in enumerate(ALL_RULES):
            want = [(text.count("\n", 0, m.start()) + 1, m.group(0)) for m in re.finditer(
                rule.pattern, text, re.IGNORECASE if rule.ignore_case else 0)]
            assert [(m.line, m.text) for m in row[f"r{i}"]] == want, (rule.name, text)
            if want:
                seen.add(rule.name)
    assert len(seen) >= 12


def test_issue_lines_and_context(spark, docs):
    texts = random_texts(200, 3)
    got = docs(texts).select("doc_id", R.rule_issues(F.col("text"), ALL_RULES).alias("i")).collect()
    for row in got:
        text = texts[row.doc_id]
        want = [(r.name, r.severity, n, text.split("\n")[n - 1].strip())
                for r in ALL_RULES for n in (
                    text.count("\n", 0, m.start()) + 1 for m in re.finditer(
                        r.pattern, text, re.IGNORECASE if r.ignore_case else 0))]
        assert [(i.type, i.severity, i.line, i.context) for i in row.i] == want


def test_fast_forms_hit_the_same_lines(spark, docs):
    pieces = ["execute", "query", "run", "+", "$", "{", "${", "\n", "x", " ", "x_1", "==", "="]
    texts = random_texts(300, 4, pieces, 30)
    fast = [r for r in ALL_RULES if r.fast]
    got = docs(texts).select("doc_id", R.rule_issues(F.col("text"), fast).alias("i")).collect()
    for row in got:
        text = texts[row.doc_id]
        want = [(r.name, text.count("\n", 0, m.start()) + 1) for r in fast
                for m in re.finditer(r.pattern, text, re.IGNORECASE if r.ignore_case else 0)]
        assert [(i.type, i.line) for i in row.i] == want, text


def test_long_lines_do_not_backtrack(spark, docs):
    long = "run " * 40_000
    frame = docs([("python", long), ("python", "a" * 200_000 + " ="), ("python", "(" * 50_000)])
    assert R.rule_scan(frame, V.ISSUE_RULES, lang=F.col("lang")).count() == 0
    assert L.file_stats(frame).count() == 3


COMMENT_PIECES = ["/*", "*/", "x", "", "# c", "// c", "a /* b", "b */ c", "/* d */", "*/ e /*", "  ", "-- z"]


def comment_texts(n, seed):
    rnd = random.Random(seed)
    return ["\n".join(rnd.choice(COMMENT_PIECES) for _ in range(rnd.randint(1, 9))) for _ in range(n)]


def basic_counts(text):
    blank = comment = 0
    inside = False
    for line in (x.strip() for x in text.splitlines()):
        if not line:
            blank += 1
            continue
        if "/*" in line and "*/" not in line:
            inside = True
        if inside or line.startswith(("#", "//", "--", "%")):
            comment += 1
            inside = inside and "*/" not in line
    n = len(text.splitlines())
    return n, max(0, n - blank - comment), comment, blank


def test_basic_counts(spark, docs):
    texts = comment_texts(300, 5) + ["", "\n"]
    got = L.file_stats(docs(texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.lines, r.code, r.comments, r.blank) == basic_counts(texts[r.doc_id]), texts[r.doc_id]


def advanced_reading(text, lang):
    """Density comment lines, and islands of code-like comments, by plain loops."""
    markers = V.LINE_MARKERS.get(lang, V.DEFAULT_MARKERS)
    block = lang in V.BLOCK_LANGUAGES
    inside, runs, run = False, [], []

    def turn(line, inside):
        if block:
            at = line.find("/*")
            if at >= 0 and "*/" not in line[at + 2:]:
                inside = True
            if "*/" in line and inside:
                inside = False
        return inside

    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if not line:
            continue
        inside = turn(line, inside)
        if inside or line.startswith(tuple(markers)):
            body = line
            for m in markers:
                if body.startswith(m):
                    body = body[len(m):].strip()
                    break
            if any(re.search(p, body) for p in V.CODE_INDICATORS):
                run.append(n)
        else:
            runs.append(run)
            run = []
    runs.append(run)
    density = 0
    for raw in text.split("\n"):
        line = raw.strip()
        density += inside or line.startswith(tuple(markers))
        inside = turn(line, inside)
    return density, [(r[0], r[-1], len(r)) for r in runs if len(r) > 1]


@pytest.mark.parametrize("lang", ["JavaScript", "Python", "Go", "PHP"])
def test_density_and_islands(spark, docs, lang):
    extra = ["# x = 1", "// if (a)", "# prose", "// y = 2", "code()"]
    rnd = random.Random(6)
    texts = ["\n".join(rnd.choice(COMMENT_PIECES + extra) for _ in range(rnd.randint(1, 10)))
             for _ in range(150)]
    frame = docs([(lang, t) for t in texts])
    metrics = {r.doc_id: r for r in L.file_metrics(frame, lang=F.col("lang")).collect()}
    runs = {r.doc_id: [(i.line, i.end_line, i.n) for i in r.i] for r in frame.select(
        "doc_id", L.comment_islands(F.col("text"), F.col("lang")).alias("i")).collect()}
    for i, text in enumerate(texts):
        density, want = advanced_reading(text, lang)
        assert metrics[i].comment_lines == density, text
        assert runs[i] == want, text


def test_line_classes_add_up(spark, docs):
    texts = comment_texts(100, 7)
    frame = docs(texts)
    got = {}
    for r in L.line_classes(frame).groupBy("doc_id", "class").count().collect():
        got[r.doc_id, r["class"]] = r["count"]
    for r in L.file_stats(frame).collect():
        assert got.get((r.doc_id, "blank"), 0) == r.blank
        assert got.get((r.doc_id, "comment"), 0) == r.comments
        assert got.get((r.doc_id, "code"), 0) == r.code == r.lines - r.comments - r.blank


def test_blanking_keeps_lines(spark, docs):
    texts = ["x = 'a # b'  # c 'd\ny = \"\"\"1\n# 2\n3\"\"\" + z\n", "'" + "a" * 300_000 + "'\nq"]
    got = {r.doc_id: r.b for r in docs(texts).select(
        "doc_id", blank_python(F.col("text")).alias("b")).collect()}
    assert got[0] == "x = 0  \ny = 0\n\u0001\n\u0001 + z\n"
    assert got[1] == "0\nq"


def test_annotated_codes(spark, docs):
    frame = docs([("JavaScript", "/* a\nb\n\nc */ d\ne"), ("Python", "/* a\nb")])
    code = LC.codes(TX.lines(F.col("text")), F.col("lang"), LC.ADVANCED_STYLE)
    got = {r.doc_id: r.c for r in frame.select("doc_id", LC.annotate(code).alias("c")).collect()}
    assert got == {0: "Opibicip", 1: "pp"}
