"""Function structure against the language's own parser."""

import ast
import sysconfig
import time
from pathlib import Path

from pyspark.sql import functions as F

from corpusqa import values as V
from corpusqa.functions.blanking import blank_braces, blank_python
from corpusqa.operators import metrics as M, structure as S


def modules(n):
    out = []
    for path in sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py")):
        text = path.read_text(encoding="utf8", errors="ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError):
            continue
        if len(text) < 60_000:
            out.append(text)
        if len(out) == n:
            break
    return out


BLOCKS = (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.AsyncFor, ast.AsyncWith)


def expected(doc, text):
    functions, nesting = [], []

    def deepen(node, name, depth):
        if isinstance(node, BLOCKS):
            depth += 1
            if depth > 4:
                nesting.append((doc, name, depth, node.lineno))
        for child in ast.iter_child_nodes(node):
            deepen(child, name, depth)

    for n in ast.walk(ast.parse(text)):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = n.args
            params = len(a.posonlyargs + a.args + a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
            complexity = 1
            for m in ast.walk(n):
                complexity += isinstance(m, (ast.If, ast.While, ast.For, ast.Try, ast.AsyncFor))
                if isinstance(m, ast.BoolOp) and isinstance(m.op, ast.And):
                    complexity += len(m.values) - 1
            functions.append((doc, n.name, n.lineno, n.end_lineno, params, complexity))
            deepen(n, n.name, 0)
    return functions, nesting


def test_against_the_parser(spark, docs):
    texts = modules(60)
    frame = docs(texts)
    functions, nesting = [], []
    for i, t in enumerate(texts):
        f, n = expected(i, t)
        functions += f
        nesting += n
    assert len(functions) > 1000 and nesting
    got = [(r.doc_id, r.name, r.line, r.end_line, r.params, r.complexity)
           for r in S.functions(frame).collect()]
    assert sorted(got) == sorted(functions)
    got = [(r.doc_id, r.name, r.level, r.line) for r in S.deep_nesting(frame).collect()]
    assert sorted(got) == sorted(nesting)


SOURCE = '''
async def five(a, b, /, c, *, d, e):
    return a and b


def six(
    a: dict[str, int] = {"x": (1, 2)},
    b=lambda x, y: (x, y), *args,
    c=[1, 2], d="def no(a, b): # c", **kw,
) -> tuple[int, int]:
    """if x and y:
for z in w:
    """
    for i in [j for j in a if j]:
        while i:
            i -= 1
    for k in a:
        pass
    if a:
        pass
    elif b:
        pass
    elif c:
        pass
    elif d:
        pass
    elif e:
        inner = 1

        def inner_one(): return (
1 and 2)
    else:
        pass
    return 1
'''


def test_limits_and_shapes(spark, docs):
    long = "def f50():\n" + "    x\n" * 49 + "def f51():\n" + "    x\n" * 50 + "\n\n# end\n"
    complex_ = ("def c10():\n" + "    if a: pass\n" * 9 + "def c11():\n" + "    if a: pass\n" * 10)
    frame = docs([("Python", SOURCE), ("Python", long), ("Python", complex_)])
    got = {r.name: r for r in S.functions(frame).collect()}
    assert {n: (r.params, r.complexity) for n, r in got.items()} == {
        "five": (5, 2), "six": (6, 10), "inner_one": (0, 2), "f50": (0, 1), "f51": (0, 1),
        "c10": (0, 10), "c11": (0, 11)}
    assert (got["f50"].lines, got["f51"].lines) == (50, 51)
    issues = M.document_issues(frame, F.col("lang")).collect()
    found = {(i.type, i.doc_id) for i in issues}
    assert {("too_many_parameters", 0), ("deep_nesting", 0), ("nested_loops", 0),
            ("long_function", 1), ("high_complexity", 2)} <= found
    assert [i.description for i in issues if i.type == "long_function"] == [
        "Function 'f51' is approx. 51 lines long"]
    assert sorted(i.description for i in issues if i.type == "deep_nesting") == [
        "Deep nesting (level 5) in function 'six'"]
    loops = [i for i in issues if i.type == "nested_loops"]
    assert len(loops) == 1 and loops[0].severity == "high" and loops[0].category == V.PERFORMANCE


SCRIPT = """function foo(a) {
  for (let i = 0; i < 3; i++) {  // for (;;) {
    while (x) { y("}"); }
  }
  for (const z of q) w();
  if (a) { while (b) c(); }
}
const long = (a) => {
""" + "x;\n" * 51 + """}
let short = function() { do { i++ } while (i < 3); for (;;) for (;;) z(); }
"""


def test_braces(spark, docs):
    frame = docs([("JavaScript", SCRIPT), ("C#", "foreach (a) {\n foreach (b) { }\n}"),
                  ("Java", "foreach (a) {\n foreach (b) { }\n}"), ("Go", "for {\n for {}\n}")])
    st = S.brace_structure(F.col("text"), F.col("lang"))
    got = {r.doc_id: r for r in frame.select(
        "doc_id", st["loops"].alias("loops"), S.brace_functions(st).alias("f")).collect()}
    assert [(x.line, x.inner_line) for x in got[0].loops] == [(2, 3), (61, 61)]
    assert [(f.name, f.line, f.end_line) for f in got[0].f] == [
        ("foo", 1, 7), ("long", 8, 60), ("short", 61, 61)]
    assert [(x.line, x.inner_line) for x in got[1].loops] == [(1, 2)]
    assert got[2].loops == []
    assert [(x.line, x.inner_line) for x in got[3].loops] == [(1, 2)]
    long = [i for i in M.document_issues(frame, F.col("lang")).collect() if i.type == "long_function"]
    assert [i.description for i in long] == ["Function 'long' is 52 lines long"]


def test_block_extents(spark, docs):
    frame = docs(["H one\n  x\n  H two\n    y\n\n  z\nH three"])
    got = sorted((r.line, r.end_line) for r in S.block_extents(frame, "^H").collect())
    assert got == [(1, 6), (3, 4), (7, 7)]


def seconds(frame):
    begin = time.perf_counter()
    n = frame.count()
    return time.perf_counter() - begin, n


def test_many_functions_in_linear_time(docs):
    """Four times the functions of a document: far from sixteen times the time."""
    for text, run in (
        ("def f(a): return a\n", S.functions),
        ("def f(a):\n  return a\n", lambda d: S.block_extents(d, r"^def ")),
        ("function f(a) { return a; }\n", lambda d: d.select(F.inline(S.brace_functions(
            S.brace_structure(F.col("text"), F.lit("javascript")))))),
    ):
        run(docs([text * 10])).count()
        short, n = seconds(run(docs([text * 2_000])))
        long, m = seconds(run(docs([text * 8_000])))
        assert (n, m) == (2_000, 8_000)
        assert long < 10 * short + 3


def test_functions_over_many_chunks(docs):
    """State is carried from chunk to chunk: one function around a thousand lines."""
    text = "def f(a):\n" + "    if a:\n        g(a)\n" * 500 + "def h(): pass\n"
    rows = {r["name"]: r for r in S.functions(docs([text])).collect()}
    assert (rows["f"]["line"], rows["f"]["end_line"], rows["f"]["complexity"]) == (1, 1001, 501)
    assert (rows["h"]["line"], rows["h"]["end_line"]) == (1002, 1002)


def test_issues_read_a_text_once(docs):
    """The structure is folded once for all the issues read from it, and the text is made once for the fold."""
    assert str(S.structure_issues(S.structure(F.upper("text")))).count("upper(text)") == 1
    text = "\n".join(["def f(a, b, c, d, e, g):"] + ["  " * (k + 1) + "for i in a:" for k in range(6)] + ["x = 1"] * 3)
    frame = docs([text, None]).select("doc_id", F.inline(S.structure_issues(S.structure(F.col("text")))))
    found = sorted((r["type"], r["line"]) for r in frame.collect())
    assert found == sorted([("too_many_parameters", 1), ("deep_nesting", 6), ("deep_nesting", 7)]
                           + [("nested_loops", k) for k in range(2, 7)])


def test_blanking_with_and_without_marks(docs):
    texts = ["a = 'x\u0001y' \u0001 # \u0001\nb", "a # ' \nb = \"\"\"\n#\n\"\"\" 'c", None, "", "'''a\n'''/* b */"]
    got = {r["doc_id"]: r["b"] for r in docs(texts).select("doc_id", blank_python(F.col("text")).alias("b")).collect()}
    assert got == {0: "a = 0 \u0002 \nb", 1: "a \nb = 0\n\u0001\n\u0001 'c", 2: None, 3: "", 4: "0\n\u0001/* b */"}
    braces = ["x /* a\n' */ + 'b' // c\n`d\n`/ 2", None, "a / b /* c"]
    got = {r["doc_id"]: r["b"] for r in docs(braces).select("doc_id", blank_braces(F.col("text")).alias("b")).collect()}
    assert got == {0: "x \n + 0 \n0\n\u0001/ 2", 1: None, 2: "a / b /* c"}
