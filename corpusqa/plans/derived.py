"""Source texts derived from the documents, for the structure operators.

The documents hold prose.  Here Spark puts a line of code before every line of every document, chosen by
the line's length, and makes the line itself a comment, so that the structure operators run on
a corpus that grows with the tables and on all its letters, and the expected rows follow from the line
lengths alone, which is what the SQL computes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusqa import values as V
from corpusqa.functions.linecodes import ADVANCED_STYLE
from corpusqa.operators import deps as D, lexicon as X, lines as L, rules as R, structure as S
from corpusqa.plans.oracle import W, WS, keyword_test, metrics_cte, strip, text
from corpusqa.plans.queries import documents

# The signature at position k has k parameters.
SIGNATURES = (
    "", "a", "a, b=1", "a, b=(1, 2), *c", "a, b, /, c, *, d",
    "a, b, c: dict[str, int], *d, **e", "a, b, c, d, e, f=lambda x, y: x", "a, b, c, d, e, f, g",
)
INDENTS = 10
LANGUAGES = ("Python", "JavaScript", "PHP", "TypeScript", "HTML", "Ruby")
# For each default rule, marker and word a line that it hits, and lines that it just misses.
# The document's own line follows as a comment.
RULE_SHAPES = (
    "except:", "except ValueError:", "from m import *", "from m import n", "def f(a, b=[]):",
    "def f(a, b=None):", "eval(x)", "eval(request)", "var x", "let y", "if (a == b)", "if (a === b)",
    "with (o)", "with o", "cursor.execute(q + v)", "query(`${q}`)", "query(q, v)", "e.innerHTML = v",
    "document.write(v)", "document.writer(v)", "password = 'abc'", 'api-key = "k"', "password = v",
    "for i in range(len(x))", "for i in range(n)", "document.getElementById(v)", "$('a')", "$(a)",
    "if True", "while true", "whilst True", "x = x", "ax = x", "x = xy", "return None", "x == y",
    "# TODO: t", "// fixme: u", "# HACK v", "# XXX:", "# NOTE: w", "# TODOS: none", "// tiny rick",
    "# squanch", "# squanching", "# a portal gun",
)
WORD_SHAPES = tuple(f"{mark} {word}{end}" for word in V.KEYWORDS for mark, end in (("#", ""), ("//", " x"), ("#", "s")))
BLOCK_SHAPES = ("x = 1", "/* a", "b */", "// c", "# d", "/* e */ f", "g */ h /* i", "", "y = 2")


def _pick(choice: Column, *options: Column) -> Column:
    return F.element_at(F.array(*options), choice + 1)


def _rewrite(docs: DataFrame, code, comment: str) -> DataFrame:
    """Each line a line of code by its length and number, and then the line itself as a comment."""
    lines = F.transform(F.split("text", "\n", -1), lambda raw, i: F.concat(
        code(F.length(raw), i + 1), F.lit(f"  {comment} "), raw))
    return docs.select("doc_id", F.array_join(lines, "\n").alias("text"))


def python_texts(s, d) -> DataFrame:
    def code(c: Column, n: Column) -> Column:
        def part(k: int) -> Column:
            return (c % k).cast("string")

        # Deeper line by line, with steps, and back to the margin.
        indent = (n + c % 3) % INDENTS
        return F.concat(F.repeat(F.lit(" "), indent), _pick(
            c % 9,
            F.concat(F.lit("def f"), n.cast("string"), F.lit("("), _pick(c % 8, *map(F.lit, SIGNATURES)), F.lit("):")),
            F.lit("if x and y:"), F.lit("for i in y:"), F.lit("while z and not w and v:"),
            F.lit("with q:"),
            F.concat(F.lit("import m"), part(5), F.lit(".a, n"), part(3), F.lit(" as z")),
            F.concat(F.lit("from .p"), part(4), F.lit(" import q")),
            F.lit("# if x and y:"), F.lit("x = 'def if for' + \"import no\"")))

    return _rewrite(documents(s, d), code, "#")


def brace_texts(s, d) -> DataFrame:
    def code(c: Column, n: Column) -> Column:
        return _pick(
            c % 7, F.lit("for (;;) {"), F.lit("}"), F.lit("while (x) {"), F.lit("y(); // for {"),
            F.concat(F.lit("function f"), n.cast("string"), F.lit("(a) {")), F.lit("}"),
            F.concat(F.lit('import z from "m'), (c % 5).cast("string"), F.lit("\"; q = require('r"),
                     (c % 3).cast("string"), F.lit("')")))

    return _rewrite(documents(s, d), code, "//")


def shaped_texts(s, d, shapes) -> DataFrame:
    """Each line a shape chosen by the line's length, and then the line itself."""
    lines = F.transform(F.split("text", "\n", -1), lambda raw: F.concat(
        _pick(F.length(raw) % len(shapes), *map(F.lit, shapes)), F.lit(" # "), raw))
    return documents(s, d).select(
        "doc_id", _pick((F.col("doc_id") % len(LANGUAGES)).cast("int"), *map(F.lit, LANGUAGES)).alias("lang"),
        F.array_join(lines, "\n").alias("text"))


def default_rules(s, d):
    return R.rule_scan(shaped_texts(s, d, RULE_SHAPES), V.ISSUE_RULES, lang=F.col("lang")).drop("context")


def default_simple_code(s, d):
    return R.match_scan(shaped_texts(s, d, RULE_SHAPES), V.SIMPLE_CODE_RULES).drop("match")


def default_markers(s, d):
    return X.task_markers(shaped_texts(s, d, RULE_SHAPES))


def default_keywords(s, d):
    return X.lexicon_refs(shaped_texts(s, d, WORD_SHAPES)).drop("context")


def block_comments(s, d):
    return L.file_metrics(shaped_texts(s, d, BLOCK_SHAPES), lang=F.col("lang"), style=ADVANCED_STYLE)


def functions(s, d):
    return S.functions(python_texts(s, d))


def deep_nesting(s, d):
    return S.deep_nesting(python_texts(s, d))


def nested_loops(s, d):
    return python_texts(s, d).select("doc_id", F.inline(S.structure(F.col("text"))["loops"]))


def structure_issues(s, d):
    found = S.structure_issues(S.structure(F.col("text")))
    return python_texts(s, d).select("doc_id", F.inline(found)).drop("context", "category")


def python_imports(s, d):
    return D.edges_of(python_texts(s, d), D.python_imports(F.col("text")))


def brace_functions(s, d):
    st = S.brace_structure(F.col("text"), F.lit("JavaScript"))
    return brace_texts(s, d).select("doc_id", F.inline(S.brace_functions(st)))


def brace_loops(s, d):
    st = S.brace_structure(F.col("text"), F.lit("JavaScript"))
    return brace_texts(s, d).select("doc_id", F.inline(st["loops"]))


def javascript_imports(s, d):
    return D.edges_of(brace_texts(s, d), D.javascript_imports(F.col("text")))


def loose_imports(s, d):
    return D.edges_of(documents(s, d), D.loose_imports(F.col("text")))


REGISTERED = (functions, deep_nesting, nested_loops, structure_issues, python_imports,
              brace_functions, brace_loops, javascript_imports, loose_imports,
              default_rules, default_simple_code, default_markers, default_keywords, block_comments)

# --------------------------------------------------------------------- the SQL

_LENGTHS = """r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
  generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
c AS (SELECT doc_id, n, length(raw) AS c FROM r)"""

_INDENTED = f"""{_LENGTHS},
p AS (SELECT doc_id, n, c, c % 9 AS kind, (n + c % 3) % {INDENTS} AS ind FROM c WHERE c % 9 <> 7),
st AS (SELECT a.doc_id, a.n, any_value(a.kind) AS kind, any_value(a.c) AS c,
  min(b.n) FILTER (b.ind <= a.ind) AS stop, max(b.n) AS last FROM p a
  LEFT JOIN p b ON a.doc_id = b.doc_id AND b.n > a.n WHERE a.kind < 5 GROUP BY a.doc_id, a.n),
h AS (SELECT st.doc_id, st.n, st.kind, st.c, coalesce(max(p.n), st.n) AS fin FROM st
  LEFT JOIN p ON p.doc_id = st.doc_id AND p.n > st.n AND (st.stop IS NULL OR p.n < st.stop)
  GROUP BY st.doc_id, st.n, st.kind, st.c),
f AS (SELECT h.doc_id, 'f' || h.n AS name, h.n AS line, h.fin AS end_line, h.fin - h.n + 1 AS lines,
  h.c % 8 AS params, 1 + coalesce(sum(CASE p.kind WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 0 END), 0) AS complexity
  FROM h LEFT JOIN p ON p.doc_id = h.doc_id AND p.n > h.n AND p.n <= h.fin
  WHERE h.kind = 0 GROUP BY h.doc_id, h.n, h.fin, h.c),
dn AS (SELECT x.doc_id, 'f' || d.n AS name, 1 + count(y.n) AS level, x.n AS line FROM h x
  JOIN h d ON d.doc_id = x.doc_id AND d.kind = 0 AND d.n < x.n AND x.n <= d.fin
  LEFT JOIN h y ON y.doc_id = x.doc_id AND y.kind BETWEEN 1 AND 4 AND y.n > d.n AND y.n < x.n AND x.n <= y.fin
  WHERE x.kind BETWEEN 1 AND 4 GROUP BY x.doc_id, d.n, x.n HAVING count(y.n) >= 4),
lp AS (SELECT a.doc_id, a.n AS line, min(b.n) AS inner_line FROM h a JOIN h b ON a.doc_id = b.doc_id
  AND b.n > a.n AND b.n <= a.fin WHERE a.kind IN (2, 3) AND b.kind IN (2, 3) GROUP BY a.doc_id, a.n)"""

_BRACED = f"""{_LENGTHS},
k AS (SELECT *, c % 7 AS kind, CASE WHEN c % 7 IN (0, 2, 4) THEN 1 WHEN c % 7 IN (1, 5) THEN -1 ELSE 0 END AS delta FROM c),
q AS (SELECT *, sum(delta) OVER (PARTITION BY doc_id ORDER BY n) AS depth FROM k),
b AS (SELECT a.doc_id, a.n, any_value(a.kind) AS kind, min(z.n) AS fin FROM q a LEFT JOIN q z
  ON a.doc_id = z.doc_id AND z.n > a.n AND z.depth <= a.depth - 1 WHERE a.delta = 1 GROUP BY a.doc_id, a.n)"""


def _big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def _choice(x: str, values) -> str:
    arms = " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values))
    return f"CASE {x} % {len(values)} {arms} END"


def _shaped(shapes) -> str:
    """l: the lines of ``shaped_texts``, raw and stripped."""
    return f"""{_LENGTHS}, l0 AS (SELECT r.doc_id, r.n, {_choice('r.doc_id', LANGUAGES)} AS lang,
  {_choice('length(r.raw)', shapes)} || ' # ' || r.raw AS raw FROM r),
l AS (SELECT *, {strip('raw')} AS s FROM l0)"""


def _rule_rows(rules, extra: str) -> str:
    """A row per match in a line; a line end may be part of one."""
    line = "(raw || chr(10))"
    parts = []
    for r in rules:
        gate = "TRUE" if "all" in r.languages else f"lower(lang) IN ({', '.join(map(text, r.languages))})"
        flag = "(?i)" if r.ignore_case else ""
        pattern = flag + r.pattern.replace(r"\w", f"[{W}]").replace(r"\s", f"[{WS}]")
        if r.name == "sql_injection":  # the rest of the line belongs to the match
            n = f"CAST(regexp_matches({line}, {text(pattern)}) AS INT)"
        elif r.name == "self_assignment":  # the word after the sign ends the one before it
            pair = f"[{W}]+[{WS}]*=[{WS}]*[{W}]+"
            n = (f"len(list_filter(regexp_extract_all({line}, '{pair}'), lambda x: ends_with("
                 f"lower(regexp_extract(x, '^[{W}]+')), lower(regexp_extract(x, '[{W}]+$')))))")
        else:
            n = f"len(regexp_extract_all({line}, {text(pattern)}))"
        parts.append(f"SELECT doc_id, {extra.format(r=r)}{text(r.name)} AS type, {text(r.description)} AS description, "
                     f"CAST(n AS BIGINT) AS line, unnest(range({n})) AS k FROM l WHERE {gate}")
    return " UNION ALL ".join(parts)


def oracle() -> dict[str, str]:
    smells = " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS type, {message} AS description, 'medium' AS severity, "
        f"CAST(line AS BIGINT) AS line FROM f WHERE {test}" for name, test, message in (
            ("too_many_parameters", "params > 5", "'Function ''' || name || ''' has ' || params || ' parameters'"),
            ("long_function", "lines > 50", "'Function ''' || name || ''' is approx. ' || lines || ' lines long'"),
            ("high_complexity", "complexity > 10",
             "'Function ''' || name || ''' has high cyclomatic complexity (' || complexity || ')'")))
    modules = """SELECT doc_id, 'm' || (c % 5) || '.a' AS module FROM c WHERE c % 9 = 5
  UNION SELECT doc_id, 'n' || (c % 3) FROM c WHERE c % 9 = 5
  UNION SELECT doc_id, 'p' || (c % 4) FROM c WHERE c % 9 = 6"""
    word = r"[\p{L}\p{N}_.]+"
    space = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    shaped = _shaped(RULE_SHAPES)
    comment = "cm AS (SELECT doc_id, n, regexp_extract(raw, '(?:#|//).*') || chr(10) AS seg FROM l)"
    markers = " UNION ALL ".join(
        f"SELECT doc_id, {text(m)} AS marker, CAST(count(*) AS BIGINT) AS n FROM cm "
        f"WHERE regexp_matches(seg, {text(f'(?i)(^|[^{W}]){m}[:{WS}]')}) GROUP BY doc_id" for m in V.TASK_MARKERS)
    keywords = " UNION ALL ".join(
        f"SELECT doc_id, CAST(n AS BIGINT) AS line, {text(k)} AS keyword FROM cm WHERE {keyword_test('seg', k)}"
        for k in V.KEYWORDS)
    return {
        "default_rules": f"""WITH {shaped}, h AS ({_rule_rows(V.ISSUE_RULES, "'{r.category}' AS category, '{r.severity}' AS severity, ")})
  SELECT doc_id, category, type, description, severity, line FROM h""",
        "default_simple_code": f"WITH {shaped}, h AS ({_rule_rows(V.SIMPLE_CODE_RULES, '')}) "
                               "SELECT doc_id, type, description, line FROM h",
        "default_markers": f"WITH {shaped}, {comment} {markers}",
        "default_keywords": f"WITH {_shaped(WORD_SHAPES)}, {comment} {keywords}",
        "block_comments": f"""WITH {_shaped(BLOCK_SHAPES)}, {metrics_cte(ADVANCED_STYLE, 'doc_id')}
  SELECT doc_id, loc, comment_lines, round(comment_lines / loc, 6) AS comment_density,
  round(avg_line_length, 6) AS avg_line_length FROM fm""",
        "functions": f"WITH {_INDENTED} SELECT doc_id, name, "
                     f"{_big('line', 'end_line', 'lines', 'params', 'complexity')} FROM f",
        "deep_nesting": f"WITH {_INDENTED} SELECT doc_id, name, {_big('level', 'line')} FROM dn",
        "nested_loops": f"WITH {_INDENTED} SELECT doc_id, {_big('line', 'inner_line')} FROM lp",
        "structure_issues": f"""WITH {_INDENTED} {smells}
  UNION ALL SELECT doc_id, 'deep_nesting', 'Deep nesting (level ' || level || ') in function ''' || name || '''',
    'high', line FROM dn
  UNION ALL SELECT doc_id, 'nested_loops', 'Nested loops detected (outer loop at line ' || line
    || ', inner at line ' || inner_line || ')', 'high', line FROM lp""",
        "python_imports": f"WITH {_LENGTHS} {modules}",
        "brace_functions": f"""WITH {_BRACED} SELECT doc_id, 'f' || n AS name, CAST(n AS BIGINT) AS line,
  CAST(fin AS BIGINT) AS end_line, CAST(fin - n AS BIGINT) AS lines FROM b WHERE kind = 4 AND fin IS NOT NULL""",
        "brace_loops": f"""WITH {_BRACED} SELECT x.doc_id, CAST(x.n AS BIGINT) AS line,
  CAST(min(y.n) AS BIGINT) AS inner_line FROM b x JOIN b y ON x.doc_id = y.doc_id AND y.n > x.n
  AND (x.fin IS NULL OR y.n < x.fin) WHERE x.kind <> 4 AND y.kind <> 4 GROUP BY x.doc_id, x.n""",
        "javascript_imports": f"""WITH {_LENGTHS} SELECT doc_id, 'm' || (c % 5) AS module FROM c WHERE c % 7 = 6
  UNION SELECT doc_id, 'r' || (c % 3) FROM c WHERE c % 7 = 6""",
        "loose_imports": f"""SELECT DISTINCT doc_id,
  unnest(regexp_extract_all(text, {text('(?:from|import)' + space + '(' + word + ')')}, 1)) AS module FROM documents""",
    }
