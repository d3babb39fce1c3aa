"""Plans that must hold at any size, total orders, bit filters, growth of every default pattern, odd characters."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusqa import values as V
from corpusqa.functions import locate
from corpusqa.functions.patterns import java
from corpusqa.operators import bits, deps as D, dups, lexicon as X, metrics as M, rank, rules as R, smells as SM, structure as S
from corpusqa.plans import extended, queries as Q

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(plan):
    """Columns of the output of each exchange, as far as the plan's text shows them: the lines of what is below it."""
    return [line for line in plan.split("\n") if "Exchange" in line and "Broadcast" not in line]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled_columns(df):
    """Names of all columns that go through a shuffle of this plan."""
    out = set()

    def walk(node):
        if node.nodeName() == "Exchange":
            names = node.output()
            out.update(names.apply(i).name() for i in range(names.length()))
        kids = node.children()
        for i in range(kids.length()):
            walk(kids.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_no_text_is_shuffled_for_duplicates(spark, no_broadcast):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = F.col("lang")
    found = dups.find(docs, lang=lang)
    for df in (dups.duplicate_blocks(docs, lang=lang, found=found), dups.duplicate_locations(docs, lang=lang, found=found),
               dups.duplicate_smells(docs, lang=lang, found=found), M.issues_per_file(docs, lang, found=found),
               dups.duplicate_keys(dups.windows(docs, lang=lang))):
        names = shuffled_columns(df)
        assert names and not names & {"text", "_text", "block"}, names


def test_windows_are_computed_once(spark, no_broadcast):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = dups.find(docs, lang=F.col("lang"))
    for df in (dups.duplicate_locations(docs, lang=F.col("lang"), found=found), dups.duplicate_smells(docs, lang=F.col("lang"), found=found)):
        assert "md5" not in plan_of(df) and "documents.parquet" not in plan_of(df)


def test_unique_windows_end_before_the_second_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = dups.find(docs, lang=F.col("lang"))
    repeated = found.windows.join(found.keys, "key", "left_semi").count()
    every, sifted = found.windows.count(), found.repeated().count()
    assert repeated <= sifted <= repeated + max(20, (every - repeated) / 8)
    assert found.repeated().join(found.keys, "key", "left_semi").count() == repeated


def test_documents_that_share_an_id_show_a_block_once(spark):
    block = "\n".join(f"statement number {i} does something useful here" for i in range(5))
    docs = spark.createDataFrame([(1, block), (1, block), (2, block)], "doc_id bigint, text string")
    got = dups.duplicate_blocks(docs).collect()
    assert [(r.n_locations, r.lines) for r in got] == [(3, 5)]
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert [r.n_locations for r in dups.duplicate_blocks(named).collect()] == [3]


@pytest.mark.parametrize("n_keys", [0, 1, 300, 1 << 40])
def test_sift_loses_no_key(spark, n_keys):
    rows = spark.range(5000).withColumn("h", F.xxhash64("id"))
    keys = spark.range(min(n_keys, 300)).select(F.xxhash64("id").alias("k"))
    got = {r.id for r in bits.sift(rows, F.col("h"), keys, F.col("k"), n_keys).collect()}
    want = set(range(min(n_keys, 300)))
    assert want <= got and (n_keys > 300 or len(got - want) < 900)


# Total orders

def test_numbered_is_a_total_order_without_a_one_task_window(spark):
    rnd = random.Random(5)
    rows = [(i, 7 if i % 3 else rnd.randint(0, 50), rnd.choice([None, "a", "b"])) for i in range(4000)]
    df = spark.createDataFrame(rows, "id bigint, n int, g string").repartition(7)
    got = sorted((r.position, r.id) for r in rank.numbered(df, [F.desc("n"), "id"], parts=9).collect())
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert got == [(k + 1, i) for k, i in enumerate(want)]
    per = rank.numbered(df, [F.desc("n"), "id"], by=["g"], parts=9).collect()
    for g in (None, "a", "b"):
        mine = sorted((r.position, r.id) for r in per if r.g == g)
        assert mine == [(k + 1, r[0]) for k, r in enumerate(sorted((r for r in rows if r[2] == g), key=lambda r: (-r[1], r[0])))]
    assert rank.numbered(df.limit(0), ["id"]).count() == 0


def test_rows_to_number_are_made_once(spark):
    """Finding the ranges of an order does not make the rows a second time."""
    made = spark.sparkContext.accumulator(0)

    def seen(i):
        made.add(1)
        return i

    rows = spark.range(500).select(F.udf(seen, "bigint")("id").alias("id"), F.lit("g").alias("g"))
    assert sum(r.n for r in rank.chunks(rows, "g", "id", 100).collect()) == 500
    assert made.value == 500


def test_chunks_are_bounded_and_whole(spark):
    df = spark.range(2500).select((F.col("id") % 3 == 0).cast("string").alias("g"), "id")
    got = rank.chunks(df, "g", "id", 100).collect()
    assert max(r.n for r in got) == 100 and all(len(r.ids) == r.n and r.ids == sorted(r.ids) for r in got)
    assert sorted(i for r in got for i in r.ids) == list(range(2500))
    assert {(r.g, r.chunk) for r in got} == {("true", k + 1) for k in range(9)} | {("false", k + 1) for k in range(17)}


def test_link_graph_is_a_few_joins(spark, no_broadcast):
    graph = Q.link_graph(spark, SF)
    assert plan_of(graph).count("Join") <= 5


# Patterns

def seconds(spark, pattern, text):
    compiled = spark._jvm.java.util.regex.Pattern.compile(pattern)
    best = 9e9
    for _ in range(3):
        begin = time.perf_counter()
        compiled.matcher(text).results().count()
        best = min(best, time.perf_counter() - begin)
    return best


OPENERS = {
    "mutable_default": ("def f(a, b\n", "def f(a=1, b\n", "def f(a = = =\n", "def def\n"),
    "eval_usage": ("eval \n",), "bare_except": ("except \n",), "import_star": ("from a import \n", "from a \n"), "var_usage": ("var\n",),
    "triple_equals": ("a =\n",), "with_statement": ("with \n",), "sql_injection": ("execute query run\n", "execute $ $ $\n"),
    "xss": ("innerHTML \n", "document.write \n"), "eval_input": ("eval(a eval(b\n",), "hardcoded_credentials": ("password = '\n", "api_key =\n", "password = \"'\n"),
    "inefficient_loop": ("for i in range(len(\n",), "multiple_dom_access": ("$( \n",), "if_true": ("if \n",), "while_true": ("while \n",),
    "self_assignment": ("a = \n", "abc abc\n"), "return_none": ("return \n",), "self_comparison": ("a == \n", "a =\n"),
}


@pytest.mark.parametrize("rule", [*V.ISSUE_RULES, *V.SIMPLE_CODE_RULES], ids=lambda r: f"{r.name}-{r.category}-{r.languages[0]}")
def test_default_patterns_are_linear(spark, rule):
    """Twice the lines that open a match and never end it: at most 2.5 times the time."""
    pattern = R.compiled(rule)
    for line in (*OPENERS[rule.name], "plain text of words\n"):
        seconds(spark, pattern, line * 2000)  # warm
        n = 20_000
        for attempt in range(4):
            short, long = seconds(spark, pattern, line * n), seconds(spark, pattern, line * (2 * n))
            if long <= 2.5 * short or long < 0.02:
                break
        else:
            raise AssertionError((line, short, long))


def test_mutable_defaults_as_the_plain_pattern_says(spark, docs):
    rule = next(r for r in V.PYTHON_RULES if r.name == "mutable_default")
    rnd = random.Random(8)
    parts = ["def f(", "def g (", "a=[]", "b={}", "c=()", "d=1", ",", ")", "):", "\n", " = ", "(", "[]", "undef h(", "def", "x", "= [ ]", "=\n{}", "()"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(1, 30))) for _ in range(600)]
    got = {(r.doc_id, r.line) for r in R.rule_scan(docs(texts), [rule]).collect()}
    want = {(i, t.count("\n", 0, m.start()) + 1) for i, t in enumerate(texts) for m in re.finditer(rule.pattern, t)}
    assert got == want
    n = R.rule_scan(docs(texts), [rule]).count()
    assert n == sum(len(re.findall(rule.pattern, t)) for t in texts)


def test_control_characters_stay_in_contexts(spark, docs):
    text = 'password = "a\x01b\x02\x03\x04"\n\x03\x05 x\npassword = "\x01"'
    rule = next(r for r in V.SECURITY_RULES if r.name == "hardcoded_credentials")
    got = sorted((r.line, r.context) for r in R.rule_scan(docs([text]), [rule]).collect())
    assert got == [(1, 'password = "a\x01b\x02\x03\x04"'), (3, 'password = "\x01"')]
    frame = spark.createDataFrame([("".join(random.Random(i).choices("\x01\x02\x03\x04\x05\x06ab\n", k=30)),) for i in range(300)], "t string")
    assert frame.filter(locate.restored(locate.unmarked(F.col("t"))) != F.col("t")).count() == 0


def test_open_comments_beside_odd_characters(spark, docs):
    text = "/￿* x\n/￿￿* /* rick */ morty /* rick"
    got = [(r.line, r.keyword, r.context) for r in X.lexicon_refs(docs([text])).collect()]
    assert got == [(2, "rick", "/* rick */")]
    long = docs(["￿ /* rick\n" * 4000, "￿ /* rick\n" * 8000])
    times = []
    for i in (0, 0, 1):
        begin = time.perf_counter()
        X.lexicon_refs(long.filter(F.col("doc_id") == i)).count()
        times.append(time.perf_counter() - begin)
    assert times[2] < 4 * times[1] + 1


def test_unclosed_signature_is_linear(spark, docs):
    """The state of an open signature does not grow with its lines."""
    frame = docs(["def f(a,\n" + "  b, lambda x, y: 0,\n" * n for n in (2000, 4000)])
    times = []
    for i in (0, 0, 1):
        begin = time.perf_counter()
        row = S.functions(frame.filter(F.col("doc_id") == i)).first()
        times.append(time.perf_counter() - begin)
    assert row.params == 8001 and times[2] < 3 * times[1] + 1


@pytest.mark.parametrize("signature,n", [
    ("def f():", 0), ("def f(a):", 1), ("def f(a, b=(1, 2), *c, d: dict[str, int] = {1: 2}, **e):", 5), ("def f(a, /, b, *, c):", 3),
    ("def f(\n  a,\n  b,  # two\n  c=[1,\n     2],\n):", 3), ("def f(a=lambda x, y: x, b=lambda: 0):", 2), ("def f(a=lambda x=(1, 2), *y: (x, y), b=1) -> dict[int, int]:", 2),
    ("def f(a=lambda\n  x, y: x,\n  b=2):", 2), ("async def f(a, b):", 2), ("def f(a, b", 1)])
def test_parameters(spark, docs, signature, n):
    row = S.functions(docs([signature + "\n    pass\n"])).first()
    assert row.params == n


# Smells

def smells(docs, text, lang):
    return sorted((r.type, r.line) for r in SM.smell_scan(docs([(lang, text)]), F.col("lang")).collect())


def test_python_smells(docs):
    text = """LIMIT = 500
TABLE = {
    1: 33,
}
a = 1
b = 2
c = 3.5
d = '99 and 98'
e = f(0x10, 1e6, .5, v2, 1_000)
g = 10
h = 100
def work(x=7):
    y = 8
    if x and y or (x and
                   y) or not x and y:
        pass
    while x and y: pass
    try:
        z()
    except ValueError:
        # nothing
        pass
    except KeyError: pass
    except OSError:
        pass
        log()
    try:
        z()
    except (A, B) as e:
        ...
"""
    assert smells(docs, text, "Python") == sorted([
        ("magic_number", 7), *[("magic_number", 9)] * 4, ("magic_number", 12), ("magic_number", 13), ("complex_conditional", 14),
        ("global_variable", 10), ("global_variable", 11), ("empty_catch", 20), ("empty_catch", 23), ("empty_catch", 29)])


def test_brace_smells(docs):
    text = """const LIMIT = 500;
var a = 3; let b; let c;
let d; let e; let f = g(0.25);
function h(x) {
  let inner = 1;
  if (x && (a || b) && c
      || d) { y(); }
  for (;;) { if (a && b) k(); }
  try { z(); } catch (err) {
    // nothing
  }
  try { z(); } catch { log(); }
  try { z(); } catch (e) {}
  s = "12 && 13"; /* 14 */
}
"""
    assert smells(docs, text, "JavaScript") == sorted([
        ("magic_number", 2), ("magic_number", 3), ("global_variable", 3), ("complex_conditional", 6), ("empty_catch", 9), ("empty_catch", 13)])
    assert smells(docs, text, "HTML") == []


def random_python(rnd):
    lines, depth = [], 0
    for _ in range(rnd.randint(1, 25)):
        depth = max(0, min(3, depth + rnd.choice([-1, 0, 0, 1])))
        lines.append("    " * depth + rnd.choice([
            "x = 5", "Y = 6", "if a and b and c and d and e:", "elif a or b:", "except E:", "except E: pass", "pass", "...", "", "# 7 and except:", "f(8)", "try:"]))
    return "\n".join(lines)


def python_by_hand(text):
    out, n_globals, handler = [], 0, None
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.split("#")[0].strip()
        if not line:
            continue
        indent = len(raw) - len(raw.lstrip())
        if handler and indent <= handler[1]:
            if handler[2]:
                out.append(("empty_catch", handler[0]))
            handler = None
        if line.startswith("except"):
            handler = (n, indent, line.split(":")[1].strip() in ("", "pass"))
        elif handler and line not in ("pass", "..."):
            handler = (*handler[:2], False)
        if line in ("x = 5", "f(8)"):
            out.append(("magic_number", n))
        if line == "x = 5" and indent == 0:
            n_globals += 1
            if n_globals > V.MAX_GLOBALS:
                out.append(("global_variable", n))
        if line.startswith("if"):
            out.append(("complex_conditional", n))
    if handler and handler[2]:
        out.append(("empty_catch", handler[0]))
    return sorted(out)


def test_python_smells_against_brute_force(docs):
    texts = [random_python(random.Random(i)) for i in range(300)]
    got = {}
    for r in SM.smell_scan(docs([("Python", t) for t in texts]), F.col("lang")).collect():
        got.setdefault(r.doc_id, []).append((r.type, r.line))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == python_by_hand(t), t


def test_report_lines_stand_in_for_no_others(spark):
    rows = spark.createDataFrame([(1, "report", "a"), (2, "style", "b")], "position int, topic string, text string")
    from corpusqa.operators import report

    assert [r.text for r in report.report_advice(rows).collect()] == ["b"]
    assert [r.text for r in report.report_advice(rows.filter("position = 1")).collect()] == ["a"]
