"""Lexicon, markers, names, personas, scores, metrics and reports."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusqa import values as V
from corpusqa.functions.patterns import java
from corpusqa.operators import (lexicon as X, lines as L, metrics as M, rank, report, rules as R)

PY = ("# TODO: later we get schwifty\nimport sys\n\ndef open_jar():\n    # one comment\n"
      "    say('one pickle rick jar')\n    n = n # a jerry line\n    if True:\n        say('yes')\n"
      "    # FIXME: check this\n    return None\n")
JS = ("// first line\nfunction sum2(p, q) {\n  // plain, Morty!\n  say('x'); // NOTE: look\n"
      "  if (p) { /* block */ }\n  // oh f***\n}\nlet y = 9; // XXX: why nine\n")


def test_references(docs):
    got = {(r.doc_id, r.line, r.keyword) for r in X.lexicon_refs(docs([PY, JS])).collect()}
    assert got == {(0, 1, "schwifty"), (0, 1, "get schwifty"), (0, 6, "pickle rick"), (0, 6, "rick"),
                   (0, 7, "jerry"), (1, 3, "morty")}
    first = {r.doc_id: (r.n, r.first_line, r.first_keyword) for r in X.first_hit(docs([PY, JS])).collect()}
    assert first == {0: (5, 1, "get schwifty"), 1: (1, 3, "morty")}
    long = docs(["# " + "unity " * 40, "# brick and communities", '"""rick\n"""x', "'rick"])
    rows = {r.doc_id: r for r in X.lexicon_refs(long).collect()}
    assert set(rows) == {0, 2} and rows[0].context.endswith("...") and len(rows[0].context) <= 103
    whole = {r.line for r in X.lexicon_refs(docs(["x\n# a\ny rick"]), scope="to_end").collect()}
    assert whole == {2}


def test_markers(docs):
    texts = [PY, JS, "# todo x\n# TODO\n# xTODO: no\n/* HACK: a\nHACK b */ '# NOTE: s'\nTODO: code\n# TODO"]
    got = {(r.doc_id, r.marker): r.n for r in X.task_markers(docs(texts)).collect()}
    assert got == {(0, "TODO"): 1, (0, "FIXME"): 1, (1, "NOTE"): 1, (1, "XXX"): 1,
                   (2, "TODO"): 2, (2, "HACK"): 1, (2, "NOTE"): 1}
    totals = {r.marker: r.n for r in X.marker_totals(X.task_markers(docs(texts))).collect()}
    assert totals == {"TODO": 3, "FIXME": 1, "NOTE": 2, "XXX": 1, "HACK": 1}


def test_words(docs):
    texts = ["Fools Say: hell, damn! x", "", "efghi é_a", "dog cat bat ant ANT_2", "xdamn damnx"]
    got = {r.doc_id: r.n for r in X.wildcard_counts(docs(texts)).collect()}
    def count(t):
        return sum(len(re.findall(r"\b" + re.escape(w).replace(r"\*", r"\w*") + r"\b", t, re.I))
                   for w in V.WILDCARD_WORDS)
    assert got == {i: count(t) for i, t in enumerate(texts) if count(t)}
    n = docs(["super-x a\nyx"]).select(X.wildcard_count(F.col("text"), ["*x", "a"])).first()[0]
    assert n == 3
    n = docs(["fork folk fk fort xfork"]).select(X.wildcard_count(F.col("text"), ["f**k"])).first()[0]
    assert n == 3


def test_words_together_count_as_one_by_one(docs):
    words = ("f***", "s***", "d**n", "Hell", "damn", "k*", "i_*", "a**", "*x", "f-k", "2*", "hell")
    letters = "fFsSaAdDmMnNkKiIhHeElLxX_2-. \nſKıİé\U0001d400"
    rnd = random.Random(3)
    texts = ["".join(rnd.choices(letters, k=400)) for _ in range(40)] + ["", None, "Hell fk f-k x 2x damn"]
    alone = sum((F.regexp_count("text", F.lit(X._wildcard_pattern(w))) for w in words), F.lit(0))
    rows = docs(texts).select("text", X.wildcard_count(F.col("text"), words).alias("n"), alone.alias("want")).collect()
    assert [r.n for r in rows] == [r.want for r in rows] and sum(r.n or 0 for r in rows) > 500
    assert len(X._wildcard_patterns(V.WILDCARD_WORDS)) == 2


def test_names_count_as_their_patterns(docs):
    rnd = random.Random(4)
    kinds = ("abAB1_ ", "ab ", "abA ", "AB_1 ", "ab_ ", "aB1_é\U0001d400 .")
    texts = ["".join(rnd.choices(letters, k=300)) for letters in kinds for _ in range(8)]
    plain = [F.regexp_count("text", F.lit(java(p))).alias(f"want_{name}") for name, p in X.NAMING_PATTERNS.items()]
    rows = docs([*texts, "", None]).select(*X.naming_columns(F.col("text")), *plain).collect()
    for name in X.NAMING_PATTERNS:
        assert [r[name] for r in rows] == [r[f"want_{name}"] for r in rows] and sum(r[name] or 0 for r in rows) > 20


def test_style_facts_of_odd_texts(docs):
    rows = M.style_facts(docs([("Python", None), ("Python", ""), ("Python", "x = 1\r\n# TODO: a\x0bB_b ")]), F.col("lang")).collect()
    got = {r.doc_id: (r.loc, r.snake, r.pascal, r.todo, r.persona) for r in rows}
    assert got[0][:3] == (0, 0, 0) and got[1] == (0, 0, 0, 0, None) and got[2][:4] == (3, 0, 0, 1)


NAMES = "a_b camelCase PascalCase MAX_SIZE Name x1_y2 aB A1_B2 a__b _a a_b_C éa_b A Ab"


def test_names_and_tokens(docs):
    r = X.naming_styles(docs([NAMES])).first()
    patterns = (r"\b[a-z0-9]+(?:_[a-z0-9]+)+\b", r"\b[a-z]+(?:[A-Z][a-z0-9]*)+\b",
                r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)*\b", r"\b[A-Z0-9]+(?:_[A-Z0-9]+)+\b")
    assert [r.snake, r.camel, r.pascal, r.screaming] == [len(re.findall(p, NAMES)) for p in patterns]
    texts = ["b a b 1x _c a_b é1 éb b", "", "z " * 3 + " ".join(f"t{i:02d}" for i in range(60))]
    frame = docs(texts)
    got = {(r.doc_id, r.token): r.n for r in X.token_topk(frame).collect()}
    want = {}
    for i, t in enumerate(texts):
        counts = Counter(re.findall(r"\b[a-zA-Z_]\w*\b", t))
        for token, n in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:50]:
            want[i, token] = n
    assert got == want and len(want) > 50
    exact = {r.token: r.n for r in X.token_totals(frame).collect()}
    assert exact["b"] == 3 and exact["t59"] == 1
    assert "t59" not in {r.token for r in X.token_totals(frame, k=50).collect()}


def persona_of(docs, text, lang="Python"):
    return M.style_facts(docs([(lang, text)]), F.col("lang")).first().persona


def test_personas(docs):
    simple = "# c\nif True\nwhile True\nreturn None\n"
    assert persona_of(docs, simple) == V.PERSONA_SIMPLE
    assert persona_of(docs, "x // HACK: y\n" + "z\n" * 30) == V.PERSONA_CYNICAL
    assert persona_of(docs, "# FIXME: a\n# FIXME: b\nx\ny\n") == V.PERSONA_ANXIOUS
    assert persona_of(docs, "# c\n" + "a_b c_d e_f\n" * 5) == V.PERSONA_METHODICAL
    assert persona_of(docs, "# c\n" + "a_b cD e_f gH\n" * 5) == V.PERSONA_NEUTRAL
    assert persona_of(docs, "x\n" * 20) == V.PERSONA_OVERCONFIDENT
    assert persona_of(docs, "# c\nx\n") == V.PERSONA_NEUTRAL
    assert persona_of(docs, "// c\nx\n", "Java") == V.PERSONA_NEUTRAL
    assert M.style_facts(docs([""]), F.col("lang")).first().persona is None
    groups = M.persona_groups(M.style_facts(docs(["x", "x", ""]), F.col("lang"))).collect()
    assert [(g.persona, g.n_files) for g in groups] == [(V.PERSONA_OVERCONFIDENT, 2)]


def test_score(docs):
    def score(*texts):
        return M.corpus_score(M.style_facts(docs(list(texts)), F.col("lang"))).first().score

    # 50, + 1 for the persona
    assert score("x\n") == 51
    # reference 2, TODO 0.5 and truncation, neutral persona
    assert score("# TODO: rick\nx\n") == 52
    assert score("damn damn damn\n" * 40) == 100
    assert score("if True\n" * 40) == 0
    # FIXME -1, HACK +1, NOTE 0.5, and FIXME is a word that starts with f
    assert score("# FIXME: x\n# HACK: x\n# NOTE: x\ny\n") == 51


@pytest.mark.parametrize("g, loc, cm, index, rating", [
    (0.0, 0, 0.0, 100.0, "Excellent"), (1000.0, 10, 0.0, 0.0, "Very Poor"),
    (418.26, 0, 0.0, 80.0, "Excellent"), (505.2174, 0, 0.0, 60.0, "Fair"),
    (505.217, 0, 0.0, 60.0, "Good"), (592.1, 0, 0.0, 40.017, "Fair"), (679.1, 0, 0.0, 20.007, "Poor"),
    (100.0, 5000, 0.2, 82.2, "Excellent"),
])
def test_index_and_rating(spark, g, loc, cm, index, rating):
    i = M.maintainability_index(F.lit(0.0), F.lit(g), F.lit(loc), F.lit(cm))
    got = spark.range(1).select(i.alias("i"), M.rating(i).alias("r")).first()
    assert got.i == pytest.approx(index, abs=1e-2) and got.r == rating


def test_debt(spark):
    issues = spark.createDataFrame([
        (V.CODE_SMELLS, "high"), (V.SECURITY, "critical"), (V.SECURITY, "low"), (V.PERFORMANCE, "medium"),
        (V.STYLE, "high"), (V.CODE_SMELLS, "odd")], "category string, severity string")
    blocks = spark.range(2)
    r = M.technical_debt(issues, blocks).first()
    assert (r.debt_hours, r.debt_days) == (4 + 12 + 1.5 + 2 + 2 + 6, 3.4)
    empty = M.technical_debt(issues.limit(0)).first()
    assert (empty.debt_hours, empty.debt_days) == (0.0, 0.0)


def test_metrics_add_up(docs):
    lang = F.col("lang")
    frame = docs([("Python", PY), ("JavaScript", JS), ("JavaScript", "/* x\n" + "y" * 200)])
    facts = M.quality_facts(frame, lang, ["lang"])
    whole = M.corpus_metrics(facts).first()
    per = M.corpus_metrics(facts, ["lang"]).collect()
    assert whole.total_lines_of_code == sum(r.total_lines_of_code for r in per)
    assert whole.files == 3 and whole.function_count == 1
    per_file = L.file_metrics(frame, lang=lang).collect()
    assert whole.total_comment_lines == sum(r.comment_lines for r in per_file)
    assert whole.avg_line_length == pytest.approx(
        sum(r.avg_line_length * r.loc for r in per_file) / whole.total_lines_of_code)
    issues = M.corpus_issues(frame, lang)
    counts = M.issues_per_file(frame, lang)
    assert counts.agg(F.sum("issues")).first()[0] == issues.count()
    assert counts.count() == 3
    totals = M.corpus_totals(L.file_stats(frame, ["lang"]), ["lang"]).collect()
    assert [t.files for t in totals if t.lang is None] == [3]


def test_reports(docs):
    lang = F.col("lang")
    frame = docs([("Python", "x" * 150 + "\n"), ("Java", "y\n")] * 6)
    metrics = M.corpus_metrics(M.quality_facts(frame, lang))
    texts = [r.text for r in report.recommendations(metrics).orderBy("position").collect()]
    assert texts == ["Improve code documentation - current comment density is too low",
                     "Increase code documentation (comment density is low)."]
    summary = {r.metric: r.value for r in report.summary_long(metrics).collect()}
    assert summary["Total lines of code"] == "24" and summary["Style issues"] == "6"
    assert summary["Comment density"] == "0.0%" and summary["Maintainability rating"] == "Excellent"
    practices = report.advice(frame, lang, first=3).collect()
    assert Counter(r.language for r in practices) == {"python": 3, "java": 3}
    kinds = frame.sparkSession.createDataFrame(
        [("deep_nesting", 4), ("other", 2)], "type string, n bigint")
    assert [r.text for r in report.smell_recommendations(kinds).collect()] == [
        "Fix 4 instances of deep nesting by extracting methods or using early returns",
        "Address 2 instances of 'other'"]


def test_ranks(docs):
    frame = docs(["a\n" * n for n in (3, 9, 9, 1)])
    assert [r.doc_id for r in rank.top(L.file_stats(frame), "lines", 3, ["doc_id"]).collect()] == [1, 2, 0]
    sample = rank.head_sample(frame, k=1, lines=2).first()
    assert (sample.doc_id, sample.lines, sample.sample) == (1, 9, "a\na")
    guard = L.size_guard(frame, max_lines=3).first()
    assert tuple(guard) == (4, 2, 2)
    assert L.file_stats(frame, max_lines=3).count() == 2
    rows = R.ranked(R.rule_scan(docs(["eval(x)\npassword = 'a'"]), V.ISSUE_RULES)).orderBy(
        F.desc("severity_score"), "line").collect()
    assert [r.severity_score for r in rows] == sorted((r.severity_score for r in rows), reverse=True)


def test_language_gate(docs):
    text = "innerHTML = x\npassword = 'a'\nvar y"
    frame = docs([("TypeScript", text), ("HTML", text), ("Ruby", text)])
    got = {(r.doc_id, r.type) for r in R.rule_scan(frame, V.ISSUE_RULES, lang=F.col("lang")).collect()}
    assert got == {(0, "hardcoded_credentials"), (0, "var_usage"), (1, "xss"),
                   (1, "hardcoded_credentials"), (2, "hardcoded_credentials")}


def test_block_comments_without_end(docs):
    """Only a comment that ends is one; what comes behind an open one is still read; the text stays as it is."""
    texts = [
        "/* todo: a */ x /* todo: b\n# todo: c /* d\n",
        "a /* todo: b", "/*/ todo: x", "*/* todo: y", "/* todo: a */* todo: b", "/* todo: \uffff */ /* todo: z",
    ]
    got = {r["doc_id"]: r["n"] for r in X.task_markers(docs(texts), markers=["todo"]).collect()}
    assert got == {0: 2, 4: 1, 5: 1}
    rows = X.lexicon_refs(docs(texts), words=["todo"]).orderBy("doc_id", "line").collect()
    assert [(r["doc_id"], r["line"], r["context"]) for r in rows] == [
        (0, 1, "/* todo: a */"), (0, 2, "# todo: c /* d"), (4, 1, "/* todo: a */"), (5, 1, "/* todo: \uffff */")]


def test_open_block_comments_in_linear_time(docs):
    """20,000 lines, each with an opening that no end follows."""
    begin = time.perf_counter()
    text = "see src/* for more\n# todo: it\n" * 20_000
    assert X.task_markers(docs([text]), markers=["todo"]).collect()[0]["n"] == 20_000
    assert time.perf_counter() - begin < 20
