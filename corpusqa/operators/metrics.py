"""Per-document facts, and the corpus metrics that add them up.

Each ``*_facts`` builder is one narrow pass that leaves a short row of numbers
per document.  Corpus metrics are plain sums of those, per group key if wanted,
divided at the very end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusqa import values as V
from corpusqa.functions import linecodes as LC, text as TX
from corpusqa.operators import dups, lexicon as X, lines as L, rules as R, structure as S
from corpusqa.schemas import ISSUE

_NO_ISSUES = f"array<{ISSUE.simpleString()}>"
_FUNCTIONS = "array<struct<name:string,line:int,end_line:int,lines:int,params:int,complexity:int>>"


# -------------------------------------------------------------------- issues

def python_structure(text: Column, lang: Column) -> Column:
    """Structure of Python texts, null for any other."""
    return F.when(lang == "Python", S.structure(text))


def _none() -> Column:
    return F.array().cast(_NO_ISSUES)


def brace_issues(text: Column, lang: Column) -> Column:
    """Nested loops, and for JavaScript long functions, of languages with braces."""
    braced = [name for name in V.FINE_LANGUAGES if name in V.LINE_MARKERS
              and name not in ("Python", "Ruby")] + ["TypeScript", "C/C++"]

    def read(st: Column) -> Column:
        return F.concat(
            S.nested_loop_issues(st["loops"]),
            F.when(lang.isin("JavaScript", "TypeScript"), S.brace_function_issues(st))
            .otherwise(_none()))

    return F.when(lang.isin(*braced), TX.let(S.brace_structure(text, lang), read)).otherwise(_none())


def issue_array(text: Column, lang: Column, rules: Sequence[V.Rule] = V.ISSUE_RULES,
                style: LC.CommentStyle = LC.ADVANCED_STYLE, long_limit: int = V.LONG_LINE_CHARS,
                structure: Column | None = None) -> Column:
    """array<issue>: everything one document shows by itself."""
    def of_structure(st: Column) -> Column:
        return F.when(st.isNotNull(), S.structure_issues(st)).otherwise(_none())

    return F.concat(
        R.rule_issues(text, rules, lang), L.long_line_issues(text, long_limit),
        L.commented_code_issues(text, lang, style),
        TX.let(python_structure(text, lang), of_structure) if structure is None
        else of_structure(structure),
        brace_issues(text, lang))


def document_issues(docs: DataFrame, lang: Column, id_cols: Sequence[str] = ("doc_id",),
                    text_col: str = "text", **options) -> DataFrame:
    return docs.select(*id_cols, F.inline(issue_array(F.col(text_col), lang, **options)))


def corpus_issues(docs: DataFrame, lang: Column, id_col: str = "doc_id", text_col: str = "text",
                  dup_style: LC.CommentStyle = LC.DUPLICATE_STYLE,
                  found: dups.Duplicates | None = None, **options) -> DataFrame:
    """All issues of a corpus: each document's own and the duplicate blocks."""
    own = document_issues(docs, lang, [id_col], text_col, **options)
    return own.unionByName(dups.duplicate_smells(docs, id_col, text_col, lang, dup_style, found=found))


def count_category(issues: Column, category: str) -> Column:
    return F.size(F.filter(issues, lambda i: i["category"] == category))


def severity_hours(severity: Column) -> Column:
    hours = F.create_map(*[x for kv in V.SEVERITY_HOURS.items() for x in map(F.lit, kv)])
    return F.coalesce(hours[severity], F.lit(V.DEFAULT_HOURS))


def issue_hours(category: Column, severity: Column) -> Column:
    """Hours to fix one issue: security costs half as much again, style nothing."""
    factor = (F.when(category == V.SECURITY, V.SECURITY_FACTOR)
              .when(category == V.STYLE, 0.0).otherwise(1.0))
    return severity_hours(severity) * factor


def issues_per_file(docs: DataFrame, lang: Column, id_col: str = "doc_id", keep: Sequence[str] = (),
                    text_col: str = "text", dup_style: LC.CommentStyle = LC.DUPLICATE_STYLE,
                    found: dups.Duplicates | None = None, **options) -> DataFrame:
    """Every document with its issue count per category and in all.

    Its own issues are counted in its row; only what duplicate blocks add is grouped and joined.
    """
    def counted(issues: Column) -> Column:
        return F.struct(*[count_category(issues, c).cast("bigint").alias(c) for c in V.CATEGORIES],
                        F.size(issues).cast("bigint").alias("issues"))

    own = docs.select(id_col, *keep, TX.one_row(TX.let(issue_array(F.col(text_col), lang, **options), counted)))
    smells = dups.duplicate_smells(docs, id_col, text_col, lang, dup_style, found=found)
    more = smells.groupBy(id_col).agg(F.count(F.lit(1)).alias("_more"))
    added = F.coalesce("_more", F.lit(0))
    return own.join(more, id_col, "left").select(
        id_col, *keep, *[(F.col(c) + added if c in (V.CODE_SMELLS, "issues") else F.col(c)).alias(c)
                         for c in (*V.CATEGORIES, "issues")])


def technical_debt(issues: DataFrame, duplicate_blocks: DataFrame | None = None) -> DataFrame:
    """One row: hours and working days to fix what was found."""
    hours = issues.select(issue_hours(F.col("category"), F.col("severity")).alias("hours"))
    if duplicate_blocks is not None:
        hours = hours.unionByName(duplicate_blocks.select(
            F.lit(float(V.DUPLICATE_HOURS)).alias("hours")))
    return hours.agg(F.coalesce(F.sum("hours"), F.lit(0.0)).alias("debt_hours")).select(
        "debt_hours", F.bround(F.col("debt_hours") / V.HOURS_PER_DAY, 1).alias("debt_days"))


# ----------------------------------------------------------- quality metrics

def quality_facts(docs: DataFrame, lang: Column, keys: Sequence[str] = (),
                  text_col: str = "text", rules: Sequence[V.Rule] = V.ISSUE_RULES,
                  style: LC.CommentStyle = LC.ADVANCED_STYLE,
                  long_limit: int = V.LONG_LINE_CHARS) -> DataFrame:
    """One row of numbers per document: size, comments, issues, hours, functions."""
    text = F.col(text_col)
    def total(items: Column, field: str) -> Column:
        return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, f: a + f[field])

    def measure(ls: Column, issues: Column, fs: Column) -> Column:
        lengths = F.transform(F.filter(ls, lambda x: ~TX.is_blank(x)), lambda x: F.length(x))
        chars = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)
        hours = F.aggregate(issues, F.lit(0.0), lambda a, i: a + issue_hours(i["category"], i["severity"]))
        return F.struct(
            F.size(ls).alias("loc"),
            TX.let(LC.codes(ls, lang, style), LC.density_comments).alias("comment_lines"),
            F.when(F.size(lengths) > 0, chars / F.size(lengths)).otherwise(0.0).alias("avg_line_length"),
            *[count_category(issues, c).alias(c) for c in V.CATEGORIES],
            hours.alias("hours"), F.size(fs).alias("functions"),
            total(fs, "complexity").alias("complexity"), total(fs, "lines").alias("function_lines"),
            total(fs, "params").alias("params"))

    def functions(st: Column) -> Column:
        return F.coalesce(st["functions"], F.array().cast(_FUNCTIONS))

    facts = TX.let(TX.lines(text), lambda ls: TX.let(
        python_structure(text, lang), lambda st: TX.let(
            issue_array(text, lang, rules, style, long_limit, st),
            lambda issues: measure(ls, issues, functions(st)))))
    return docs.select(*keys, TX.one_row(facts))


def corpus_metrics(facts: DataFrame, keys: Sequence[str] = (),
                   duplicates: DataFrame | None = None) -> DataFrame:
    """Totals, averages, index, rating and debt, one row per key (or one in all).

    ``duplicates`` is keys, blocks, smells and smell hours of the duplicate
    detection, already added up; it is stacked on, not joined.
    """
    sums = ["loc", "comment_lines", *V.CATEGORIES, "hours", "functions", "complexity",
            "function_lines", "params"]
    measured = facts.select(
        *keys, *sums, (F.col("avg_line_length") * F.col("loc")).alias("weighted_length"),
        F.lit(1).alias("files"), F.lit(0).alias("blocks"))
    if duplicates is not None:
        zero = {n: F.lit(0) for n in (*sums, "weighted_length", "files")}
        zero[V.CODE_SMELLS], zero["hours"] = F.col("smells"), F.col("smell_hours")
        measured = measured.unionByName(duplicates.select(
            *keys, *[c.alias(n) for n, c in zero.items()], "blocks"))
    totals = measured.groupBy(*keys).agg(*[
        F.coalesce(F.sum(n), F.lit(0)).alias(n)
        for n in (*sums, "weighted_length", "files", "blocks")])

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    base = totals.select(
        *keys, "files", F.col("loc").alias("total_lines_of_code"),
        F.col("comment_lines").alias("total_comment_lines"),
        ratio("comment_lines", "loc").alias("comment_density"),
        ratio("weighted_length", "loc").alias("avg_line_length"),
        F.col(V.CODE_SMELLS).alias("code_smell_count"),
        F.col(V.SECURITY).alias("security_issue_count"),
        F.col(V.PERFORMANCE).alias("performance_issue_count"),
        F.col(V.STYLE).alias("style_issue_count"),
        F.col("functions").alias("function_count"),
        ratio("complexity", "functions").alias("avg_function_complexity"),
        ratio("function_lines", "functions").alias("avg_function_size"),
        ratio("params", "functions").alias("avg_function_params"),
        F.col("blocks").alias("duplicated_code_blocks"),
        (F.col("hours") + F.col("blocks") * V.DUPLICATE_HOURS).alias("technical_debt_hours"))
    index = maintainability_index(
        F.col("avg_function_complexity"), F.col("avg_line_length"),
        F.col("total_lines_of_code"), F.col("comment_density"))
    return base.withColumn("maintainability_index", index).withColumn(
        "maintainability_rating", rating(F.col("maintainability_index"))).withColumn(
        "technical_debt_days", F.bround(F.col("technical_debt_hours") / V.HOURS_PER_DAY, 1))


def maintainability_index(complexity: Column, line_length: Column, loc: Column,
                          density: Column) -> Column:
    raw = (F.lit(171.0) - (complexity - 1) * 5.2 - line_length * 0.23
           - loc / 1000 * 16.2 + density * 50)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw))


def rating(index: Column) -> Column:
    (first, name), *rest = V.RATING_BANDS
    out = F.when(index >= first, name)
    for bound, label in rest:
        out = out.when(index >= bound, label)
    return out.otherwise(V.LOWEST_RATING)


def duplicate_totals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lang: Column | None = None,
                     style: LC.CommentStyle = LC.DUPLICATE_STYLE,
                     found: dups.Duplicates | None = None) -> DataFrame:
    """One row: duplicate blocks, the smells they make, and the hours of those.

    A block makes one smell in each document that has it, so the first windows
    per document are all that is counted next to the locations.
    """
    rows = found.windows if found else dups.windows(docs, id_col, text_col, lang, style, mark_first=True)
    per_key = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("first").alias("documents"))
    return per_key.filter(F.col("n") > 1).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.coalesce(F.sum("documents"), F.lit(0)).alias("smells")).select(
        "blocks", "smells", (F.col("smells") * float(V.SEVERITY_HOURS["high"])).alias("smell_hours"))


# ------------------------------------------------------------- style metrics

def style_facts(docs: DataFrame, lang: Column, keys: Sequence[str] = ("doc_id",),
                text_col: str = "text", words: Sequence[str] = V.KEYWORDS,
                wildcards: Sequence[str] = V.WILDCARD_WORDS,
                markers: Sequence[str] = V.TASK_MARKERS,
                simple_rules: Sequence[V.Rule] = V.SIMPLE_CODE_RULES,
                style_markers=None, default_marker: str = V.DEFAULT_STYLE_MARKER) -> DataFrame:
    """Per document: density, line length, naming, markers, hits and the persona.

    ``markers`` stand for TODO, FIXME, HACK, XXX and NOTE, in this order.
    """
    text = F.col(text_col)
    by_marker: dict[str, list[str]] = {}
    for language, m in (V.STYLE_MARKERS if style_markers is None else style_markers).items():
        by_marker.setdefault(m, []).append(language)
    marker = F.lit(default_marker)
    for m, languages in by_marker.items():
        marker = F.when(lang.isin(*languages), m).otherwise(marker)
    names = ("todo", "fixme", "hack", "xxx", "note")

    def measure(ls: Column, counts: Column, joined: Column) -> Column:
        comments = F.size(F.filter(ls, lambda x: F.startswith(TX.strip(x), marker)))
        lengths = F.transform(F.filter(ls, lambda x: ~TX.is_blank(x)), lambda x: F.length(x))
        chars = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.struct(
            F.size(ls).alias("loc"), comments.alias("comment_lines"),
            F.when(F.size(ls) > 0, comments / F.size(ls)).alias("density"),
            F.when(F.size(lengths) > 0, chars / F.size(lengths)).otherwise(0.0).alias("avg_len"),
            *X.naming_columns(joined),
            *[F.element_at(counts, i + 1)["n"].alias(n) for i, n in enumerate(names)],
            R.match_counts(text, simple_rules).alias("simple_hits"),
            X.wildcard_count(text, wildcards).alias("words"),
            F.size(X.lexicon_hits(text, words)).alias("references"))

    facts = TX.let(TX.splitlines(text), lambda ls: TX.let(
        X.marker_counts(text, markers), lambda counts: TX.let(
            F.array_join(ls, "\n"), lambda joined: measure(ls, counts, joined))))
    return docs.select(*keys, TX.one_row(facts)).withColumn("persona", F.when(
        F.col("loc") > 0, persona()))


def persona() -> Column:
    """The first test that fits names the persona."""
    density, length = F.col("density"), F.col("avg_len")
    styles = [F.col(c) for c in X.NAMING_PATTERNS]
    total = styles[0] + styles[1] + styles[2] + styles[3]
    largest = F.greatest(*styles)
    return (
        F.when((F.col("simple_hits") > 2) & (density > 0.2), V.PERSONA_SIMPLE)
        .when((F.col("hack") > 0) & (density < 0.05) & (length < 70), V.PERSONA_CYNICAL)
        .when((F.col("fixme") > 1) & (density > 0.15), V.PERSONA_ANXIOUS)
        .when((density > 0.1) & (density < 0.25) & (total > 10),
              F.when(largest > (total - largest) * 1.5, V.PERSONA_METHODICAL)
              .otherwise(V.PERSONA_NEUTRAL))
        .when(density < 0.08, V.PERSONA_OVERCONFIDENT)
        .otherwise(V.PERSONA_NEUTRAL)
    )


def persona_groups(facts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents per persona, and one of them.

    The members are the rows of ``facts`` themselves; they are not collected.
    """
    return facts.filter(F.col("persona").isNotNull()).groupBy("persona").agg(
        F.count(F.lit(1)).alias("n_files"), F.min(id_col).alias("example"))


def corpus_score(facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Score from 0 to 100, one row per key (or one in all)."""
    weights = F.create_map(*[x for kv in V.PERSONA_WEIGHTS.items() for x in map(F.lit, kv)])
    points = (F.when(F.col("references") > 0, 2).otherwise(0)
              - F.col("simple_hits") * 3 + F.col("words")
              + (F.col("todo") + F.col("note")) * 0.5 - F.col("fixme") + F.col("hack")
              + F.coalesce(weights[F.col("persona")], F.lit(0)))
    return facts.groupBy(*keys).agg(F.sum(points).alias("points")).select(
        *keys, F.least(F.lit(100), F.greatest(F.lit(0), (
            F.lit(50) + F.coalesce("points", F.lit(0.0))).cast("int"))).alias("score"))


# ------------------------------------------------------------ corpus totals

def corpus_totals(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals of ``file_stats``, with subtotals for the keys: ``total`` is 0 where a row has all of them, and not
    0 where it adds up over some, which keeps apart a total and a key that is null."""
    grouped = stats.rollup(*keys) if keys else stats.groupBy()
    level = [F.grouping_id().alias("total")] if keys else []
    return grouped.agg(*level, F.count(F.lit(1)).alias("files"), *[
        F.sum(c).alias(c) for c in ("lines", "code", "comments", "blank")])


def language_share(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """Documents per language, and their share in percent."""
    from corpusqa.sources.files import with_share

    return with_share(docs.groupBy(lang).agg(F.count(F.lit(1)).alias("n")), "n")
