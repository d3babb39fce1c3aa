"""Pattern rules over whole texts: one narrow pass for any number of rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusqa import values as V
from corpusqa.functions.linecodes import _any
from corpusqa.functions.locate import SENTINEL, hit_lines, mark, matches, unmarked
from corpusqa.functions.patterns import java
from corpusqa.functions.text import let


def applies(rule: V.Rule, lang: Column | None) -> Column:
    """Language gate: a rule for ``all``, or one that names the language."""
    if lang is None or "all" in rule.languages:
        return F.lit(True)
    return F.lower(lang).isin(*[x.lower() for x in rule.languages])


def _worth_trying(rule: V.Rule, text: Column, lang: Column | None) -> Column:
    gate = applies(rule, lang)
    if rule.needles:
        gate = gate & _any([text.contains(n) for n in rule.needles])
    return gate


def compiled(rule: V.Rule) -> str:
    return java(rule.fast or rule.pattern, ignore_case=rule.ignore_case)


def _leads(rule: V.Rule) -> bool:
    return "(?<lead>" in (rule.fast or "")


def rule_issues(text: Column, rules: Sequence[V.Rule], lang: Column | None = None,
                with_context: bool = True) -> Column:
    """array<issue>: one entry per match, all rules in one expression.

    The gate and the needles come first, so a regex only runs where it can hit,
    and only a text it did hit is split into lines.
    """
    def tagged(rule: V.Rule, clean: Column) -> Column:
        return F.struct(
            F.lit(rule.category).alias("category"), F.lit(rule.name).alias("type"),
            F.lit(rule.description).alias("description"), F.lit(rule.severity).alias("severity"),
            F.when(_worth_trying(rule, clean, lang), mark(clean, compiled(rule), _leads(rule))).alias("marked"))

    def issues_of(t: Column) -> Column:
        return F.flatten(F.transform(hit_lines(t["marked"]), lambda h: F.array_repeat(
            F.struct(*[t[c].alias(c) for c in ("category", "type", "description", "severity")],
                     h["line"].alias("line"),
                     (h["context"] if with_context else F.lit(None).cast("string")).alias("context")),
            h["n"])))

    marked = let(unmarked(text), lambda clean: F.array(*[tagged(r, clean) for r in rules]))
    hit = F.filter(marked, lambda t: t["marked"].contains(SENTINEL))
    return F.flatten(F.transform(hit, issues_of))


def rule_scan(docs: DataFrame, rules: Sequence[V.Rule], id_cols: Sequence[str] = ("doc_id",),
              text_col: str = "text", lang: Column | None = None) -> DataFrame:
    """Issue rows: ids, category, type, description, severity, line, context."""
    return docs.select(*id_cols, F.inline(rule_issues(F.col(text_col), rules, lang)))


def match_scan(docs: DataFrame, rules: Sequence[V.Rule], id_cols: Sequence[str] = ("doc_id",),
               text_col: str = "text", limit: int = V.MATCH_CHARS) -> DataFrame:
    """Rows for rules that report the matched text: ids, type, description, line, match."""
    text = F.col(text_col)

    def found(rule: V.Rule) -> Column:
        hits = F.transform(
            matches(text, compiled(rule)),
            lambda m: F.struct(
                F.lit(rule.name).alias("type"), F.lit(rule.description).alias("description"),
                m["line"].alias("line"), F.substring(m["text"], 1, limit).alias("match"),
            ),
        )
        empty = "array<struct<type:string,description:string,line:int,match:string>>"
        return F.when(_worth_trying(rule, text, None), hits).otherwise(F.array().cast(empty))

    return docs.select(*id_cols, F.inline(F.concat(*[found(r) for r in rules])))


def match_counts(text: Column, rules: Sequence[V.Rule]) -> Column:
    """How many matches of all rules together."""
    total = F.lit(0)
    for rule in rules:
        n = F.regexp_count(text, F.lit(compiled(rule)))
        total = total + F.when(_worth_trying(rule, text, None), n).otherwise(0)
    return total


def rule_counts(issues: DataFrame, keys: Sequence[str] = ("category", "type")) -> DataFrame:
    """Issue counts per category and type."""
    return issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def top_types(issues: DataFrame, category: str = V.CODE_SMELLS, k: int = 3) -> DataFrame:
    """The most frequent issue types of a category."""
    return (rule_counts(issues.filter(F.col("category") == category), ["type"])
            .orderBy(F.desc("n"), "type").limit(k))


def ranked(issues: DataFrame) -> DataFrame:
    """Add the display score of the severity; order with it, then by line."""
    rank = F.create_map(*[x for kv in V.SEVERITY_RANK.items() for x in map(F.lit, kv)])
    severity = F.lower(F.coalesce(F.col("severity"), F.lit("unknown")))
    return issues.withColumn("severity_score", F.coalesce(rank[severity], F.lit(1)))


__all__ = ["applies", "match_counts", "match_scan", "ranked", "rule_counts",
           "rule_issues", "rule_scan", "top_types"]
