"""The four passes over a corpus, each a set of lazily built tables.

A corpus is a DataFrame with an id, a language name and a text.  A table runs when it is written or
shown; only the advanced pass starts jobs by itself, for the windows that all its duplicate tables share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusqa import values as V
from corpusqa.operators import (advisories as A, deps as D, dups, lexicon as X, lines as L,
                                metrics as M, paths as P, rank, report, rules as R, structure as S)
from corpusqa.sources import files as SF


def read_corpus(spark: SparkSession, root: str, level: str = "fine",
                errors: str = "replace") -> DataFrame:
    """Source files under ``root``: doc_id (relative path), path, lang, encoding, text."""
    languages = V.FINE_LANGUAGES if level == "fine" else V.COARSE_LANGUAGES
    files = SF.scan_files(spark, root, languages)
    return files.select(
        F.col("rel_path").alias("doc_id"), "path",
        P.language_of(F.col("path"), languages).alias("lang"),
        SF.encoding_label(F.col("content")).alias("encoding"),
        SF.decode(F.col("content"), errors).alias("text"))


def basic_pass(corpus: DataFrame, id_col: str = "doc_id") -> dict[str, DataFrame]:
    """Line statistics: per file, in all, by language, by size."""
    keep = [c for c in corpus.columns if c != "text"]
    stats = L.file_stats(corpus, keep)
    return {
        "file_stats": stats,
        "totals": M.corpus_totals(stats),
        "guard": L.size_guard(corpus),
        "languages": M.language_share(stats),
        "largest": rank.top(stats, "lines", 10, [id_col]),
        "samples": rank.head_sample(corpus, id_col),
        **({"encodings": SF.with_share(corpus.groupBy("encoding").agg(
            F.count(F.lit(1)).alias("n")), "n")} if "encoding" in corpus.columns else {}),
    }


def advanced_pass(corpus: DataFrame, id_col: str = "doc_id") -> dict[str, DataFrame]:
    """Issues, functions, dependencies, tokens, duplicates, metrics and advice."""
    known = corpus.filter(F.col("lang") != "Unknown")
    lang, text = F.col("lang"), F.col("text")
    found = dups.find(known, id_col, lang=lang)
    issues = M.corpus_issues(known, lang, id_col, found=found)
    facts = M.quality_facts(known, lang, [id_col])
    metrics = M.corpus_metrics(facts, duplicates=M.duplicate_totals(known, id_col, lang=lang, found=found))
    return {
        "issues": issues,
        "functions": S.functions(known.filter(lang == "Python"), [id_col]),
        "dependencies": D.edges_of(known, D.dependencies(text, lang), [id_col]),
        "tokens": X.token_totals(known),
        "file_metrics": L.file_metrics(known, [id_col], lang=lang),
        "duplicate_blocks": dups.duplicate_blocks(known, id_col, lang=lang, found=found),
        "duplicate_locations": dups.duplicate_locations(known, id_col, lang=lang, found=found),
        "metrics": metrics,
        "summary": report.summary_long(metrics),
        "recommendations": report.recommendations(metrics),
        "smell_recommendations": report.smell_recommendations(R.top_types(issues)),
        "type_recommendations": report.type_recommendations(R.rule_counts(issues)),
        "best_practices": report.advice(known, lang),
        "issues_per_file": M.issues_per_file(known, lang, id_col, ["lang"], found=found),
        "file_details": report.file_details(L.file_stats(known, [id_col, "lang"]), issues, id_col),
    }


def lexicon_pass(corpus: DataFrame, id_col: str = "doc_id") -> dict[str, DataFrame]:
    """Keyword references, simple code, word and marker counts, personas, score."""
    facts = M.style_facts(corpus, F.col("lang"), [id_col, "lang"])
    markers = X.task_markers(corpus, id_cols=[id_col])
    return {
        "references": X.lexicon_refs(corpus, id_cols=[id_col]),
        "simple_code": R.match_scan(corpus, V.SIMPLE_CODE_RULES, [id_col]),
        "words": X.wildcard_counts(corpus, id_cols=[id_col]),
        "markers": markers,
        "marker_totals": X.marker_totals(markers),
        "personas": facts.select(id_col, "persona"),
        "persona_groups": M.persona_groups(facts, id_col),
        "score": M.corpus_score(facts),
    }


def dependency_pass(corpus: DataFrame, requirements: DataFrame, advisories: DataFrame,
                    id_col: str = "doc_id") -> dict[str, DataFrame]:
    """Import graph of the Python files, and requirement lines against advisories.

    ``requirements`` is (project, line); only pinned versions can be matched.
    """
    python = corpus.filter(F.col("lang") == "Python")
    imports = D.edges_of(python, D.python_imports(F.col("text"), keep_dots=True), [id_col])
    pinned = A.parse_requirements(requirements).filter(F.col("operator").isin("==", "==="))
    findings = A.advisory_match(pinned, advisories)
    projects = requirements.select("project").distinct()
    return {
        "nodes": D.link_nodes(python, id_col),
        "edges": D.link_graph(python, imports, id_col),
        "findings": findings,
        "status": A.scan_status(projects, projects, findings),
    }
