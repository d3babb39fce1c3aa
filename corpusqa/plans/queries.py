"""The registered queries: each operator on the given tables.

The texts of ``documents`` hold hardly any code, so the packs, markers and word
lists passed here are ones that occur in them.  Every query reads whole tables
and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusqa import values as V
from corpusqa.functions.linecodes import CommentStyle
from corpusqa.operators import (advisories as A, deps as D, dups, lexicon as X, lines as L,
                                metrics as M, paths as P, rank, report, rules as R,
                                structure as S)
from corpusqa.sources import files as SF
from corpusqa.sources.tables import read_table, spread, written

Query = Callable[[SparkSession, str], DataFrame]

# ------------------------------------------------- parameters of the queries

RULES = (
    V.Rule("token_literal", V.SECURITY, "critical", "Token given as a literal",
           r'token[ \t]*=[ \t]*"[^"\n]+"', needles=("token",)),
    V.Rule("mail_address", V.SECURITY, "high", "Mail address",
           r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+", needles=("@",)),
    V.Rule("licence_line", V.CODE_SMELLS, "low", "Licence line", r"Licen[sc]e", needles=("Licen",)),
    V.Rule("digits", V.PERFORMANCE, "medium", "Four digits or more", r"[0-9]{4,}"),
)
GATED_RULES = (
    V.Rule("english_article", V.CODE_SMELLS, "low", "Article", r"\b[Tt]he\b", ("en",)),
    V.Rule("article", V.CODE_SMELLS, "medium", "Article", r"\b(?:[Ll]e|[Dd]er|[Ll]os)\b",
           ("FR", "de", "es")),
    V.Rule("comma_pair", V.STYLE, "high", "Two commas in a row", r",[^,.\n]*,", ("all",)),
)
SIMPLE_RULES = (
    V.Rule("of_the", "simple_code", "low", "of the", r"\bof\s+the\b", ignore_case=True),
    V.Rule("doubled", "simple_code", "low", "A word twice", r"\bde\s+de\b", ignore_case=True),
)
REPEATED_WORD = (
    V.Rule("repeated_word", "simple_code", "low", "A word and then the same word",
           r"\b(\w++)\s+\1\b", ignore_case=True),
)
BASIC_TEST = CommentStyle({}, ("%", "The", "La", "De"), None, "###", "&&&")
STYLE_TEST = CommentStyle({"en": ("The", "%"), "fr": ("La", "Le")}, ("Der", "Los"),
                          ("en", "de"), "###", "&&&")
ISLAND_TEST = CommentStyle({}, ("A", "E", "T", "I", "O", "D", "L"), ())
WORDS = ("token", "the", "de", "que", "of the")
MARKERS = ("the", "token", "de", "of", "der")
STYLE_MARKERS = {"en": "T", "fr": "E", "de": "D"}
PRACTICES = {
    "en": ("Write short sentences", "Prefer plain words", "Name the actor", "Avoid filler"),
    "fr": ("Accorder les participes", "Soigner la ponctuation"),
    "it": ("Rileggere",),
}
ADVISORIES = (
    ("economy", ">=3.0,<9.20", "Range, open above", "A1"),
    ("economy", "<=2.15|==20.7", "Two alternatives", "A2"),
    ("small", ">12.40,!=14.3", "Range with a gap", "A3"),
    ("medium", "<25", "All but the last", "41002"),
    ("standard", ">=25.1", "Last brand", "A4"),
)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "documents"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "pages"))


def exact(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and doubles to six places, as in the SQL."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        c = F.col(field.name)
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "double":
            c = F.round(c, 6)
        out.append(c.alias(field.name))
    return df.select(*out)


def lang() -> Column:
    return F.col("lang")


def url_path() -> Column:
    """A page's path below its host."""
    return F.regexp_replace(F.col("url"), "^[a-z]+://[^/]*/?|[?#].*$", "")


# ---------------------------------------------------------- sources and paths

def scan_filter(s, d):
    return SF.scan_filter(pages(s, d).select("page_id", url_path().alias("path")), F.col("path"))


def encoding_census(s, d):
    return SF.encoding_census(documents(s, d), F.encode("text", "UTF-8"))


def size_guard(s, d):
    return L.size_guard(documents(s, d), max_lines=20)


def language_of_path(s, d):
    return pages(s, d).select(
        "page_id", P.language_of(url_path()).alias("coarse"),
        P.language_of(url_path(), V.FINE_LANGUAGES).alias("fine"))


def path_parts(s, d):
    p = F.col("path")
    return pages(s, d).select("page_id", url_path().alias("path")).select(
        "page_id", P.dirname(p).alias("dirname"), P.basename(p).alias("basename"),
        P.extension(p).alias("extension"), P.stem(p).alias("stem"),
        P.relative(p, "en").alias("relative"))


# ---------------------------------------------------------------------- lines

def explode_lines(s, d):
    return L.explode_lines(documents(s, d))


def explode_breaks(s, d):
    return L.explode_lines(pages(s, d), ["page_id"], "html", mode="splitlines")


def line_classes(s, d):
    return L.line_classes(documents(s, d), style=BASIC_TEST)


def long_lines(s, d):
    return L.long_lines(documents(s, d))


def file_stats(s, d):
    return L.file_stats(documents(s, d), style=BASIC_TEST)


def file_stats_default(s, d):
    return L.file_stats(documents(s, d))


def corpus_totals(s, d):
    return M.corpus_totals(L.file_stats(documents(s, d), ["lang"], style=BASIC_TEST), ["lang"])


def file_metrics(s, d):
    return L.file_metrics(documents(s, d), lang=lang(), style=STYLE_TEST)


def comment_density(s, d):
    return (L.file_metrics(documents(s, d), ["doc_id", "source"], lang=lang(), style=STYLE_TEST)
            .groupBy("source").agg(F.sum("comment_lines").alias("comment_lines"),
                                   F.sum("loc").alias("loc"),
                                   (F.sum("comment_lines") / F.sum("loc")).alias("density")))


def comment_islands(s, d):
    found = L.comment_islands(F.col("text"), lang(), ISLAND_TEST, lambda x: x.contains(","))
    return documents(s, d).select("doc_id", F.inline(found))


def commented_code(s, d):
    found = L.commented_code_issues(F.col("text"), lang(), ISLAND_TEST)
    return documents(s, d).select("doc_id", F.inline(found))


def largest_files(s, d):
    return rank.top(L.file_stats(documents(s, d)), "lines", 10, ["doc_id"])


def head_sample(s, d):
    return rank.head_sample(documents(s, d), lines=15)


# ---------------------------------------------------------------------- rules

def rule_hits(s, d):
    return R.rule_scan(documents(s, d), RULES)


def rule_hits_embedded(s, d):
    found = R.rule_issues(F.col("html"), V.JAVASCRIPT_RULES, F.lit("JavaScript"), False)
    return pages(s, d).select("page_id", F.inline(found)).drop("context")


def gated_rules(s, d):
    return R.rule_scan(documents(s, d), GATED_RULES, lang=lang()).drop("context")


def rule_counts_by_type(s, d):
    return R.rule_counts(R.rule_scan(documents(s, d), RULES + GATED_RULES, lang=lang()))


def issues_ranked(s, d):
    return R.ranked(R.rule_scan(documents(s, d), RULES)).select(
        "doc_id", "type", "severity", "severity_score", "line")


def top_issue_types(s, d):
    return R.top_types(R.rule_scan(documents(s, d), RULES + GATED_RULES, lang=lang()))


def simple_matches(s, d):
    return R.match_scan(documents(s, d), SIMPLE_RULES)


def repeated_words(s, d):
    return R.match_scan(documents(s, d), REPEATED_WORD)


# -------------------------------------------------------------------- lexicon

def lexicon_refs(s, d):
    return X.lexicon_refs(documents(s, d), WORDS)


def lexicon_rollup(s, d):
    return X.lexicon_rollup(X.lexicon_refs(documents(s, d), WORDS))


def first_hit(s, d):
    return X.first_hit(documents(s, d), WORDS)


def wildcard_counts(s, d):
    return X.wildcard_counts(documents(s, d))


def top_counts(s, d):
    return rank.top(X.wildcard_counts(documents(s, d)), "n", 3, ["doc_id"])


def marker_counts(s, d):
    return X.task_markers(documents(s, d), MARKERS)


def marker_totals(s, d):
    return X.marker_totals(X.task_markers(documents(s, d), MARKERS))


def naming_styles(s, d):
    return X.naming_styles(documents(s, d))


def naming_styles_pages(s, d):
    return X.naming_styles(pages(s, d), ["page_id"], "html")


def token_topk(s, d):
    return X.token_topk(documents(s, d))


def token_heavy(s, d):
    return X.token_totals(documents(s, d), k=V.TOP_TOKENS)


def token_exact(s, d):
    return X.token_totals(documents(s, d))


# ----------------------------------------------------------------- duplicates

def dup_blocks(s, d):
    return dups.duplicate_blocks(documents(s, d), lang=lang())


def dup_locations(s, d):
    return dups.duplicate_locations(documents(s, d), lang=lang())


def dup_locations_skew(s, d):
    """With so few parts that blocks of both kinds, hot and not, are met in small tables."""
    return dups.duplicate_locations(documents(s, d), lang=lang(), parts=300)


def dup_smells(s, d):
    return dups.duplicate_smells(documents(s, d), lang=lang())


def dup_totals(s, d):
    return M.duplicate_totals(documents(s, d), lang=lang())


# ------------------------------------------------------------------ structure

EXTENT_HEADER = "^[A-M]"
EXTENT_INDENT = "AEITOD"


def block_extents(s, d):
    return S.block_extents(documents(s, d), EXTENT_HEADER, indent=EXTENT_INDENT)


# -------------------------------------------------------------------- metrics

def _issues(s, d, found=None):
    return M.corpus_issues(documents(s, d), lang(), rules=RULES, style=ISLAND_TEST, found=found)


def _facts(s, d, keys=()):
    return M.quality_facts(documents(s, d), lang(), keys, rules=RULES, style=ISLAND_TEST)


def corpus_issues(s, d):
    return _issues(s, d).drop("context")


def issues_per_file(s, d):
    return M.issues_per_file(documents(s, d), lang(), keep=["lang"], rules=RULES, style=ISLAND_TEST)


def corpus_metrics(s, d):
    return M.corpus_metrics(_facts(s, d), duplicates=M.duplicate_totals(documents(s, d), lang=lang()))


def maintainability(s, d):
    return M.corpus_metrics(_facts(s, d, ["source"]), ["source"]).select(
        "source", "maintainability_index", "maintainability_rating")


def technical_debt(s, d):
    found = dups.find(documents(s, d), lang=lang())
    return M.technical_debt(_issues(s, d, found), found.keys)


def recommendations(s, d):
    return report.recommendations(corpus_metrics(s, d))


def smell_recommendations(s, d):
    return report.smell_recommendations(R.top_types(_issues(s, d)))


def summary_long(s, d):
    return report.summary_long(corpus_metrics(s, d))


def file_details_json(s, d):
    return report.file_details(L.file_stats(documents(s, d), ["doc_id", "lang"]), _issues(s, d))


def _style(s, d, keys=("doc_id",)):
    return M.style_facts(documents(s, d), lang(), keys, words=WORDS, markers=MARKERS,
                         simple_rules=SIMPLE_RULES, style_markers=STYLE_MARKERS,
                         default_marker="L")


def style_metrics(s, d):
    return _style(s, d).select("doc_id", "loc", "comment_lines", "density", "avg_len")


def file_persona(s, d):
    return _style(s, d)


def persona_groups(s, d):
    return M.persona_groups(_style(s, d))


def corpus_score(s, d):
    return M.corpus_score(_style(s, d, ["doc_id", "source"]), ["source"])


def language_share(s, d):
    return M.language_share(read_table(s, d, "documents"))


def top_languages(s, d):
    return rank.top(M.language_share(read_table(s, d, "documents")), "n", 3, ["lang"])


def advice_join(s, d):
    return report.advice(read_table(s, d, "documents"), lang(), PRACTICES, first=3)


# ----------------------------------------------------- dependencies and links

LINK = 'href="/([a-z]+)"'


def _site(s, d):
    """Pages as files: ``<section>/<id>.html``, the first page of a section its index; with their links.

    The links are read before the join, so the pages' texts stay where they are.
    """
    section = F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)/", 1)
    found = pages(s, d).select("page_id", section.alias("section"),
                               D.pattern_imports(F.col("html"), LINK).alias("links"))
    index = found.groupBy("section").agg(F.min("page_id").alias("first_page"))
    name = F.when(F.col("page_id") == F.col("first_page"), "index").otherwise(
        F.col("page_id").cast("string"))
    return written(found.join(index, "section").select(
        "page_id", F.concat("section", F.lit("/"), name, F.lit(".html")).alias("path"), "links"), "site")


def deps_edges(s, d):
    return D.edges_of(pages(s, d), D.pattern_imports(F.col("html"), LINK), ["page_id"])


def link_nodes(s, d):
    return D.link_nodes(pages(s, d), "url")


def link_graph(s, d):
    site = _site(s, d)
    edges = D.edges_of(site, F.col("links"), ["path"])
    return D.link_graph(site, edges, suffix=".html", package="/index.html")


def advisory_match(s, d):
    installed = read_table(s, d, "part").select(
        "p_partkey", F.lower("p_type").alias("package"),
        F.concat_ws(".", F.regexp_extract("p_brand", "[0-9]+", 0),
                    F.col("p_size").cast("string")).alias("installed"))
    table = s.createDataFrame(list(ADVISORIES),
                              "package string, affected string, description string, id string")
    return A.advisory_match(installed, table).select("p_partkey", "package", "installed", "id")


REGISTERED: tuple[Query, ...] = (
    dup_blocks, dup_locations, dup_locations_skew, dup_smells, dup_totals,
    scan_filter, encoding_census, size_guard, language_of_path, path_parts,
    explode_lines, explode_breaks, line_classes, long_lines, file_stats, file_stats_default,
    corpus_totals, file_metrics, comment_density, comment_islands, commented_code,
    largest_files, head_sample,
    rule_hits, rule_hits_embedded, gated_rules, rule_counts_by_type, issues_ranked,
    top_issue_types, simple_matches, repeated_words,
    lexicon_refs, lexicon_rollup, first_hit, wildcard_counts, top_counts, marker_counts,
    marker_totals, naming_styles, naming_styles_pages, token_topk, token_heavy, token_exact,
    block_extents,
    corpus_issues, issues_per_file, corpus_metrics, maintainability, technical_debt,
    recommendations, smell_recommendations, summary_long, file_details_json,
    style_metrics, file_persona, persona_groups, corpus_score,
    language_share, top_languages, advice_join,
    deps_edges, link_nodes, link_graph, advisory_match,
)


def registry(more: tuple[Query, ...] = ()) -> dict[str, Query]:
    def typed(query: Query) -> Query:
        return lambda spark, folder: exact(query(spark, folder))

    return {q.__name__: typed(q) for q in (*REGISTERED, *more)}
