"""More registered queries: total orders, member lists, scanned smells, versions, bytes and relative links.

Versions, bytes and code are derived by Spark from every row of the tables, in a way that SQL can follow without
parsing them again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from corpusqa import values as V
from corpusqa.operators import (advisories as A, deps as D, dups, lexicon as X, lines as L, metrics as M, rank,
                                report, rules as R, smells as SM)
from corpusqa.plans import oracle as O, queries as Q
from corpusqa.plans.derived import _LENGTHS, _choice, _pick
from corpusqa.sources import files as SF
from corpusqa.sources.tables import read_table, written

# ----------------------------------------------------------------- total orders

def issue_order(s, d):
    issues = R.ranked(R.rule_scan(Q.documents(s, d), Q.RULES)).select("doc_id", "type", "severity_score", "line")
    return rank.numbered(issues, [F.desc("severity_score"), "line", "doc_id", "type"])


def file_order(s, d):
    return rank.numbered(Q.issues_per_file(s, d).select("doc_id", "issues"), [F.desc("issues"), F.desc("doc_id")])


def word_order(s, d):
    return rank.numbered(X.wildcard_counts(Q.documents(s, d)), [F.desc("n"), "doc_id"])


def block_order(s, d):
    blocks = Q.dup_blocks(s, d).select("key", "lines", "tokens")
    return rank.numbered(blocks, [F.desc("lines"), F.desc("tokens"), "key"])


def issue_order_in_file(s, d):
    issues = R.ranked(R.rule_scan(Q.documents(s, d), Q.RULES)).select("doc_id", "type", "severity_score", "line")
    return rank.numbered(issues, [F.desc("severity_score"), "line", "type"], by=["doc_id"])


MEMBERS = 100


def persona_members(s, d):
    facts = Q.file_persona(s, d).filter(F.col("persona").isNotNull())
    listed = rank.chunks(facts, "persona", "doc_id", MEMBERS)
    return listed.select("persona", "chunk", "n", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids"))


# -------------------------------------------------------------------- summaries

def basic_summary(s, d):
    docs = Q.documents(s, d)
    return report.basic_summary(L.size_guard(docs, max_lines=20), M.corpus_totals(L.file_stats(docs, style=Q.BASIC_TEST)))


def lexicon_summary(s, d):
    facts = written(Q.file_persona(s, d), "style-facts")
    return report.lexicon_summary(facts, M.corpus_score(facts), Q.marker_totals(s, d))


def advice_all(s, d):
    return report.advice(read_table(s, d, "documents"), Q.lang(), Q.PRACTICES)


def report_advice(s, d):
    return report.report_advice(written(Q.recommendations(s, d), "advice"))


TYPE_RULES = tuple(V.Rule(name, category, "high", name, pattern) for name, category, pattern in (
    ("sql_injection", V.SECURITY, "[Tt]he"), ("xss", V.SECURITY, "[0-9]{4,}"), ("nested_loops", V.PERFORMANCE, "que"),
    ("inefficient_loop", V.PERFORMANCE, "no such text"), ("hardcoded_credentials", V.STYLE, "de")))


def type_recommendations(s, d):
    return report.type_recommendations(R.rule_counts(R.rule_scan(Q.documents(s, d), TYPE_RULES)))


# --------------------------------------------------------------------- versions

# What the SQL knows of each form: epoch, pre-release rank and number, post, development rank and number; -9: unreadable.
# ``c`` and ``e`` are numbers of the row.
FORMS = (
    ("{a}.{b}", "0, 3, 0, -1, 1, 0"), ("v{a}.{b}", "0, 3, 0, -1, 1, 0"), ("{a}.{b}.0", "0, 3, 0, -1, 1, 0"),
    ("{a}.{b}a{c}", "0, 0, c, -1, 1, 0"), ("{a}.{b}-beta.{c}", "0, 1, c, -1, 1, 0"), ("{a}.{b}rc{c}", "0, 2, c, -1, 1, 0"),
    ("{a}.{b}.post{c}", "0, 3, 0, c, 1, 0"), ("{a}.{b}.dev{c}", "0, -1, 0, -1, 0, c"), ("{a}.{b}a{c}.dev{e}", "0, 0, c, -1, 0, e"),
    ("{a}.{b}.post{c}.dev{e}", "0, 3, 0, c, 0, e"), ("{a}.{b}.0-SNAPSHOT", "0, -1, 0, -1, 0, 0"), ("1!{a}.{b}", "1, 3, 0, -1, 1, 0"),
    ("{a}.{b}+build.{c}", "0, 3, 0, -1, 1, 0"), ("{a}.{b}-final-x", "-9, 0, 0, 0, 0, 0"), ("{a}.{b}-{c}", "0, 3, 0, c, 1, 0"),
)
# Range, and the same as SQL over k (epoch, a, b, pre, pre number, post, dev, dev number), ep, a and b.
RANGES = (
    ("<2.0", "k < (0, 2, 0, 3, 0, -1, 1, 0)"),
    (">=1.20,<2.30", "k >= (0, 1, 20, 3, 0, -1, 1, 0) AND k < (0, 2, 30, 3, 0, -1, 1, 0)"),
    ("~=1.4", "k >= (0, 1, 4, 3, 0, -1, 1, 0) AND ep = 0 AND a = 1"),
    ("~=2.2.post1", "k >= (0, 2, 2, 3, 0, 1, 1, 0) AND ep = 0 AND a = 2"),
    ("==1.4.*", "ep = 0 AND a = 1 AND b = 4"), ("!=2.10.*", "NOT (ep = 0 AND a = 2 AND b = 10)"),
    ("==3.7|<1.2a1", "k = (0, 3, 7, 3, 0, -1, 1, 0) OR k < (0, 1, 2, 0, 1, -1, 1, 0)"),
    (">2.5.post1", "k > (0, 2, 5, 3, 0, 1, 1, 0)"), ("<=1.25rc1,!=1.3", "k <= (0, 1, 25, 2, 1, -1, 1, 0) AND k <> (0, 1, 3, 3, 0, -1, 1, 0)"),
    ("==1!2.*", "ep = 1 AND a = 2"), ("what", "NULL"), ("what,<1.0", "NULL AND k < (0, 1, 0, 3, 0, -1, 1, 0)"), ("*", "TRUE"),
)


def _versions(s, d) -> DataFrame:
    """A requirement line for each part: its project is the brand, its package the type."""
    row = read_table(s, d, "part").select("p_partkey", F.col("p_brand").alias("project"), F.lower("p_type").alias("package"), "p_size")
    key = F.col("p_partkey")
    numbers = {"a": key % 4, "b": F.col("p_size"), "c": key % 3, "e": key % 2}

    def spelled(form: str) -> Column:
        return F.concat(*[numbers[number].cast("string") if number else F.lit(plain)
                          for number, plain in re.findall(r"\{(\w)\}|([^{}]+)", form)])

    version = _pick((key % len(FORMS)).cast("int"), *[spelled(f) for f, _ in FORMS])
    return row.select("p_partkey", "project", F.concat("package", F.when(key % 7 == 0, F.lit(">=")).otherwise(F.lit(" == ")), version,
                                                       F.when(key % 5 == 0, F.lit("  # pinned")).otherwise("")).alias("line"))


def _findings(s, d) -> tuple[DataFrame, DataFrame]:
    pinned = A.parse_requirements(_versions(s, d)).filter(F.col("operator") == "==")
    table = s.createDataFrame([(p, r, r, f"{p}-{i}") for p in ("economy", "small", "medium", "standard", "large", "promo")
                               for i, (r, _) in enumerate(RANGES)], "package string, affected string, description string, id string")
    return pinned, A.advisory_match(pinned, table)


def advisory_versions(s, d):
    return _findings(s, d)[1].select("p_partkey", "package", "installed", "id", "answer")


def parsed_requirements(s, d):
    return A.parse_requirements(_versions(s, d)).select("p_partkey", "package", "operator", "installed")


def scan_status(s, d):
    """Of projects whose brand ends in 3 no file is known; findings count for the advisory ``~=2.2.post1`` and the unreadable one."""
    pinned, found = _findings(s, d)
    projects = _versions(s, d).select("project").distinct()
    checked = projects.filter(~F.col("project").endswith("3"))
    few = found.filter(F.col("id").rlike("-(3|10)$") & ~F.col("project").endswith("3") & F.col("project").rlike("[0-7]$"))
    return A.scan_status(projects, checked, few)


def requirement_files(s, d):
    """The first requirement file of each brand, among files that are named by the part."""
    names = ("pyproject.toml", "setup.py", "requirements.in", "requirements.txt")
    files = read_table(s, d, "part").select("p_partkey", F.col("p_brand").alias("folder"),
                                            _pick((F.col("p_size") % 4).cast("int"), *map(F.lit, names)).alias("name"))
    one = files.groupBy("folder", "name").agg(F.min("p_partkey").alias("p_partkey")).filter(
        ~(F.col("folder").endswith("1") & (F.col("name") == "requirements.txt")))
    return SF.requirement_files(one, F.col("folder"), F.col("name")).select("project", "name", "p_partkey")


# ------------------------------------------------------------------------ bytes

def _bytes(s, d) -> DataFrame:
    """Documents as files in nine encodings, sound and broken."""
    utf8 = F.encode("text", "UTF-8")
    ascii_ = F.regexp_replace("text", "[^\\x00-\\x7f]", "?").cast("binary")
    mark = lambda digits: F.unhex(F.lit(digits))
    return Q.documents(s, d).select("doc_id", _pick(
        (F.col("doc_id") % 9).cast("int"), utf8, F.concat(mark("EFBBBF"), utf8), F.concat(mark("FFFE"), F.encode("text", "UTF-16LE")),
        F.concat(mark("FEFF"), F.encode("text", "UTF-16BE")), F.concat(mark("0000FEFF"), F.encode("text", "UTF-32")),
        F.concat(utf8, mark("FF78")), F.lit(b""), ascii_, F.concat(utf8, mark("E282"))).alias("content"))


def decode(s, d):
    c = F.col("content")
    return _bytes(s, d).select("doc_id", SF.encoding_label(c).alias("encoding"), F.md5(SF.decode(c)).alias("replaced"),
                               F.md5(SF.decode(c, "ignore")).alias("ignored"))


def byte_census(s, d):
    return SF.encoding_census(_bytes(s, d), F.col("content"))


# --------------------------------------------------------------- relative links

def relative_links(s, d):
    """Pages as files ``top/<section>/<id % 5>/<id>.py`` that import by one, two and three dots."""
    section = F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)/", 1)
    i = F.col("page_id")

    def at(k: int) -> Column:
        return F.concat(((i + k) % 5).cast("string"), F.lit("."), (i + k).cast("string"))

    modules = F.array(F.concat(F.lit("."), (i + 5).cast("string")), F.concat(F.lit(".."), at(1)), F.concat(F.lit("...en."), at(2)),
                      F.lit("."), F.lit("nothing"), F.concat(F.lit("top.fr."), at(3)))
    site = Q.pages(s, d).select(F.concat(F.lit("top/"), section, F.lit("/"), (i % 5).cast("string"), F.lit("/"), i.cast("string"), F.lit(".py")).alias("path"),
                                modules.alias("modules"))
    return D.link_graph(site, D.edges_of(site, F.col("modules"), ["path"]))


# ----------------------------------------------------------------------- smells

PYTHON_SHAPES = (
    "except E:", "    pass", "    y = 7", "x = 0", "LIMIT = 99", "if a and b or c and d or e:", "if a and b:",
    "# if a and b or c and d or e and 77:", "z = 'a and b or c 55'", "f(3, 4.5, 0x1F)", "", "elif p or q or r or s or t: g(1)", "except E: pass",
)
BRACE_SHAPES = (
    "let a = 5;", "const B = 64;", "if (a && b || (c && d) || e) { f(1); }", "if (a && b) { g(); }", "try { h(); } catch (e) { }",
    "try { h(); } catch { /* 12 */", "}", "var c; // 33", "while (a || b || c || d || f(0.5)) { }", "s = '77 && x';", "{",
)


def _coded(s, d, shapes, comment: str) -> DataFrame:
    """A shape for each line, chosen by its length, with the line itself behind it as a comment."""
    lines = F.transform(F.split("text", "\n", -1), lambda raw: F.concat(
        _pick(F.length(raw) % len(shapes), *map(F.lit, shapes)), F.lit(f"  {comment} "), raw))
    return Q.documents(s, d).select("doc_id", F.array_join(lines, "\n").alias("text"))


def python_smells(s, d):
    return SM.smell_scan(_coded(s, d, PYTHON_SHAPES, "#"), F.lit("Python")).drop("context")


def brace_smells(s, d):
    return SM.smell_scan(_coded(s, d, BRACE_SHAPES, "//"), F.lit("JavaScript")).drop("context")


REGISTERED = (issue_order, issue_order_in_file, file_order, word_order, block_order, persona_members,
              basic_summary, lexicon_summary, advice_all, report_advice, type_recommendations,
              advisory_versions, parsed_requirements, scan_status, requirement_files, decode, byte_census, relative_links,
              python_smells, brace_smells)

# --------------------------------------------------------------------- the SQL

_SCORE = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END"


def _place(order: str, by: str = "") -> str:
    return f"CAST(row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY {order}) AS BIGINT) AS position"


def _smell_rows(name: str, source: str) -> str:
    smell = next(x for x in V.DECLARED_SMELLS if x.name == name)
    return (f"SELECT doc_id, {O.text(V.CODE_SMELLS)} AS category, {O.text(name)} AS type, {O.text(smell.description)} AS description, "
            f"{O.text(smell.severity)} AS severity, CAST(n AS BIGINT) AS line FROM {source}")


def _times(counts: dict[int, int], kinds: int) -> str:
    """k: a row for each number of the shapes that have some."""
    arms = " ".join(f"WHEN {i} THEN {n}" for i, n in counts.items())
    return f"(SELECT doc_id, n, unnest(range(CASE c % {kinds} {arms} ELSE 0 END)) AS k FROM c)"


def oracle() -> dict[str, str]:
    ranked = f"WITH {O.L}, {O.hits_cte(Q.RULES)}, i AS (SELECT doc_id, type, CAST({_SCORE} AS BIGINT) AS severity_score, CAST(line AS BIGINT) AS line FROM h)"
    registered = O.registry()
    spelled = " ".join(f"WHEN {k} THEN " + " || ".join(
        f"CAST({number} AS VARCHAR)" if number else O.text(plain)
        for number, plain in re.findall(r"\{(\w)\}|([^{}]+)", f)) for k, (f, _) in enumerate(FORMS))
    known = " ".join(f"WHEN {k} THEN ({t})" for k, (_, t) in enumerate(FORMS))
    versions = f"""v0 AS (SELECT p_partkey, p_brand AS project, lower(p_type) AS package, p_partkey % 4 AS a, p_size::BIGINT AS b,
  p_partkey % 3 AS c, p_partkey % 2 AS e, CASE WHEN p_partkey % 7 = 0 THEN '>=' ELSE '==' END AS operator FROM part),
v1 AS (SELECT *, CASE p_partkey % {len(FORMS)} {spelled} END AS installed,
  CASE p_partkey % {len(FORMS)} {known} END AS f FROM v0),
v AS (SELECT *, f[1] AS ep, (f[1], a, b, f[2], f[3], f[4], f[5], f[6]) AS k FROM v1)"""
    arms = " UNION ALL ".join(
        f"SELECT *, package || '-{i}' AS id, CASE WHEN ep = -9 AND {O.text(r)} <> '*' THEN NULL ELSE ({test}) END AS met FROM v "
        f"WHERE operator = '=='" for i, (r, test) in enumerate(RANGES))
    findings = f"{versions}, m AS ({arms}), fd AS (SELECT *, CASE WHEN met THEN 'affected' ELSE 'unreadable' END AS answer FROM m WHERE met IS NULL OR met)"
    shape = "CASE WHEN text = '' AND doc_id % 9 IN (0, 7) THEN 'N/A (Empty)'"
    encodings = f"""en AS (SELECT doc_id, {shape} WHEN doc_id % 9 = 6 THEN 'N/A (Empty)'
  WHEN doc_id % 9 = 0 THEN CASE WHEN strlen(text) = length(text) THEN 'ascii' ELSE 'utf-8' END
  WHEN doc_id % 9 = 1 THEN 'UTF-8-SIG' WHEN doc_id % 9 IN (2, 3) THEN 'UTF-16' WHEN doc_id % 9 = 4 THEN 'UTF-32'
  WHEN doc_id % 9 = 7 THEN 'ascii' ELSE 'other' END AS encoding,
  CASE doc_id % 9 WHEN 5 THEN text || chr(65533) || 'x' WHEN 6 THEN '' WHEN 7 THEN regexp_replace(text, '[^\x00-\x7f]', '?', 'g')
  WHEN 8 THEN text || chr(65533) ELSE text END AS replaced FROM documents)"""
    section = "regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1)"
    python, braces = len(PYTHON_SHAPES), len(BRACE_SHAPES)
    return {
        "issue_order": f"{ranked} SELECT *, {_place('severity_score DESC, line, doc_id, type')} FROM i",
        "issue_order_in_file": f"{ranked} SELECT *, {_place('severity_score DESC, line, type', 'doc_id')} FROM i",
        "file_order": f"WITH q AS ({registered['issues_per_file']}) SELECT doc_id, issues, {_place('issues DESC, doc_id DESC')} FROM q",
        "word_order": f"WITH q AS ({registered['wildcard_counts']}) SELECT *, {_place('n DESC, doc_id')} FROM q",
        "block_order": f"WITH q AS ({registered['dup_blocks']}) SELECT key, lines, tokens, {_place('lines DESC, tokens DESC, key')} FROM q",
        "persona_members": f"""WITH q AS ({registered['file_persona']}), r AS (SELECT persona, doc_id,
  (row_number() OVER (PARTITION BY persona ORDER BY doc_id) - 1) // {MEMBERS} + 1 AS chunk FROM q)
SELECT persona, CAST(chunk AS BIGINT) AS chunk, CAST(count(*) AS BIGINT) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids
  FROM r GROUP BY persona, chunk""",
        "basic_summary": f"""WITH g AS ({registered['size_guard']}), t AS (SELECT sum(lines)::BIGINT AS lines, sum(code)::BIGINT AS code,
  sum(comments)::BIGINT AS comments, sum(blank)::BIGINT AS blank FROM ({registered['file_stats']})), a AS (SELECT * FROM g, t)
SELECT CAST(1 AS BIGINT) AS position, 'Files found' AS metric, files_found::VARCHAR AS value FROM a
UNION ALL SELECT 2, 'Files analyzed', files_analyzed::VARCHAR FROM a UNION ALL SELECT 3, 'Files skipped', files_skipped::VARCHAR FROM a
UNION ALL SELECT 4, 'Total lines', format('{{:,}}', lines) FROM a
UNION ALL SELECT 5, 'Code lines', format('{{:,}}', code) || ' (' || printf('%.1f', code / lines * 100) || '%)' FROM a
UNION ALL SELECT 6, 'Comment lines', format('{{:,}}', comments) || ' (' || printf('%.1f', comments / lines * 100) || '%)' FROM a
UNION ALL SELECT 7, 'Blank lines', format('{{:,}}', blank) || ' (' || printf('%.1f', blank / lines * 100) || '%)' FROM a""",
        "lexicon_summary": f"""WITH f AS ({registered['file_persona']}), mt AS ({registered['marker_totals']}),
sc AS ({registered['corpus_score'].replace('SELECT source, 50 +', 'SELECT 50 +').replace('FROM st GROUP BY source)', 'FROM st)').replace('SELECT source, CAST(', 'SELECT CAST(')})
SELECT 'total' AS section, 'score' AS name, score AS n FROM sc
UNION ALL SELECT 'total', 'references', sum("references")::BIGINT FROM f UNION ALL SELECT 'total', 'simple_hits', sum(simple_hits)::BIGINT FROM f
UNION ALL SELECT 'total', 'words', sum(words)::BIGINT FROM f UNION ALL SELECT 'marker', marker, n FROM mt
UNION ALL SELECT 'persona', persona, count(*)::BIGINT FROM f WHERE persona IS NOT NULL GROUP BY persona""",
        "advice_all": "WITH pr(language, position, practice) AS (VALUES " + ", ".join(
            f"({O.text(k)}, CAST({i + 1} AS BIGINT), {O.text(p)})" for k, ps in Q.PRACTICES.items() for i, p in enumerate(ps))
        + ") SELECT pr.* FROM pr JOIN (SELECT DISTINCT lower(lang) AS language FROM documents) USING (language)",
        "report_advice": f"""WITH q AS ({registered['recommendations']}) SELECT * FROM q WHERE topic <> 'report'
  OR NOT EXISTS (SELECT 1 FROM q WHERE topic <> 'report')""",
        "type_recommendations": " UNION ALL ".join(
            f"SELECT DISTINCT {O.text(r.category)} AS category, {O.text(r.name)} AS type, {O.text(V.TYPE_ADVICE[r.name])} AS text "
            f"FROM documents WHERE regexp_matches(text, {O.text(r.pattern)})" for r in TYPE_RULES if r.category in (V.SECURITY, V.PERFORMANCE)),
        "advisory_versions": f"WITH {findings} SELECT p_partkey, package, installed, id, answer FROM fd",
        "parsed_requirements": f"WITH {versions} SELECT p_partkey, package, operator, installed FROM v",
        "scan_status": f"""WITH {findings}, few AS (SELECT * FROM fd WHERE regexp_matches(id, '-(3|10)$') AND NOT ends_with(project, '3')
  AND regexp_matches(project, '[0-7]$')), pj AS (SELECT DISTINCT project FROM v),
s AS (SELECT pj.project, count(*) FILTER (answer = 'affected') AS n, count(*) FILTER (answer = 'unreadable') AS u
  FROM pj LEFT JOIN few USING (project) GROUP BY 1)
SELECT project, CASE WHEN ends_with(project, '3') THEN 'No File' WHEN n > 0 THEN 'Vulnerable' WHEN u > 0 THEN 'Error' ELSE 'Secure' END AS status,
  CAST(n AS BIGINT) AS n_findings FROM s""",
        "requirement_files": """WITH f AS (SELECT p_brand AS project, p_size % 4 AS k, min(p_partkey) AS p_partkey FROM part GROUP BY ALL),
g AS (SELECT * FROM f WHERE k <> 1 AND NOT (ends_with(project, '1') AND k = 3))
SELECT project, CASE max(k) WHEN 3 THEN 'requirements.txt' WHEN 2 THEN 'requirements.in' ELSE 'pyproject.toml' END AS name,
  arg_max(p_partkey, k) AS p_partkey FROM g GROUP BY project""",
        "decode": f"""WITH {encodings} SELECT doc_id, encoding, md5(replaced) AS replaced,
  md5(CASE WHEN encoding IN ('UTF-16', 'UTF-32') THEN replaced ELSE replace(replaced, chr(65533), '') END) AS ignored FROM en""",
        "byte_census": f"""WITH {encodings}, c AS (SELECT encoding, count(*) AS n FROM en GROUP BY encoding)
SELECT encoding, CAST(n AS BIGINT) AS n, round_even(n / sum(n) OVER () * 100, 1) AS percentage FROM c""",
        "relative_links": f"""WITH p AS (SELECT page_id AS i, {section} AS section FROM pages),
f AS (SELECT *, 'top/' || section || '/' || i % 5 || '/' || i || '.py' AS path FROM p),
e AS (SELECT path, 'top/' || section || '/' || i % 5 || '/' || (i + 5) || '.py' AS target FROM f
  UNION ALL SELECT path, 'top/' || section || '/' || (i + 1) % 5 || '/' || (i + 1) || '.py' FROM f
  UNION ALL SELECT path, 'top/en/' || (i + 2) % 5 || '/' || (i + 2) || '.py' FROM f
  UNION ALL SELECT path, 'top/fr/' || (i + 3) % 5 || '/' || (i + 3) || '.py' FROM f)
SELECT DISTINCT e.path AS from_path, f.path AS to_path FROM e JOIN f ON f.path = e.target AND f.path <> e.path""",
        "python_smells": f"""WITH {_LENGTHS}, o AS (SELECT *, c % {python} AS k FROM c WHERE c % {python} NOT IN (7, 10)),
x AS (SELECT *, lead(k) OVER w AS k1, lead(k, 2) OVER w AS k2 FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
b AS (SELECT *, min(n) FILTER (k NOT IN (1, 2)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM o),
hd AS (SELECT b.doc_id, b.n FROM b LEFT JOIN o y ON y.doc_id = b.doc_id AND y.n > b.n AND (b.stop IS NULL OR y.n < b.stop)
  WHERE b.k IN (0, 12) GROUP BY b.doc_id, b.n HAVING count(*) FILTER (y.k = 2) = 0),
gl AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM o WHERE k IN (3, 8))
{_smell_rows('empty_catch', 'hd')} UNION ALL {_smell_rows('complex_conditional', '(SELECT * FROM o WHERE k IN (5, 11))')}
UNION ALL {_smell_rows('global_variable', f'(SELECT * FROM gl WHERE r > {V.MAX_GLOBALS})')}
UNION ALL {_smell_rows('magic_number', _times({2: 1, 9: 3}, python))}""",
        "brace_smells": f"""WITH {_LENGTHS}, o AS (SELECT *, c % {braces} AS k,
  CASE c % {braces} WHEN 5 THEN 1 WHEN 6 THEN -1 WHEN 10 THEN 1 ELSE 0 END AS d FROM c),
z AS (SELECT *, sum(d) OVER (PARTITION BY doc_id ORDER BY n) - d AS depth, lead(k) OVER (PARTITION BY doc_id ORDER BY n) AS k1 FROM o),
gl AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM z WHERE k IN (0, 7) AND depth = 0)
{_smell_rows('empty_catch', '(SELECT * FROM z WHERE k = 4 OR k = 5 AND k1 = 6)')}
UNION ALL {_smell_rows('complex_conditional', '(SELECT * FROM z WHERE k IN (2, 8))')}
UNION ALL {_smell_rows('global_variable', f'(SELECT * FROM gl WHERE r > {V.MAX_GLOBALS})')}
UNION ALL {_smell_rows('magic_number', _times({0: 1, 8: 1}, braces))}""",
    }
