"""DuckDB SQL that gives the same rows as the registered queries.

Written from the specification with windows and line tables, not from the Spark
expressions, so that the two are independent.
"""

from __future__ import annotations

from corpusqa import values as V
from corpusqa.functions.patterns import SPACE_CHARS
from corpusqa.plans import queries as Q

W = r"\p{L}\p{N}_"
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES = "'" + SPACE_CHARS + "'"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def starts(x: str, markers) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {text(m)})" for m in markers) + ")"


def clip(x: str, n: int, stripped: bool = False) -> str:
    head = f"left({x}, {n})"
    return f"({strip(head) if stripped else head} || CASE WHEN length({x}) > {n} THEN '...' ELSE '' END)"


# Lines of all documents: raw and stripped, numbered from 1.
L = f"""l0 AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS raw,
  generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
l AS (SELECT *, {strip('raw')} AS s FROM l0)"""
L_BREAKS = L.replace("string_split(text, chr(10))",
                     "string_split(regexp_replace(text, '\\n$', ''), chr(10))").replace(
    "FROM documents)", "FROM documents WHERE text <> '')")


def marker(style, x: str = "s") -> str:
    out = starts(x, style.default)
    for lang, markers in style.markers.items():
        out = f"CASE WHEN lang = {text(lang)} THEN {starts(x, markers)} ELSE {out} END"
    return out


def states(style, lines: str = "l") -> str:
    """Lines with m (marker), ev (1 open, 0 close), op (opens at its end), st (state after)."""
    blocks = ("TRUE" if style.block_languages is None else
              "lang IN (" + ", ".join(map(text, style.block_languages or ("-",))) + ")")
    o, c = text(style.block_open), text(style.block_close)
    after = f"substr(s, strpos(s, {o}) + {len(style.block_open)})"
    return f"""e AS (SELECT *, {marker(style)} AS m,
  CASE WHEN NOT ({blocks}) THEN NULL WHEN contains(s, {c}) THEN 0
       WHEN contains(s, {o}) THEN 1 END AS ev,
  ({blocks}) AND contains(s, {o}) AND NOT contains({after}, {c}) AS op FROM {lines}),
w AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw_st FROM e),
v AS (SELECT *, coalesce(raw_st, 0) AS st,
  lag(raw_st) OVER (PARTITION BY doc_id ORDER BY n) AS raw_prev,
  coalesce(lag(raw_st) OVER (PARTITION BY doc_id ORDER BY n), 0) AS prev,
  coalesce(last_value(raw_st) OVER (PARTITION BY doc_id ORDER BY n
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS fin FROM w)"""


BASIC_CLASS = """CASE WHEN s = '' THEN 'blank'
  WHEN m OR prev = 1 OR (ev = 1 AND op) THEN 'comment' ELSE 'code' END"""


def file_stats(style, cols: str = "doc_id") -> str:
    return f"""WITH {L_BREAKS}, {states(style)}, c AS (SELECT *, {BASIC_CLASS} AS class FROM v)
SELECT {cols}, CAST(count(*) AS BIGINT) AS lines,
  CAST(count(*) FILTER (class = 'code') AS BIGINT) AS code,
  CAST(count(*) FILTER (class = 'comment') AS BIGINT) AS comments,
  CAST(count(*) FILTER (class = 'blank') AS BIGINT) AS blank
FROM c GROUP BY {cols}"""


def metrics_cte(style, cols: str) -> str:
    """fm: one row per document with loc, comment lines and mean line length."""
    return f"""{states(style)}, fm AS (SELECT {cols}, CAST(count(*) AS BIGINT) AS loc,
  CAST(count(*) FILTER (m OR coalesce(raw_prev, fin) = 1) AS BIGINT) AS comment_lines,
  coalesce(sum(length(raw)) FILTER (s <> '') / nullif(count(*) FILTER (s <> ''), 0), 0.0)
    AS avg_line_length
FROM v GROUP BY {cols})"""


def hits_cte(rules, name: str = "h") -> str:
    """One row per match: the patterns used here stay within a line."""
    parts = []
    for r in rules:
        gate = "TRUE" if "all" in r.languages else (
            "lang IN (" + ", ".join(text(x.lower()) for x in r.languages) + ")")
        if r.pattern.startswith(r"\b"):
            # Whole words: cut the line into words and count the equal ones.
            word = r.pattern.replace(r"\b", "")
            n = (f"len(list_filter(regexp_extract_all(raw, '[{W}]+'), "
                 f"lambda x: regexp_full_match(x, {text(word)})))")
        else:
            n = f"len(regexp_extract_all(raw, {text(r.pattern)}))"
        parts.append(
            f"SELECT doc_id, source, lang, {text(r.category)} AS category, {text(r.name)} AS type, "
            f"{text(r.description)} AS description, {text(r.severity)} AS severity, n AS line, "
            f"s AS context, unnest(range({n})) AS k FROM l WHERE {gate}")
    return f"{name} AS ({' UNION ALL '.join(parts)})"


SIMPLE_WORDS = {"of_the": (r"of", r"the"), "doubled": (r"de", r"de")}


def segments_cte(pattern: str, name: str) -> str:
    """Matches of a pattern over whole texts, with the line each starts on."""
    p = text(pattern)
    return f"""{name}0 AS (SELECT doc_id,
  unnest(string_split(regexp_replace(text, {text('(' + pattern + ')')}, chr(1) || '\\1', 'g'), chr(1))) AS piece,
  generate_subscripts(string_split(regexp_replace(text, {text('(' + pattern + ')')}, chr(1) || '\\1', 'g'), chr(1)), 1) AS i,
  regexp_extract_all(text, {p}) AS ms FROM documents),
{name} AS (SELECT doc_id, i, ms[i - 1] AS seg, 1 + CAST(sum(length(piece) - length(replace(piece, chr(10), '')))
  OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS line
  FROM {name}0 QUALIFY i > 1)"""


COMMENT = r"(?:#|//)[^\n]*\n?|(?s:/\*.*?\*/)"
SEGMENT = COMMENT + r"""|(?s:""" + '"""' + r""".*?""" + '"""' + r""")|(?s:'''.*?''')|(?s:".*?")|(?s:'.*?')|(?s:`.*?`)"""


def keyword_test(x: str, word: str) -> str:
    if " " in word:
        return f"regexp_matches({x}, {text('(?i)' + word)})"
    return f"regexp_matches({x}, {text(f'(?i)(^|[^{W}]){word}([^{W}]|$)')})"


def refs_cte() -> str:
    parts = [
        f"SELECT doc_id, line, {text(w)} AS keyword, "
        f"{clip(_trim_break(), V.CONTEXT_CHARS, True)} AS context FROM sg WHERE {keyword_test('seg', w)}"
        for w in Q.WORDS]
    return f"{segments_cte(SEGMENT, 'sg')}, refs AS ({' UNION ALL '.join(parts)})"


def _trim_break() -> str:
    return "CASE WHEN ends_with(seg, chr(10)) THEN left(seg, length(seg) - 1) ELSE seg END"


def markers_cte() -> str:
    parts = [
        f"SELECT doc_id, {text(m)} AS marker, CAST(count(*) AS BIGINT) AS n FROM cm "
        f"WHERE regexp_matches(seg, {text(f'(?i)(^|[^{W}]){m}[:{WS}]')}) GROUP BY doc_id"
        for m in Q.MARKERS]
    return f"{segments_cte(COMMENT, 'cm')}, mk AS ({' UNION ALL '.join(parts)})"


def words_of(column: str) -> str:
    return f"regexp_extract_all({column}, '[{W}]+')"


def wildcard_sum(column: str = "text") -> str:
    tests = []
    for w in V.WILDCARD_WORDS:
        body = w.replace("*", "%")
        tests.append(f"len(list_filter({words_of(column)}, lambda x: lower(x) LIKE {text(body)}))")
    return "CAST(" + " + ".join(tests) + " AS BIGINT)"


NAMING = {
    "snake": "[a-z0-9]+(_[a-z0-9]+)+",
    "camel": "[a-z]+([A-Z][a-z0-9]*)+",
    "pascal": "[A-Z][a-z0-9]+([A-Z][a-z0-9]*)*",
    "screaming": "[A-Z0-9]+(_[A-Z0-9]+)+",
}


def naming_columns(column: str) -> str:
    return ", ".join(
        f"CAST(len(list_filter({words_of(column)}, lambda x: regexp_full_match(x, '{p}'))) AS BIGINT) AS {n}"
        for n, p in NAMING.items())


TOKENS = f"""t AS (SELECT doc_id, token, count(*) AS n FROM (
  SELECT doc_id, unnest({words_of('text')}) AS token FROM documents)
  WHERE regexp_matches(token, '^[a-zA-Z_]') GROUP BY doc_id, token),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS rk FROM t)"""

# Windows of five clean lines; the default markers, no block language among these.
WINDOWS = f"""cl AS (SELECT doc_id, n, s, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS c
  FROM l WHERE s <> '' AND NOT {starts('s', V.DEFAULT_MARKERS)}),
wn AS (SELECT doc_id, n, c, string_agg(s, chr(10)) OVER f AS block, count(*) OVER f AS cnt FROM cl
  WINDOW f AS (PARTITION BY doc_id ORDER BY c ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
wk AS (SELECT doc_id, n, c, block, md5(block) AS key FROM wn WHERE cnt = 5
  AND length(block) >= {V.WINDOW_MIN_CHARS}
  AND regexp_matches(block, '[\\p{{L}}\\p{{Nl}}\\p{{No}}_]{{3}}')),
dk AS (SELECT key, CAST(count(*) AS BIGINT) AS n_locations, min(block) AS block
  FROM wk GROUP BY key HAVING count(*) > 1)"""


def islands_cte(test: str, style=Q.ISLAND_TEST) -> str:
    """isl: runs of two or more comment lines that pass the test."""
    cut = "s"
    for m in reversed(style.default):
        cut = f"CASE WHEN starts_with(s, {text(m)}) THEN {strip(f'substr(s, {len(m) + 1})')} ELSE {cut} END"
    return f"""k AS (SELECT doc_id, source, lang, n, {starts('s', style.default)} AS is_comment,
  ({test.format(x=f'({cut})')}) AS hit FROM l WHERE s <> ''),
g AS (SELECT *, sum(CASE WHEN is_comment THEN 0 ELSE 1 END)
  OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM k),
isl AS (SELECT doc_id, min(source) AS source, min(lang) AS lang, CAST(min(n) AS BIGINT) AS line,
  CAST(max(n) AS BIGINT) AS end_line, CAST(count(*) AS BIGINT) AS n
  FROM g WHERE is_comment AND hit GROUP BY doc_id, grp HAVING count(*) >= 2)"""


CODE_TEST = (f"regexp_matches({{x}}, '(^|[^{W.replace('{', '{{').replace('}', '}}')}])"
             f"(if|for|while|def|function|return|class)([^{W.replace('{', '{{').replace('}', '}}')}]|$)"
             r"|\{{|\}}|=|\([^\n]*\)')")

ISSUE_COLS = "doc_id, category, type, description, severity, line"


def issues_cte() -> str:
    """iss: everything corpus_issues finds."""
    name, category, severity, description = V.LONG_LINE
    return f"""{L}, {hits_cte(Q.RULES)}, {islands_cte(CODE_TEST)}, {WINDOWS},
sm AS (SELECT wk.doc_id, any_value(dk.n_locations) AS n_locations, min(wk.c) AS c
  FROM wk JOIN dk USING (key) GROUP BY wk.doc_id, wk.key),
iss AS (SELECT {ISSUE_COLS}, context FROM h
  UNION ALL SELECT doc_id, {text(category)}, {text(name)}, {text(description)}, {text(severity)}, n, NULL
    FROM l WHERE length(s) > {V.LONG_LINE_CHARS}
  UNION ALL SELECT doc_id, '{V.CODE_SMELLS}', 'commented_code',
    'Commented-out code block (lines ' || line || '-' || end_line || ')', 'low', line, NULL FROM isl
  UNION ALL SELECT doc_id, '{V.CODE_SMELLS}', 'duplicate_code',
    'Part of duplicated code block (5 lines) found in ' || n_locations || ' location(s)', 'high', c, NULL
    FROM sm)"""


HOURS = f"""(CASE severity WHEN 'critical' THEN 8 WHEN 'high' THEN 4 WHEN 'medium' THEN 2
  WHEN 'low' THEN 1 ELSE 2 END * CASE category WHEN '{V.SECURITY}' THEN 1.5
  WHEN '{V.STYLE}' THEN 0.0 ELSE 1.0 END)"""

CATEGORY_COUNTS = ", ".join(
    f"CAST(count(*) FILTER (category = '{c}') AS BIGINT) AS {c}" for c in V.CATEGORIES)


def index_expr(g: str, loc: str, cm: str) -> str:
    # No functions in these texts: the average complexity is 0.
    return f"least(100.0, greatest(0.0, 171.0 - 5.2 * (0 - 1) - 0.23 * {g} - 16.2 * ({loc} / 1000) + 50 * {cm}))"


def rating_expr(x: str) -> str:
    bands = " ".join(f"WHEN {x} >= {b} THEN {text(n)}" for b, n in V.RATING_BANDS)
    return f"CASE {bands} ELSE {text(V.LOWEST_RATING)} END"


def metrics_row() -> str:
    """cm: the corpus metrics row."""
    return f"""{issues_cte()}, {metrics_cte(Q.ISLAND_TEST, 'doc_id')},
tot AS (SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(loc) AS BIGINT) AS loc,
  CAST(sum(comment_lines) AS BIGINT) AS cl, sum(avg_line_length * loc) AS wl FROM fm),
ic AS (SELECT {CATEGORY_COUNTS}, sum({HOURS}) AS hours FROM iss),
db AS (SELECT CAST(count(*) AS BIGINT) AS blocks FROM dk),
cm0 AS (SELECT files, loc AS total_lines_of_code, cl AS total_comment_lines,
  cl / loc AS comment_density, wl / loc AS avg_line_length,
  {V.CODE_SMELLS} AS code_smell_count, {V.SECURITY} AS security_issue_count,
  {V.PERFORMANCE} AS performance_issue_count, {V.STYLE} AS style_issue_count,
  CAST(0 AS BIGINT) AS function_count, 0.0::DOUBLE AS avg_function_complexity,
  0.0::DOUBLE AS avg_function_size, 0.0::DOUBLE AS avg_function_params,
  blocks AS duplicated_code_blocks, CAST(hours + 3 * blocks AS DOUBLE) AS technical_debt_hours
  FROM tot, ic, db),
cm AS (SELECT *, {index_expr('avg_line_length', 'total_lines_of_code', 'comment_density')}
  AS maintainability_index, round_even(technical_debt_hours / 8, 1) AS technical_debt_days FROM cm0)"""


def style_cte() -> str:
    """st: one row per document, with the persona."""
    sm = "'L'"
    for lang, m in Q.STYLE_MARKERS.items():
        sm = f"CASE WHEN lang = {text(lang)} THEN {text(m)} ELSE {sm} END"
    names = ("todo", "fixme", "hack", "xxx", "note")
    pivot = ", ".join(
        f"coalesce(sum(n) FILTER (marker = {text(m)}), 0)::BIGINT AS {n}"
        for n, m in zip(names, Q.MARKERS))
    return f"""{L_BREAKS}, {markers_cte()}, {refs_cte()}, {pairs_cte()},
pc AS (SELECT doc_id, count(*) AS pairs FROM pr GROUP BY doc_id),
fl AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS loc,
  CAST(count(*) FILTER (starts_with(s, {sm})) AS BIGINT) AS comment_lines,
  coalesce(sum(length(raw)) FILTER (s <> '') / nullif(count(*) FILTER (s <> ''), 0), 0.0) AS avg_len
  FROM l GROUP BY doc_id),
mp AS (SELECT doc_id, {pivot} FROM mk GROUP BY doc_id),
rc AS (SELECT doc_id, count(*) AS refs FROM refs GROUP BY doc_id),
f0 AS (SELECT d.doc_id, d.source, loc, comment_lines, comment_lines / loc AS density, avg_len,
  {naming_columns('text')},
  {', '.join(f'coalesce({n}, 0) AS {n}' for n in names)},
  CAST(coalesce(pairs, 0) AS BIGINT) AS simple_hits, {wildcard_sum()} AS words,
  CAST(coalesce(refs, 0) AS BIGINT) AS "references"
  FROM documents d JOIN fl USING (doc_id) LEFT JOIN mp USING (doc_id) LEFT JOIN rc USING (doc_id) LEFT JOIN pc USING (doc_id)),
f1 AS (SELECT *, snake + camel + pascal + screaming AS total,
  greatest(snake, camel, pascal, screaming) AS largest FROM f0),
st AS (SELECT *, CASE WHEN simple_hits > 2 AND density > 0.2 THEN '{V.PERSONA_SIMPLE}'
  WHEN hack > 0 AND density < 0.05 AND avg_len < 70 THEN '{V.PERSONA_CYNICAL}'
  WHEN fixme > 1 AND density > 0.15 THEN '{V.PERSONA_ANXIOUS}'
  WHEN density > 0.1 AND density < 0.25 AND total > 10 THEN
    CASE WHEN largest > 1.5 * (total - largest) THEN '{V.PERSONA_METHODICAL}' ELSE '{V.PERSONA_NEUTRAL}' END
  WHEN density < 0.08 THEN '{V.PERSONA_OVERCONFIDENT}' ELSE '{V.PERSONA_NEUTRAL}' END AS persona FROM f1)"""


# Path of a page below its host, and its pieces.
PATHS = """p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?|[?#].*$', '', 'g') AS path FROM pages),
b AS (SELECT *, list_extract(string_split(path, '/'), -1) AS base FROM p),
x AS (SELECT *, CASE WHEN contains(path, '/') THEN left(path, length(path) - length(base) - 1) ELSE '' END AS dir,
  CASE WHEN regexp_matches(base, '^\\.*[^.].*\\.') THEN
    '.' || list_extract(string_split(base, '.'), -1) ELSE '' END AS ext FROM b)"""


def language_case(languages) -> str:
    arms = " ".join(
        f"WHEN lower(ext) IN ({', '.join(map(text, exts))}) THEN {text(lang)}"
        for lang, exts in languages.items())
    return f"CASE {arms} ELSE 'Unknown' END"


SITE = """site0 AS (SELECT page_id, html, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS section FROM pages),
site AS (SELECT page_id, html, section || '/' || CASE WHEN page_id = min(page_id) OVER (PARTITION BY section)
  THEN 'index' ELSE CAST(page_id AS VARCHAR) END || '.html' AS path FROM site0)"""


def _version(x: str) -> str:
    """Two-part versions as one number."""
    return f"CAST(split_part({x}, '.', 1) AS BIGINT) * 1000 + CAST(split_part({x}, '.', 2) AS BIGINT)"


def _advisories() -> str:
    """Version ranges as comparisons of numbers, one arm per advisory."""
    arms = []
    for package, affected, _, advisory in Q.ADVISORIES:
        if advisory in V.IGNORED_ADVISORIES:
            continue
        alternatives = []
        for alternative in affected.split("|"):
            clauses = []
            for clause in alternative.split(","):
                op = next(o for o in ("<=", ">=", "==", "!=", "<", ">") if clause.startswith(o))
                major, _, minor = clause[len(op):].partition(".")
                sql_op = {"==": "=", "!=": "<>"}.get(op, op)
                clauses.append(f"v {sql_op} {int(major) * 1000 + int(minor or 0)}")
            alternatives.append("(" + " AND ".join(clauses) + ")")
        arms.append(f"SELECT p_partkey, package, installed, {text(advisory)} AS id FROM i "
                    f"WHERE package = {text(package)} AND ({' OR '.join(alternatives)})")
    return " UNION ALL ".join(arms)


def _r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def registry() -> dict[str, str]:
    css = ", ".join(f"coalesce({c}, 0) AS {c}" for c in V.CATEGORIES)
    advice = ", ".join(
        f"({text(k)}, CAST({i + 1} AS BIGINT), {text(p)})"
        for k, ps in Q.PRACTICES.items() for i, p in enumerate(ps[:3]))
    out = {
        "dup_blocks": f"""WITH {L}, {WINDOWS} SELECT key, CAST(5 AS BIGINT) AS lines,
  CAST(len(regexp_extract_all(block, '[{W}]+')) AS BIGINT) AS tokens, n_locations,
  {clip('block', V.SNIPPET_CHARS)} AS code_snippet FROM dk""",
        "dup_locations": f"""WITH {L}, {WINDOWS} SELECT key, doc_id, CAST(c AS BIGINT) AS clean_start,
  CAST(c + 4 AS BIGINT) AS clean_end, CAST(n AS BIGINT) AS line, n_locations FROM wk JOIN dk USING (key)""",
        "dup_smells": f"""WITH {L}, {WINDOWS} SELECT doc_id, '{V.CODE_SMELLS}' AS category,
  'duplicate_code' AS type, 'Part of duplicated code block (5 lines) found in ' || any_value(n_locations)
  || ' location(s)' AS description, 'high' AS severity, CAST(min(c) AS BIGINT) AS line,
  CAST(NULL AS VARCHAR) AS context FROM wk JOIN dk USING (key) GROUP BY doc_id, key""",
        "dup_totals": f"""WITH {L}, {WINDOWS}, a AS (SELECT key, count(DISTINCT doc_id) AS d FROM wk
  JOIN dk USING (key) GROUP BY key) SELECT CAST(count(*) AS BIGINT) AS blocks,
  CAST(sum(d) AS BIGINT) AS smells, CAST(sum(d) * 4 AS DOUBLE) AS smell_hours FROM a""",
        "scan_filter": f"""WITH {PATHS} SELECT page_id, path FROM x WHERE {language_case(V.COARSE_LANGUAGES)} <> 'Unknown'
  AND NOT starts_with(base, '.') AND len(list_filter(string_split(dir, '/'),
  lambda y: starts_with(y, '.') OR y IN ({', '.join(map(text, V.IGNORED_DIRECTORIES))}))) = 0""",
        "encoding_census": """WITH c AS (SELECT CASE WHEN text = '' THEN 'N/A (Empty)'
  WHEN strlen(text) = length(text) THEN 'ascii' ELSE 'utf-8' END AS encoding, count(*) AS n
  FROM documents GROUP BY 1)
SELECT encoding, CAST(n AS BIGINT) AS n, round_even(n / sum(n) OVER () * 100, 1) AS percentage FROM c""",
        "size_guard": f"""WITH {L_BREAKS}, c AS (SELECT d.doc_id, count(l.n) AS k FROM documents d
  LEFT JOIN l USING (doc_id) GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS files_found, CAST(count(*) FILTER (k <= 20) AS BIGINT) AS files_analyzed,
  CAST(count(*) FILTER (k > 20) AS BIGINT) AS files_skipped FROM c""",
        "language_of_path": f"""WITH {PATHS} SELECT page_id, {language_case(V.COARSE_LANGUAGES)} AS coarse,
  {language_case(V.FINE_LANGUAGES)} AS fine FROM x""",
        "path_parts": f"""WITH {PATHS} SELECT page_id, dir AS dirname, base AS basename, ext AS extension,
  left(path, length(path) - length(ext)) AS stem,
  CASE WHEN starts_with(path, 'en/') THEN substr(path, 4) ELSE base END AS relative FROM x""",
        "explode_lines": f"WITH {L} SELECT doc_id, CAST(n AS BIGINT) AS line_no, raw AS line FROM l",
        "explode_breaks": r"""WITH u AS (SELECT page_id, string_split(regexp_replace(regexp_replace(html,
  '\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '\n$', ''), chr(10)) AS xs
  FROM pages WHERE html <> '')
SELECT page_id, CAST(generate_subscripts(xs, 1) AS BIGINT) AS line_no, unnest(xs) AS line FROM u""",
        "line_classes": f"""WITH {L_BREAKS}, {states(Q.BASIC_TEST)}
SELECT doc_id, CAST(n AS BIGINT) AS line_no, {BASIC_CLASS} AS class FROM v""",
        "long_lines": f"""WITH {L} SELECT doc_id, '{V.STYLE}' AS category, 'long_line' AS type,
  'Line exceeds 100 characters' AS description, 'low' AS severity, CAST(n AS BIGINT) AS line,
  CAST(NULL AS VARCHAR) AS context FROM l WHERE length(s) > 100""",
        "file_stats": file_stats(Q.BASIC_TEST),
        "file_stats_default": file_stats(_basic_default()),
        "corpus_totals": f"""WITH fs AS ({file_stats(Q.BASIC_TEST, 'doc_id, lang')})
SELECT lang, CAST(grouping(lang) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS files, CAST(sum(lines) AS BIGINT) AS lines,
  CAST(sum(code) AS BIGINT) AS code, CAST(sum(comments) AS BIGINT) AS comments,
  CAST(sum(blank) AS BIGINT) AS blank FROM fs GROUP BY ROLLUP (lang)""",
        "file_metrics": f"""WITH {L}, {metrics_cte(Q.STYLE_TEST, 'doc_id')}
SELECT doc_id, loc, comment_lines, round(comment_lines / loc, 6) AS comment_density,
  round(avg_line_length, 6) AS avg_line_length FROM fm""",
        "comment_density": f"""WITH {L}, {metrics_cte(Q.STYLE_TEST, 'doc_id, source')}
SELECT source, CAST(sum(comment_lines) AS BIGINT) AS comment_lines, CAST(sum(loc) AS BIGINT) AS loc,
  round(sum(comment_lines) / sum(loc), 6) AS density FROM fm GROUP BY source""",
        "comment_islands": f"""WITH {L}, {islands_cte("contains({x}, ',')")}
SELECT doc_id, line, end_line, n FROM isl""",
        "commented_code": f"""WITH {L}, {islands_cte(CODE_TEST)} SELECT doc_id, '{V.CODE_SMELLS}' AS category,
  'commented_code' AS type, 'Commented-out code block (lines ' || line || '-' || end_line || ')' AS description,
  'low' AS severity, line, CAST(NULL AS VARCHAR) AS context FROM isl""",
        "largest_files": file_stats(_basic_default()) + " ORDER BY lines DESC, doc_id LIMIT 10",
        "head_sample": f"""WITH {L_BREAKS} SELECT doc_id, CAST(count(*) AS BIGINT) AS lines,
  string_agg(raw, chr(10) ORDER BY n) FILTER (n <= 15) AS sample FROM l GROUP BY doc_id
  ORDER BY lines DESC, doc_id LIMIT 3""",
        "rule_hits": f"""WITH {L}, {hits_cte(Q.RULES)} SELECT doc_id, category, type, description, severity,
  CAST(line AS BIGINT) AS line, context FROM h""",
        "rule_hits_embedded": f"""WITH pl AS (SELECT page_id, unnest(string_split(html, chr(10))) AS raw,
  generate_subscripts(string_split(html, chr(10)), 1) AS n FROM pages)
SELECT page_id, '{V.CODE_SMELLS}' AS category, 'var_usage' AS type, 'Using var instead of let/const' AS description,
  'medium' AS severity, CAST(n AS BIGINT) AS line FROM (SELECT page_id, n,
  unnest(range(len(regexp_extract_all(raw, '(^|[^{W}])var[{WS}]+')))) AS k FROM pl)""",
        "gated_rules": f"""WITH {L}, {hits_cte(Q.GATED_RULES)} SELECT doc_id, category, type, description, severity,
  CAST(line AS BIGINT) AS line FROM h""",
        "rule_counts_by_type": f"""WITH {L}, {hits_cte(Q.RULES + Q.GATED_RULES)} SELECT category, type,
  CAST(count(*) AS BIGINT) AS n FROM h GROUP BY category, type""",
        "issues_ranked": f"""WITH {L}, {hits_cte(Q.RULES)} SELECT doc_id, type, severity,
  CAST(CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END
  AS BIGINT) AS severity_score, CAST(line AS BIGINT) AS line FROM h""",
        "top_issue_types": f"""WITH {L}, {hits_cte(Q.RULES + Q.GATED_RULES)} SELECT type,
  CAST(count(*) AS BIGINT) AS n FROM h WHERE category = '{V.CODE_SMELLS}' GROUP BY type ORDER BY n DESC, type LIMIT 3""",
        "simple_matches": _simple_matches(),
        "repeated_words": _repeated_words(),
        "lexicon_refs": f"WITH {refs_cte()} SELECT doc_id, line, keyword, context FROM refs",
        "lexicon_rollup": f"""WITH {refs_cte()} SELECT doc_id, CAST(grouping(doc_id) AS BIGINT) AS total,
  CAST(count(*) AS BIGINT) AS n FROM refs GROUP BY ROLLUP (doc_id)""",
        "first_hit": f"""WITH {refs_cte()} SELECT doc_id, CAST(count(*) AS BIGINT) AS n,
  min((line, keyword))[1] AS first_line, min((line, keyword))[2] AS first_keyword FROM refs GROUP BY doc_id""",
        "wildcard_counts": f"""SELECT * FROM (SELECT doc_id, {wildcard_sum()} AS n FROM documents) WHERE n > 0""",
        "top_counts": f"""SELECT * FROM (SELECT doc_id, {wildcard_sum()} AS n FROM documents) WHERE n > 0
  ORDER BY n DESC, doc_id LIMIT 3""",
        "marker_counts": f"WITH {markers_cte()} SELECT * FROM mk",
        "marker_totals": f"WITH {markers_cte()} SELECT marker, CAST(sum(n) AS BIGINT) AS n FROM mk GROUP BY marker",
        "naming_styles": f"SELECT doc_id, {naming_columns('text')} FROM documents",
        "naming_styles_pages": f"SELECT page_id, {naming_columns('html')} FROM pages",
        "token_topk": f"WITH {TOKENS} SELECT doc_id, token, CAST(n AS BIGINT) AS n FROM r WHERE rk <= {V.TOP_TOKENS}",
        "token_heavy": f"""WITH {TOKENS} SELECT token, CAST(sum(n) AS BIGINT) AS n FROM r WHERE rk <= {V.TOP_TOKENS}
  GROUP BY token""",
        "token_exact": f"WITH {TOKENS} SELECT token, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY token",
        "block_extents": f"""WITH {L}, q AS (SELECT doc_id, n, s,
  length(raw) - length(ltrim(raw, '{Q.EXTENT_INDENT}')) AS ind FROM l WHERE s <> ''),
hd AS (SELECT * FROM q WHERE regexp_matches(s, '{Q.EXTENT_HEADER}')),
nx AS (SELECT hd.doc_id, hd.n, any_value(hd.s) AS s, min(q.n) FILTER (q.ind <= hd.ind) AS stop
  FROM hd LEFT JOIN q ON q.doc_id = hd.doc_id AND q.n > hd.n GROUP BY hd.doc_id, hd.n)
SELECT nx.doc_id, CAST(nx.n AS BIGINT) AS line, CAST(max(q.n) AS BIGINT) AS end_line, any_value(nx.s) AS header
  FROM nx JOIN q ON q.doc_id = nx.doc_id AND q.n >= nx.n AND (nx.stop IS NULL OR q.n < nx.stop)
  GROUP BY nx.doc_id, nx.n""",
        "corpus_issues": f"WITH {issues_cte()} SELECT {ISSUE_COLS.replace('line', 'CAST(line AS BIGINT) AS line')} FROM iss",
        "issues_per_file": f"""WITH {issues_cte()}, a AS (SELECT doc_id, {CATEGORY_COUNTS},
  CAST(count(*) AS BIGINT) AS issues FROM iss GROUP BY doc_id)
SELECT d.doc_id, d.lang, {css}, coalesce(issues, 0) AS issues FROM documents d LEFT JOIN a USING (doc_id)""",
        "corpus_metrics": f"""WITH {metrics_row()} SELECT * REPLACE ({_r6('comment_density', 'avg_line_length',
  'maintainability_index', 'technical_debt_hours', 'technical_debt_days')}),
  {rating_expr('maintainability_index')} AS maintainability_rating FROM cm""",
        "maintainability": f"""WITH {L}, {metrics_cte(Q.ISLAND_TEST, 'doc_id, source')},
a AS (SELECT source, sum(avg_line_length * loc) / sum(loc) AS g, sum(loc) AS loc,
  sum(comment_lines) / sum(loc) AS cm FROM fm GROUP BY source),
b AS (SELECT source, {index_expr('g', 'loc', 'cm')} AS i FROM a)
SELECT source, round(i, 6) AS maintainability_index, {rating_expr('i')} AS maintainability_rating FROM b""",
        "technical_debt": f"""WITH {issues_cte()}, a AS (SELECT (SELECT sum({HOURS}) FROM iss) +
  3 * (SELECT count(*) FROM dk) AS h)
SELECT CAST(h AS DOUBLE) AS debt_hours, round_even(CAST(h AS DOUBLE) / 8, 1) AS debt_days FROM a""",
        "recommendations": _recommendations(),
        "smell_recommendations": f"""WITH {issues_cte()}, a AS (SELECT type, CAST(count(*) AS BIGINT) AS n FROM iss
  WHERE category = '{V.CODE_SMELLS}' GROUP BY type ORDER BY n DESC, type LIMIT 3)
SELECT type, n, CASE type WHEN 'duplicate_code' THEN 'Eliminate ' || n ||
  ' duplicated code blocks by creating reusable functions'
  ELSE 'Address ' || n || ' instances of ''' || type || '''' END AS text FROM a""",
        "summary_long": f"""WITH {metrics_row()}, a AS (SELECT *, {rating_expr('maintainability_index')} AS rt FROM cm)
SELECT CAST(1 AS BIGINT) AS position, 'Total lines of code' AS metric,
  format('{{:,}}', total_lines_of_code) AS value FROM a
UNION ALL SELECT 2, 'Files analyzed', files::VARCHAR FROM a
UNION ALL SELECT 3, 'Comment density', printf('%.1f', comment_density * 100) || '%' FROM a
UNION ALL SELECT 4, 'Maintainability rating', rt FROM a
UNION ALL SELECT 5, 'Technical debt days', printf('%.1f', technical_debt_days) FROM a
UNION ALL SELECT 6, 'Code smells', code_smell_count::VARCHAR FROM a
UNION ALL SELECT 7, 'Security issues', security_issue_count::VARCHAR FROM a
UNION ALL SELECT 8, 'Performance issues', performance_issue_count::VARCHAR FROM a
UNION ALL SELECT 9, 'Style issues', style_issue_count::VARCHAR FROM a
UNION ALL SELECT 10, 'Duplicated code blocks', duplicated_code_blocks::VARCHAR FROM a""",
        "file_details_json": f"""WITH {issues_cte()}, fs AS ({file_stats(_basic_default(), 'doc_id, lang')}),
fi AS (SELECT *, '{{"line":' || line || ',"type":' || to_json(type) || ',"description":' || to_json(description) || ',"severity":'
  || to_json(severity) || CASE WHEN context IS NULL THEN '' ELSE ',"context":' || to_json(context) END || '}}' AS item FROM iss),
fd AS (SELECT doc_id, {', '.join(f"coalesce(string_agg(item, ',' ORDER BY line, type, description, severity, context NULLS FIRST) FILTER (category = '{c}'), '') AS {c}" for c in V.CATEGORIES)}
  FROM fi GROUP BY doc_id)
SELECT fs.doc_id, '{{"lang":' || to_json(lang) || ',"lines":' || lines || ',"code":' || code || ',"comments":' || comments || ',"blank":' || blank
  || ',"all_issues":{{' || CASE WHEN fd.doc_id IS NULL THEN '' ELSE {" || ',' || ".join(f"'{chr(34)}{c}{chr(34)}:[' || {c} || ']'" for c in V.CATEGORIES)} END || '}}}}' AS details_json
  FROM fs LEFT JOIN fd ON fd.doc_id = fs.doc_id""",
        "style_metrics": f"""WITH {style_cte()} SELECT doc_id, loc, comment_lines, {_r6('density', 'avg_len')} FROM st""",
        "file_persona": f"""WITH {style_cte()} SELECT doc_id, loc, comment_lines, {_r6('density', 'avg_len')},
  snake, camel, pascal, screaming, todo, fixme, hack, xxx, note, simple_hits, words, "references", persona FROM st""",
        "persona_groups": f"""WITH {style_cte()} SELECT persona, CAST(count(*) AS BIGINT) AS n_files,
  min(doc_id) AS example FROM st GROUP BY persona""",
        "corpus_score": f"""WITH {style_cte()}, a AS (SELECT source, 50 + sum(CASE WHEN "references" > 0 THEN 2 ELSE 0 END
  - 3 * simple_hits + words + (todo + note) * 0.5 - fixme + hack + CASE persona
  WHEN '{V.PERSONA_CYNICAL}' THEN 2 WHEN '{V.PERSONA_METHODICAL}' THEN 3 WHEN '{V.PERSONA_ANXIOUS}' THEN -1
  WHEN '{V.PERSONA_SIMPLE}' THEN -5 WHEN '{V.PERSONA_OVERCONFIDENT}' THEN 1 ELSE 0 END) AS p FROM st GROUP BY source)
SELECT source, CAST(least(100, greatest(0, trunc(p))) AS BIGINT) AS score FROM a""",
        "language_share": """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, CAST(n AS BIGINT) AS n, round_even(n / sum(n) OVER () * 100, 1) AS percentage FROM c""",
        "top_languages": """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, CAST(n AS BIGINT) AS n, round_even(n / sum(n) OVER () * 100, 1) AS percentage FROM c
  ORDER BY n DESC, lang LIMIT 3""",
        "advice_join": f"""WITH pr(language, position, practice) AS (VALUES {advice})
SELECT pr.language, pr.position, pr.practice FROM pr
  JOIN (SELECT DISTINCT lower(lang) AS language FROM documents) USING (language)""",
        "deps_edges": f"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, {text(Q.LINK)}, 1)) AS module
  FROM pages""",
        "link_nodes": r"""SELECT DISTINCT md5(url) AS id,
  regexp_replace(replace(url, '\', '/'), '/{2,}', '/', 'g') AS label, url AS title FROM pages""",
        "link_graph": f"""WITH {SITE}, e AS (SELECT DISTINCT path AS from_path,
  unnest(regexp_extract_all(html, {text(Q.LINK)}, 1)) AS module FROM site),
t AS (SELECT e.from_path, coalesce(a.path, b.path) AS to_path FROM e
  LEFT JOIN site a ON a.path = e.module || '.html' LEFT JOIN site b ON b.path = e.module || '/index.html')
SELECT DISTINCT from_path, to_path FROM t WHERE to_path IS NOT NULL AND from_path <> to_path""",
        "advisory_match": f"""WITH i0 AS (SELECT p_partkey, lower(p_type) AS package,
  regexp_extract(p_brand, '[0-9]+') || '.' || p_size AS installed FROM part),
i AS (SELECT *, {_version('installed')} AS v FROM i0) {_advisories()}""",
    }
    out["dup_locations_skew"] = out["dup_locations"]
    return out


def _basic_default():
    from corpusqa.functions.linecodes import BASIC_STYLE
    return BASIC_STYLE


# Of a chain of hits, each of which begins with the end of the one before, every second counts.
EVERY_SECOND = """pr1 AS (SELECT *, i - 2 * row_number() OVER (PARTITION BY doc_id, type ORDER BY i) AS chain FROM pr0),
pr AS (SELECT doc_id, type, description, line, match FROM pr1
  QUALIFY row_number() OVER (PARTITION BY doc_id, type, chain ORDER BY i) % 2 = 1)"""


def runs_cte() -> str:
    """rn: runs of word and of other characters, with the two that follow and the line."""
    runs = f"regexp_extract_all(text, '[{W}]+|[^{W}]+')"
    return f"""rn0 AS (SELECT doc_id, unnest({runs}) AS run,
  generate_subscripts({runs}, 1) AS i FROM documents),
rn AS (SELECT *, lead(run) OVER o AS gap, lead(run, 2) OVER o AS nxt,
  1 + coalesce(sum(length(run) - length(replace(run, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM rn0
  WINDOW o AS (PARTITION BY doc_id ORDER BY i))"""


def pairs_cte() -> str:
    """pr: hits of the simple rules, found as two word runs with white space between.

    Hits do not overlap, so of a chain such as ``de de de`` every second pair counts.
    """
    found = " UNION ALL ".join(
        f"SELECT doc_id, {text(r.name)} AS type, {text(r.description)} AS description, i, "
        f"CAST(line AS BIGINT) AS line, left(run || gap || nxt, {V.MATCH_CHARS}) AS match FROM rn "
        f"WHERE lower(run) = '{SIMPLE_WORDS[r.name][0]}' AND lower(nxt) = '{SIMPLE_WORDS[r.name][1]}' "
        f"AND regexp_full_match(gap, '[{WS}]+')" for r in Q.SIMPLE_RULES)
    return f"""{runs_cte()},
pr0 AS ({found}),
{EVERY_SECOND}"""


def _repeated_words() -> str:
    """A word, white space, and the same word in any case."""
    rule = Q.REPEATED_WORD[0]
    return f"""WITH {runs_cte()},
pr0 AS (SELECT doc_id, {text(rule.name)} AS type, {text(rule.description)} AS description, i,
  CAST(line AS BIGINT) AS line, left(run || gap || nxt, {V.MATCH_CHARS}) AS match FROM rn
  WHERE lower(run) = lower(nxt) AND regexp_full_match(run, '[{W}]+') AND regexp_full_match(gap, '[{WS}]+')),
{EVERY_SECOND} SELECT doc_id, type, description, line, match FROM pr"""


def _simple_matches() -> str:
    return f"WITH {pairs_cte()} SELECT doc_id, type, description, line, match FROM pr"


def _recommendations() -> str:
    t = "(code_smell_count + security_issue_count + performance_issue_count + style_issue_count)"
    bad = [f"maintainability_index < 59.5", "comment_density < 0.1", "security_issue_count > 0", f"{t} > 50"]
    rows = [
        ("style", "style_issue_count > 10", text("Enforce a consistent code style across the project")),
        ("style", "style_issue_count > 10", text("Consider using a linter or automated formatter")),
        ("security", "security_issue_count > 3",
         text("Conduct a thorough security review and consider automated security scanning")),
        ("project", "comment_density < 0.1",
         text("Improve code documentation - current comment density is too low")),
        ("project", "technical_debt_days > 10",
         "'Allocate time to address technical debt (estimated at ' || printf('%.1f', technical_debt_days) || ' days)'"),
        ("project", "maintainability_index < 40",
         text("Consider a significant refactoring effort to improve maintainability")),
        ("report", bad[0], text("Improve overall code maintainability (score is low).")),
        ("report", bad[1], text("Increase code documentation (comment density is low).")),
        ("report", bad[2], text("Address detected security vulnerabilities.")),
        ("report", bad[3], text("Prioritize fixing the high number of detected code issues.")),
        ("report", "NOT (" + " OR ".join(bad) + ")",
         text("Code looks relatively clean based on available metrics!")),
    ]
    selects = " UNION ALL ".join(
        f"SELECT CAST({i + 1} AS BIGINT) AS position, '{topic}' AS topic, {value} AS text FROM cm WHERE {cond}"
        for i, (topic, cond, value) in enumerate(rows))
    return f"WITH {metrics_row()} {selects}"
