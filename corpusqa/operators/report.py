"""Report tables and sinks: advice, recommendations, summaries, JSON, parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusqa import values as V


def advice(docs: DataFrame, lang: Column, practices: dict = V.BEST_PRACTICES,
           first: int | None = None) -> DataFrame:
    """Practices for the languages a corpus has: language, position, practice."""
    table = F.create_map(*[
        x for name, items in practices.items()
        for x in (F.lit(name), F.array(*map(F.lit, items)))])
    present = docs.select(F.lower(lang).alias("language")).distinct()
    rows = present.select("language", F.posexplode(table[F.col("language")]).alias("i", "practice"))
    rows = rows.select("language", (F.col("i") + 1).alias("position"), "practice")
    return rows if first is None else rows.filter(F.col("position") <= first)


def recommendations(metrics: DataFrame, limits: V.Limits = V.LIMITS) -> DataFrame:
    """Recommendation rows of a corpus-metrics row: position, topic, text."""
    m = F.col
    total = (m("code_smell_count") + m("security_issue_count")
             + m("performance_issue_count") + m("style_issue_count"))
    low_index = m("maintainability_index") < limits.index
    low_density = m("comment_density") < limits.density
    insecure, many = m("security_issue_count") > 0, total > limits.issues
    applies = {
        "style": m("style_issue_count") > limits.style, "linter": m("style_issue_count") > limits.style,
        "security": m("security_issue_count") > limits.security, "documentation": low_density,
        "debt": m("technical_debt_days") > limits.debt_days,
        "refactoring": m("maintainability_rating").isin(*limits.ratings),
        "report_index": low_index, "report_density": low_density, "report_security": insecure, "report_issues": many,
        "report_clean": ~low_index & ~low_density & ~insecure & ~many,
    }
    days = m("technical_debt_days").cast("string")
    rows = F.array(*[F.struct(
        F.lit(i + 1).alias("position"), F.lit(topic).alias("topic"),
        (F.format_string(text, days) if "%s" in text else F.lit(text)).alias("text"),
        applies[name].alias("applies")) for i, (name, topic, text) in enumerate(V.RECOMMENDATIONS)])
    return metrics.select(F.inline(F.filter(rows, lambda r: r["applies"]))).drop("applies")


def smell_recommendations(top_types: DataFrame) -> DataFrame:
    """One line per most frequent smell type (rows type, n)."""
    text = F.format_string(V.OTHER_SMELL_ADVICE, F.col("n"), F.col("type"))
    for name, message in V.SMELL_ADVICE.items():
        text = F.when(F.col("type") == name, F.format_string(message, F.col("n"))).otherwise(text)
    return top_types.select("type", "n", text.alias("text"))


def type_recommendations(counts: DataFrame) -> DataFrame:
    """One line per security or performance type that occurs (rows category, type, n)."""
    table = F.create_map(*[x for kv in V.TYPE_ADVICE.items() for x in map(F.lit, kv)])
    return (counts.filter(F.col("category").isin(V.SECURITY, V.PERFORMANCE))
            .select("category", "type", table[F.col("type")].alias("text"))
            .filter(F.col("text").isNotNull()))


def summary_long(metrics: DataFrame) -> DataFrame:
    """A metrics row as (position, metric, value) lines of text."""
    m = F.col

    def count(name: str) -> Column:
        return m(name).cast("bigint").cast("string")

    lines = [
        ("Total lines of code", F.format_number(m("total_lines_of_code"), 0)),
        ("Files analyzed", count("files")),
        ("Comment density", F.concat(F.format_number(m("comment_density") * 100, 1), F.lit("%"))),
        ("Maintainability rating", m("maintainability_rating")),
        ("Technical debt days", m("technical_debt_days").cast("decimal(18,1)").cast("string")),
        ("Code smells", count("code_smell_count")),
        ("Security issues", count("security_issue_count")),
        ("Performance issues", count("performance_issue_count")),
        ("Style issues", count("style_issue_count")),
        ("Duplicated code blocks", count("duplicated_code_blocks")),
    ]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("metric"),
                              value.alias("value")) for i, (name, value) in enumerate(lines)])
    return metrics.select(F.inline(rows))


def file_details(stats: DataFrame, issues: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One JSON text per file: its counts and its issues by category.

    The list is one file's issues, which is bounded by the file.
    """
    fields = [c for c in issues.columns if c not in (id_col, "category")]
    per_file = issues.groupBy(id_col).agg(F.sort_array(F.collect_list(
        F.struct("category", "line", *[c for c in fields if c != "line"]))).alias("found"))
    grouped = F.struct(*[
        F.transform(F.filter(F.col("found"), lambda i: i["category"] == c),
                    lambda i: i.dropFields("category")).alias(c) for c in V.CATEGORIES])
    body = F.struct(*[c for c in stats.columns if c != id_col], grouped.alias("all_issues"))
    return (stats.join(per_file, id_col, "left")
            .select(id_col, F.to_json(body).alias("details_json")))


def write_issues(issues: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Issues as parquet, one directory per category."""
    issues.write.mode(mode).partitionBy("category").parquet(path)


def write_personas(facts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Documents as parquet, one directory per persona."""
    facts.write.mode(mode).partitionBy("persona").parquet(path)


def write_details(details: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per line."""
    details.select(F.col("details_json").alias("value")).write.mode(mode).text(path)


def basic_summary(guard: DataFrame, totals: DataFrame) -> DataFrame:
    """(position, metric, value) lines of text from the size guard's row and the row of totals."""
    m = F.col

    def share(name: str) -> Column:
        percent = F.format_number(m(name) / m("lines") * 100, 1)
        return F.concat(F.format_number(m(name), 0), F.when(m("lines") > 0, F.concat(F.lit(" ("), percent, F.lit("%)"))).otherwise(""))

    lines = [
        ("Files found", m("files_found").cast("string")), ("Files analyzed", m("files_analyzed").cast("string")),
        ("Files skipped", m("files_skipped").cast("string")), ("Total lines", F.format_number("lines", 0)),
        ("Code lines", share("code")), ("Comment lines", share("comments")), ("Blank lines", share("blank")),
    ]
    one = guard.join(totals)  # one row each
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(i + 1).alias("position"), F.lit(name).alias("metric"), value.alias("value")) for i, (name, value) in enumerate(lines)])))


def lexicon_summary(facts: DataFrame, score: DataFrame, markers: DataFrame) -> DataFrame:
    """(section, name, n): score, references, hits and word counts in all, and each marker and persona.

    ``facts`` are rows of ``metrics.style_facts``; ``markers`` those of ``lexicon.marker_totals``.
    """
    m = F.col
    sums = facts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("references", "simple_hits", "words")])
    totals = sums.select(F.inline(F.array(*[F.struct(F.lit("total").alias("section"), F.lit(c).alias("name"), m(c).alias("n"))
                                            for c in ("references", "simple_hits", "words")])))
    personas = facts.filter(m("persona").isNotNull()).groupBy("persona").agg(F.count(F.lit(1)).alias("n"))
    return (score.select(F.lit("total").alias("section"), F.lit("score").alias("name"), m("score").cast("bigint").alias("n"))
            .unionAll(totals).unionAll(markers.select(F.lit("marker"), "marker", m("n").cast("bigint")))
            .unionAll(personas.select(F.lit("persona"), "persona", "n")))


def report_advice(advice: DataFrame) -> DataFrame:
    """Rows of ``recommendations`` for a report: the lines of topic ``report`` stand in where there are no others."""
    own = advice.filter(F.col("topic") != "report")
    found = own.agg((F.count(F.lit(1)) > 0).alias("own")).scalar()
    return advice.filter((F.col("topic") != "report") | ~found)
