"""Operator 8: URL filters by a tree of path templates.

Urls that a rule fits are the labelled ones. For each host, paths grow a tree segment by segment:

* a segment that is too rare among its siblings is *variable* and becomes a wildcard;
* siblings whose rows are labelled alike (the same quarters of the smoothed block and allow shares) are
  *merged* into one branch;
* at a path's end stands a template, and it is rejected if its smoothed share of blocked rows among labelled ones
  reaches the threshold. Templates without labels fall back on the prior, which never rejects.

Every round is an aggregate over branches and one over (branch, segment); at most ``1 / min_share`` segments of a branch survive as
literals. Rows are only ever joined with these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.llm.shared import kept

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict); a rule is written as host + path.
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one. Of equally long ones, the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def templates(paths: DataFrame, min_rows: int = 5, min_share: float = 0.01, depth: int | None = None) -> DataFrame:
    """``paths`` (host, path, n, blocked, allowed) with ``template``. A branch with fewer than ``min_rows`` rows is not grown
    further: all its segments are variable. Segments below ``depth``, if that is given, are one ``**``.

    In a template ``*`` stands for a variable segment and ``*23`` for merged ones; a segment's own ``*`` and ``~`` are written
    ``~1`` and ``~0``, so that neither is taken for the other.

    A round grows all branches by what their rows have in common and one segment more, so there are as many rounds as a
    path has splits, not segments. Rows whose template is settled leave.
    """
    parts = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.replace(F.replace(x, F.lit("~"), F.lit("~0")), F.lit("*"), F.lit("~1")))
    keys = ["host", "path", "n", "blocked", "allowed"]
    rest = F.col("rest")
    limited = parts if depth is None else F.slice(parts, 1, depth)
    end = F.lit("") if depth is None else F.when(F.size(parts) > depth, F.lit("/**")).otherwise(F.lit(""))
    rows = kept(paths.select(*keys, F.col("host").alias("branch"), limited.alias("rest"), end.alias("end")), "paths")
    settled: list[DataFrame] = []

    def out(some: DataFrame) -> DataFrame:
        """All that is left of these paths is variable, or nothing is left."""
        return some.select(*keys, F.concat("branch", F.repeat(F.lit("/*"), F.size("rest")), "end").alias("template"))

    while True:
        # What all rows of a branch begin with is what the first and the last of them have in common.
        facts = rows.groupBy("branch").agg(F.sum("n").alias("all_n"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        differ = F.filter(F.sequence(F.lit(0), F.size("low")), lambda i: (i == F.size("low")) | (F.get("low", i) != F.get("high", i)))
        facts = kept(facts.select("branch", "all_n", F.get(differ, F.lit(0)).alias("common")), "branches")
        met = rows.join(facts, "branch")
        settled.append(out(met.where(F.col("all_n") < min_rows)))
        grown = met.where(F.col("all_n") >= min_rows).select(
            *keys, F.concat_ws("/", F.array("branch"), F.slice("rest", F.lit(1), F.col("common"))).alias("branch"),
            F.slice("rest", F.col("common") + 1, F.size("rest")).alias("rest"), "end")
        grown = kept(grown, "grown")
        settled.append(out(grown.where(F.size("rest") == 0)))
        inner = grown.where(F.size("rest") > 0)
        if inner.isEmpty():
            break
        children = inner.groupBy("branch", F.get("rest", F.lit(0)).alias("part")).agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "allowed")])
        of = children.groupBy("branch").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "blocked", "allowed")])
        usual = children.join(of, "branch").where((F.col("n") >= min_rows) & (F.col("n") >= min_share * F.col("all_n")))
        quarter = lambda c: F.round(4 * (F.col(c) + F.col(f"all_{c}") / F.col("all_n")) / (F.col("n") + 1)).cast("int")
        usual = usual.select("branch", "part", quarter("blocked").alias("b"), quarter("allowed").alias("a"))
        alike = usual.groupBy("branch", "b", "a").agg(F.count("*").alias("members"))
        token = F.when(F.col("members") == 1, F.col("part")).otherwise(F.format_string("*%d%d", "b", "a"))
        named = kept(usual.join(alike, ["branch", "b", "a"]).select("branch", "part", token.alias("token")), "tokens")
        rows = kept(inner.withColumn("part", F.get("rest", F.lit(0))).join(named, ["branch", "part"], "left").select(
            *keys, F.concat("branch", F.lit("/"), F.coalesce("token", F.lit("*"))).alias("branch"),
            F.slice("rest", F.lit(2), F.size("rest")).alias("rest"), "end"), "rows")
    all_rows = settled[0]
    for more in settled[1:]:
        all_rows = all_rows.unionAll(more)
    return all_rows


def judge(pages: DataFrame, rules: list[Rule], threshold: float = 0.8, prior_rows: float = 4.0, **tree) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of ``pages`` (page_id, url).

    Null url or none with ``://``: empty host and path, a template of their own, no rule. Null page_id, repeated
    rows: judged like any other. Empty table: no rows. Other columns are not read.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "told": verdict})
    paths = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count_if(F.col("told") == "block").alias("blocked"), F.count_if(F.col("told") == "allow").alias("allowed"))
    made = kept(templates(paths, **tree), "templates")
    sums = made.agg(F.sum("blocked"), F.sum(F.col("blocked") + F.col("allowed"))).first()
    prior = min(0.5, (sums[0] or 0) / (sums[1] or 1))
    purity = (F.col("b") + prior_rows * prior) / (F.col("l") + prior_rows)
    judged = kept(made.groupBy("template").agg(F.sum("blocked").alias("b"), F.sum(F.col("blocked") + F.col("allowed")).alias("l")).select(
        "template", purity.alias("purity")), "judged")
    known = made.join(judged, "template").select("host", "path", "template", "purity")
    return rows.join(known, ["host", "path"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("told", F.when(F.col("purity") >= threshold, "block").otherwise("allow")).alias("verdict"), "template", "purity")
