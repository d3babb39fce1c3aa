"""The driver contract on the smallest tables, and streams against batches."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracle import compare, connect
from corpusqa import values as V
from corpusqa.operators import lines as L, metrics as M, rules as R
from corpusqa.plans import queries as Q
from corpusqa.sources.tables import SPREAD
from corpusqa.streaming import scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["key", "lines", "tokens", "n_locations", "code_snippet"]


def test_all_queries_have_sql():
    # The training-data queries, where they are present, have tests of their own.
    own = {n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert not own - set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note



def test_document_operators_do_not_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = F.col("lang")
    for df in (L.line_classes(docs), L.file_stats(docs), L.file_metrics(docs, lang=lang),
               R.rule_scan(docs, V.ISSUE_RULES, lang=lang), M.document_issues(docs, lang),
               M.quality_facts(docs, lang, ["doc_id"]), M.style_facts(docs, lang)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "BatchEvalPython" not in plan and "ArrowEval" not in plan
        assert "source" not in plan.split("ReadSchema")[1]


def test_stream_equals_batch(spark, tmp_path):
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    lang = F.col("lang")
    folder = str(tmp_path / "in")
    whole.repartition(5).write.parquet(folder)
    stream = scan.read_documents(spark, folder, whole.schema, files_per_trigger=2)
    for name, build in (
        ("issues", lambda d: M.document_issues(d, lang, rules=Q.RULES, style=Q.ISLAND_TEST)),
        ("stats", lambda d: L.file_stats(d)),
    ):
        out = str(tmp_path / name)
        scan.write_available(build(stream), out, name, str(tmp_path / f"{name}-progress")).awaitTermination()
        got, want = spark.read.parquet(out), build(whole)
        assert got.count() == want.count() > 0
        assert got.exceptAll(want).count() == 0
    # Nothing new has come, so nothing is written twice.
    scan.write_available(L.file_stats(stream), str(tmp_path / "stats"), "stats",
                         str(tmp_path / "stats-progress")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "stats")).count() == whole.count()


def test_progress_goes_to_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scan.progress_folder(spark, "x") == f"{root}/streams/x"


def test_every_default_rule_marker_and_word_is_hit(spark):
    folder = "/root/testdata/sf0.01"
    found = {name: entry.queries()[name](spark, folder)
             for name in ("default_rules", "default_simple_code", "default_markers", "default_keywords")}
    assert {tuple(r) for r in found["default_rules"].select("type", "description").distinct().collect()} == {
        (r.name, r.description) for r in V.ISSUE_RULES}
    for name, column, values in (("default_simple_code", "type", [r.name for r in V.SIMPLE_CODE_RULES]),
                                 ("default_markers", "marker", V.TASK_MARKERS),
                                 ("default_keywords", "keyword", V.KEYWORDS)):
        assert {r[0] for r in found[name].select(column).distinct().collect()} == set(values)


def test_skew_query_meets_both_kinds_of_blocks(spark):
    rows = entry.queries()["dup_locations_skew"](spark, "/root/testdata/sf0.01").collect()
    limit = len(rows) / 300
    assert any(r.n_locations > limit for r in rows) and any(r.n_locations <= limit for r in rows)


def test_page_texts_are_not_shuffled_for_links(spark):
    spark.conf.unset(SPREAD)
    try:
        plan = entry.queries()["link_graph"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(SPREAD, "8")
    above = [x for x in plan.splitlines() if "Exchange" in x]
    assert above and "html" not in "".join(above)
    for part in plan.split("Exchange")[1:]:
        below = part.splitlines()[1]
        assert "html#" not in below or "regexp_extract_all(html" in below
