"""Duplicate blocks against brute force, and under changes that must not matter."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusqa.operators import dups, metrics as M
from corpusqa.operators.skew import attach

LINES = [f"statement number {i} does something useful here" for i in range(6)] + [
    "# comment", "", "   ", "x", "// c", "1234567890 1234567890 1234567890"]


def texts(n, seed):
    rnd = random.Random(seed)
    few = LINES[:2] + LINES[6:10]
    out = ["\n".join(rnd.choice(few) for _ in range(rnd.randint(0, 20))) for _ in range(n)]
    block = "\n".join(LINES[:6])
    return out + [block, block + "\n" + block, block]


def brute(all_texts):
    found = defaultdict(list)
    for doc, text in enumerate(all_texts):
        clean = [(n, x.strip()) for n, x in enumerate(text.split("\n"), 1)]
        clean = [(n, x) for n, x in clean if x and not x.startswith(("#", "//"))]
        for i in range(len(clean) - 4):
            block = "\n".join(x for _, x in clean[i:i + 5])
            if len(block) >= 100 and re.search(r"[^\s\d\W]{3,}", block):
                found[block].append((doc, i + 1, clean[i][0]))
    return {b: v for b, v in found.items() if len(v) > 1}


def test_blocks_locations_smells(spark, docs):
    given = texts(120, 1)
    want = brute(given)
    assert len(want) > 5
    frame = docs(given)
    blocks = dups.duplicate_blocks(frame).collect()
    assert sorted((b.code_snippet, b.n_locations, b.tokens) for b in blocks) == sorted(
        (b[:300] + ("..." if len(b) > 300 else ""), len(v), len(re.findall(r"\w+", b)))
        for b, v in want.items())
    places = {(r.doc_id, r.clean_start, r.line, r.n_locations)
              for r in dups.duplicate_locations(frame).collect()}
    assert places == {(*p, len(v)) for v in want.values() for p in v}
    smells = sorted((r.doc_id, r.line) for r in dups.duplicate_smells(frame).collect())
    first = sorted((d, min(s for x, s, _ in v if x == d)) for v in want.values() for d in {x for x, _, _ in v})
    assert smells == first
    total = M.duplicate_totals(frame).first()
    assert (total.blocks, total.smells, total.smell_hours) == (len(want), len(first), 4.0 * len(first))


def test_sizes_at_the_limits(spark, docs):
    def block(n, chars=30):
        return "\n".join(("w" + str(i)).ljust(chars, "a") for i in range(n))

    short = "\n".join(["a" * 19] * 4 + ["a" * 19])          # 95 + 4 = 99 characters
    exact = "\n".join(["b" * 19] * 4 + ["b" * 20])          # 100 characters
    assert (len(short), len(exact)) == (99, 100)
    for text, expected in ((block(4), 0), (block(5), 1), (block(6), 2), (short, 0), (exact, 1),
                           ("\n".join(["12345 67890 12345 67890 _1"] * 5), 0)):
        assert dups.duplicate_keys(dups.windows(docs([text, text]))).count() == expected, text


def test_same_result_however_partitioned(spark, docs):
    frame = docs(texts(60, 2))
    one = sorted(map(tuple, dups.duplicate_blocks(frame.repartition(1)).collect()))
    many = sorted(map(tuple, dups.duplicate_blocks(frame.orderBy(F.rand(3)).repartition(13)).collect()))
    assert one == many


def test_more_documents_never_hide_a_block(spark, docs):
    given = texts(40, 4)
    few = {r.key for r in dups.duplicate_blocks(docs(given[:20])).collect()}
    all_ = {r.key for r in dups.duplicate_blocks(docs(given)).collect()}
    assert few <= all_


def test_hot_block_stays_whole(spark):
    block = "\n".join(LINES[:6])
    frame = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, block).otherwise(
            F.concat(F.lit("own "), F.col("id").cast("string"), F.lit(" text\n" * 6))).alias("text"))
    rows = dups.duplicate_locations(frame)
    assert rows.count() == 2 * 1000
    assert dups.duplicate_blocks(frame).agg(F.max("n_locations")).first()[0] == 1000


@pytest.mark.parametrize("parts", [1, 3, 20, 10_000])
def test_skew_join_is_an_inner_join(spark, parts):
    rows = spark.range(2000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"))
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("k") % 2 == 0)
    got = attach(rows, facts, "k", "n", ["id"], parts)
    want = rows.join(facts, "k").select("id", "k", "n")
    assert got.columns == want.columns
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_hot_rows_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(6000).select(
            F.col("id"), F.when(F.col("id") < 3000, F.lit(-1)).otherwise(F.col("id")).alias("k"))
        facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        got = attach(rows, facts, "k", "n", ["id"], parts=10)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 6000 and max(sizes) < 6000 / 4 * 1.3
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_digests_are_shuffled(spark, docs):
    keys = dups.duplicate_keys(dups.windows(docs(["a"])))
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    exchange = plan[:plan.index("inline(")]
    assert "text" not in exchange.split("Exchange hashpartitioning(key")[0]


def test_block_language_comments(spark, docs):
    body = "\n".join(LINES[:5])
    frame = docs([("JavaScript", "/* a\n" + body + "\n*/"), ("JavaScript", body),
                  ("Go", "/* a\n" + body + "\n*/")])
    got = {r.doc_id for r in dups.duplicate_locations(frame, lang=F.col("lang")).collect()}
    assert got == {1, 2}
