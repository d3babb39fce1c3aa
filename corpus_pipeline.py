"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again, and calls one operator of
``corpusqa.llm``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.llm import decontam, jaccard, linededup, packing, toxicity
from corpusqa.llm.queries import tokenizer
from corpusqa.llm.shared import kept, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the lexicon rejects go."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")), lexicon)
    return scored.where("predicted = 0").select("whole.*")


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: lines that repeat across documents stay in one of them. Every document stays."""
    lean = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    return lean.withColumn("n_chars", F.char_length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of documents that share 80 % of their runs of five words, one stays."""
    return jaccard.one_of_each(docs, words=5, num=80, den=100)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: sequences of power-of-two length, with their ids."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("line dedup", fresh_lines),
    ("n-gram Jaccard join", one_of_similar),
    ("benchmark decontamination", not_in_benchmark),
    ("packing", packed),
]

#: Fitted lexicons, walks and a tokenizer: no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs, f"stage-{k + 1}")
    return docs
