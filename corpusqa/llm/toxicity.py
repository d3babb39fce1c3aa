"""Operator 1: toxicity by a weighted lexicon.

*Folding.* Case, accents, look-alike letters of other scripts, full-width forms and digit substitutions become
one spelling; everything but letters becomes a space. ``i``, ``l`` and ``1`` are one letter, as ``1`` stands
for both.

*Lexicon.* Learned from a bounded sample of labelled documents: word beginnings where a language bends its words,
and whole words, whose share of toxic documents is surely (Wilson bound) high. A second round looks only
for terms of toxic documents that the first left without a hit. The weight is the log odds ratio.

*Matching.* One Aho-Corasick automaton holds terms and exception phrases; a term inside an exception does
not count. The sum of weights is divided by a power of the document's words, chosen and calibrated (a
logistic curve) on the same sample.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.llm.shared import crc_of, kept, lean, small_batches

# Letters of other scripts that look like a Latin one, and substitutions by digits and signs.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g",
    "0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i",
}


class _Fold(dict):
    """For ``str.translate``: each character's folded form, worked out once."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)).lower():
            if unicodedata.combining(c) or unicodedata.category(c) == "Cf":
                continue
            c = LOOK_ALIKES.get(c, c)
            out += c if c.isalpha() else " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    return (text or "").translate(_FOLD)


@dataclass
class Lexicon:
    """``words`` and ``beginnings`` with their weights, ``exceptions`` (phrases of folded words), and the curve."""

    words: dict[str, float]
    beginnings: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    power: float = 0.5
    slope: float = 1.0
    offset: float = -1.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for terms, end in ((self.words, " "), (self.beginnings, "")):
            for term, weight in terms.items():
                found.add_word(f" {term}{end}", (len(term) + 1 + len(end), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found


def spaced(text: str | None) -> tuple[str, int]:
    """The folded words with one space around each, and their number."""
    words = fold(text).split()
    return f" {' '.join(words)} ", len(words)


def hits(automaton, line: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of every term outside exception phrases; a term within a longer one counts once."""
    if not len(automaton):
        return []
    found = [(end + 1 - n, end + 1, w) for end, (n, w) in automaton.iter(line)]
    spans = [(a, b) for a, b, w in found if w is None]
    terms = [(a, b, w) for a, b, w in found if w is not None and not any(x <= a and b <= y for x, y in spans)]
    best: dict[int, tuple[int, int, float]] = {}
    for t in terms:
        if t[0] not in best or t[1] > best[t[0]][1]:
            best[t[0]] = t
    return list(best.values())


def _curve(total: np.ndarray, words: np.ndarray, power: float, slope: float, offset: float) -> np.ndarray:
    x = slope * np.log1p(total / np.maximum(words, 1.0) ** power) + offset
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, label: str, hold: tuple[int, int], rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents that are not held out, the same ones each time.
    ``hold`` is (modulus, remainder) of the held-out ids. The list of ids that is broadcast has ``rows`` rows
    at most."""
    free = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_of("doc_id") % hold[0] != hold[1]))
    few = free.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "label")


def wilson(k, n, z: float = 3.0):
    """Lower bound of a share."""
    return F.when(n > 0, (k / n + z * z / (2 * n) - z * F.sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, hold: tuple[int, int] = (3, 1), rows: int = 20_000,
        exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learns a lexicon from ``labels`` (doc_id, toxic). ``rows`` bounds the labelled documents that are read."""
    some = kept(sample(docs, labels, "toxic", hold, rows).dropDuplicates(), "toxic-sample")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            words, marks = [], []
            for text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(fold(text).split())
                words += own
                marks += [mark] * len(own)
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "label": pa.array(marks, pa.int32())})

    totals = {r["label"]: r["count"] for r in some.groupBy("label").count().collect()}
    odds = lambda k, n: math.log((k + 0.5) / (totals.get(1, 0) + 1)) - math.log((n - k + 0.5) / (totals.get(0, 0) + 1))
    lexicon = Lexicon({}, {}, [fold(e).strip() for e in exceptions])
    k, n = F.col("k"), F.col("n")
    for z in (5.0, 3.0, 2.0):  # first what is beyond doubt, then what the documents that are still unexplained need
        open_rows = some.where((F.col("label") == 0) | (F.col("total") == 0)) if lexicon.words or lexicon.beginnings else some
        seen = kept(open_rows.select("text", "label").mapInArrow(words_of, "word string, label int").groupBy("word").agg(
            F.sum("label").alias("k"), F.count("*").alias("n")), "vocabulary")
        starts = seen.where(F.char_length("word") >= 4).select("word", "k", "n", F.explode(F.sequence(F.lit(4), F.least(F.lit(8), F.char_length("word")))).alias("i"))
        starts = starts.groupBy(F.substring("word", F.lit(1), F.col("i")).alias("start")).agg(
            F.sum("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("forms"))
        starts = starts.where((wilson(k, n, z) >= 0.8) & (F.col("forms") >= 8))
        found = sorted(starts.collect(), key=lambda r: (len(r["start"]), r["start"]))
        for r in found:
            if not any(r["start"].startswith(b) or b.startswith(r["start"]) for b in lexicon.beginnings):
                r = [x for x in found if x["start"].startswith(r["start"]) and x["k"] >= 0.95 * r["k"]][-1]  # the longest that holds as much
                lexicon.beginnings[r["start"]] = odds(r["k"], r["n"])
        for r in seen.where((k >= 3) & (wilson(k, n, z) >= 0.5)).collect():
            if not any(r["word"].startswith(b) for b in lexicon.beginnings):
                lexicon.words[r["word"]] = odds(r["k"], r["n"])
        some = kept(some.select("text", "label").mapInArrow(_sums(lexicon, True), "text string, label int, total double"), "toxic-sample")

    def phrases_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in small_batches(batches):
            found, marks = [], []
            for text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                line, own = spaced(text)[0], set()
                for a, b, _ in hits(automaton, line):
                    stop = line.find(" ", b - 1)
                    term, before, after = line[a + 1 : stop], line[:a].rpartition(" ")[2], line[stop + 1 :].partition(" ")[0]
                    own |= {f"{before} {term}"} if before else set()
                    own |= {f"{term} {after}"} if after else set()
                found += own
                marks += [mark] * len(own)
            yield pa.RecordBatch.from_pydict({"phrase": pa.array(found, pa.string()), "label": pa.array(marks, pa.int32())})

    clean = wilson(n - k, n) >= 0.5
    lexicon.exceptions += [r["phrase"] for r in some.select("text", "label").mapInArrow(phrases_of, "phrase string, label int").groupBy("phrase").agg(
        F.sum("label").alias("k"), F.count("*").alias("n")).where(clean).orderBy("phrase").collect()]
    # One short row for each of the sample's at most ``rows`` documents.
    facts = np.array([tuple(r) for r in some.select("text", "label").mapInArrow(_sums(lexicon), "total double, words long, label int").collect()], float).reshape(-1, 3)
    calibrate(lexicon, facts[:, 0], facts[:, 1], facts[:, 2])
    return lexicon


def _sums(lexicon: Lexicon, with_text: bool = False):
    """Sum of weights for each row (text, label): with the text, or with its number of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in small_batches(batches):
            rows = [(sum(h[2] for h in hits(automaton, line)), n) for line, n in map(spaced, batch.column(0).to_pylist())]
            total, words = pa.array([float(r[0]) for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64())
            if with_text:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), total], names=["text", "label", "total"])
            else:
                yield pa.RecordBatch.from_arrays([total, words, batch.column(1)], names=["total", "words", "label"])
    return run


def calibrate(lexicon: Lexicon, total: np.ndarray, words: np.ndarray, label: np.ndarray) -> None:
    """Power, slope and offset of least penalised log loss. With one class or no row, the share of toxic rows."""
    best = math.inf
    for power in (0.1, 0.25, 0.5, 1.0):
        x = np.log1p(total / np.maximum(words, 1.0) ** power)
        slope, offset = 0.0, 0.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - label) * x).sum() + 1e-3 * slope, (p - label).sum() + 1e-3 * offset])
            h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            slope, offset = slope - np.clip(step[0], -5, 5), offset - np.clip(step[1], -5, 5)
        p = np.clip(_curve(total, words, power, slope, offset), 1e-9, 1 - 1e-9)
        loss = -(label * np.log(p) + (1 - label) * np.log(1 - p)).sum()
        if loss < best:
            best, lexicon.power, lexicon.slope, lexicon.offset = loss, power, max(float(slope), 0.0), float(offset)


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1), ``predicted`` (int) and ``n_hits`` (long). Whole texts are read.

    Null or empty text: the score of a text without hits. Null doc_id, repeated rows: each row by itself.
    Empty table: no rows. Columns of ``docs`` with these names are replaced; others may have any names.
    """
    names = [n for n in docs.columns if n not in ("score", "predicted", "n_hits")]
    out = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), "text")

    def marks(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for series in texts:
            rows = []
            for text in series:
                line, n = spaced(text)
                found = hits(automaton, line)
                rows.append((sum(h[2] for h in found), n, len(found)))
            t = np.array(rows, float).reshape(-1, 3)
            p = _curve(t[:, 0], t[:, 1], lexicon.power, lexicon.slope, lexicon.offset)
            yield pd.DataFrame({"score": p, "n_hits": t[:, 2].astype("int64")})

    @F.pandas_udf("struct<score double, n_hits long>")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return lean(marks)(texts)

    found = out.withColumn("found", scored(F.col("text").cast("string")))
    return found.select("row.*", F.col("found.score").alias("score"), F.col("found.n_hits").alias("n_hits"),
                        (F.col("found.score") >= threshold).cast("int").alias("predicted"))
