"""Operator 13: spelling variants, by asymmetric q-chunks.

Two words are near if one insertion, deletion or replacement makes them equal. Let ``x`` be the shorter one (or either, if they
are equally long) and ``y`` the other.

*Chunks against grams.* ``x`` is cut into two disjoint chunks, its halves. One edit leaves one of them whole, and ``y`` holds
it as a gram at the same place or one further. So ``x`` is indexed by its two chunks, ``y`` by its grams; of all its positional grams
only those within one place of a chunk can meet it, and only these are written. They join on text and place.

*Hot chunks.* Many words may have a chunk in common. What they have in common is settled, and the edit lies in the rest: in
a group of more than ``GROUP`` words the rest is cut into two chunks again, and so on. Each round halves the rest, so there are
logarithmic rounds over ever fewer words, and in the end groups are bounded by the alphabet: a group is never paired up
before it is small.

*Verification.* Candidates are compared exactly. Forms are chosen by aggregation; roots by doubling the steps, as each step
has at least ``ratio`` times the occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.llm.linededup import _LOWER, _UPPER, ascii_lower
from corpusqa.llm.shared import kept
from corpusqa.llm.trie import crc_sql
from corpusqa.operators.skew import attach

#: Words of a group that are paired up.
GROUP = 32


def word_counts(docs: DataFrame, least: int = 6, often: int = 5, slip: int = 199) -> DataFrame:
    """(word, n) of words of at least ``least`` letters that occur at least ``often`` times in ``docs`` (doc_id, text).

    Of a run whose crc32 (``<doc_id>:<run>``, ``h``) is a multiple of ``slip``, the letter ``h`` modulo its length is left out."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(
        ascii_lower(F.col("text").cast("string")), F.lit(f"[a-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    rows = runs.withColumn("h", h)
    size = F.char_length("run")
    at = (F.col("h") % size).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    words = rows.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def _rows(rows: DataFrame, spans: Column) -> DataFrame:
    """A row for each of ``spans`` (a, b), the stretch of the shorter word that may hold the edit: ``key`` stands for all the
    rest. ``more`` is 1 for the longer word, whose letters behind the edit are one further."""
    out = rows.withColumn("span", F.explode(spans)).select("word", "size", "more", F.col("span.a").alias("a"), F.col("span.b").alias("b"))
    before = F.substring("word", F.lit(1), F.col("a"))
    behind = F.substring("word", F.col("b") + F.col("more") + 1, F.col("size") + 1)
    return out.withColumn("key", F.xxhash64("size", "a", "b", before, behind))


def _span(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def links(words: DataFrame, least: int = 6) -> DataFrame:
    """(one, other): all near pairs of ``words`` (word, distinct), each once."""
    size = F.char_length("word")
    roles = words.select("word", size.alias("length")).withColumn("more", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "word", (F.col("length") - F.col("more")).alias("size"), "more").where(F.col("size") >= least)
    half, end = F.floor(F.col("size") / 2).cast("int"), F.col("size")
    todo = kept(_rows(roles, F.array(_span(half, end), _span(F.lit(0), half))), "chunks")
    found: list[DataFrame] = []
    while not todo.isEmpty():
        sums = todo.groupBy("key").agg(F.sum(1 - F.col("more")).alias("short"), F.sum("more").alias("long"), F.count("*").alias("rows"))
        pairs = kept(sums.where("short > 1 or short = 1 and long > 0"), "groups")  # the others hold no pair
        rows = kept(attach(todo, pairs.select("key", "rows"), "key", "rows", ["word", "more"]), "grouped")
        rest = F.col("b") - F.col("a")
        small = F.col("rows") <= GROUP
        # With one letter left, equally long words are near; with none, a longer word is near. Both groups end at the alphabet.
        shorter = rows.where(F.col("more") == 0)
        x, y = shorter.select("key", F.col("word").alias("one"), "rows", rest.alias("rest")), rows.select("key", F.col("word").alias("other"), "more")
        settled = (F.col("rows") <= GROUP) | ((F.col("more") == 0) & (F.col("rest") <= 1)) | ((F.col("more") == 1) & (F.col("rest") == 0))
        may = x.where((F.col("rows") <= GROUP) | (F.col("rest") <= 1)).join(y, "key").where(settled & ((F.col("more") == 1) | (F.col("one") < F.col("other"))))
        found.append(kept(may.where(F.levenshtein("one", "other", 1) == 1).select("one", "other").distinct(), "near"))
        a, b = F.col("a"), F.col("b")
        middle = a + F.floor(rest / 2).cast("int")
        spans = F.when(rest >= 2, F.array(_span(middle, b), _span(a, middle))).otherwise(F.array(_span(a, a), _span(b, b)))
        todo = kept(_rows(rows.where(~small & (rest >= 1)).select("word", "size", "more", "a", "b"), spans), "chunks")
    if not found:
        return words.select(F.col("word").alias("one"), F.col("word").alias("other")).where(F.lit(False))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for all words of ``forms`` (word, form): steps are doubled until none leads on."""
    at = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        over = at.select(F.col("word").alias("root"), F.col("root").alias("over"))
        if at.join(over, "root", "left_semi").isEmpty():
            return at
        at = kept(at.join(over, "root", "left").select("word", F.coalesce("over", "root").alias("root")), "roots")


def variants(docs: DataFrame, least: int = 6, often: int = 5, slip: int = 199, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text) that ``word_counts`` finds.

    ``n_near`` counts the words that differ by exactly one inserted, deleted or replaced code point. ``form`` is the most frequent of
    them (ties: the smallest) if it occurs at least ``ratio`` times as often, ``form_n`` its occurrences, else both are null.
    ``root`` is reached by following forms; the word itself where there is none.

    Null or empty text: no words. Null doc_id: an empty id in the crc. Repeated rows: each counts. Empty table: no
    rows. Other columns are not read. Words may be of any length.
    """
    words = kept(word_counts(docs, least, often, slip), "words")
    near = kept(links(words.select("word"), least), "links")
    both = near.unionAll(near.select(F.col("other").alias("one"), F.col("one").alias("other")))
    ranked = both.join(words.select(F.col("word").alias("other"), "n"), "other").groupBy(F.col("one").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), F.col("other").alias("form"))).alias("best"))
    found = words.join(ranked, "word", "left").withColumn("chosen", -F.col("best.minus") >= ratio * F.col("n"))
    formed = kept(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(F.col("chosen"), F.col("best.form")).alias("form"),
                               F.when(F.col("chosen"), -F.col("best.minus")).alias("form_n")), "forms")
    roots = _roots(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents
), counted AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS name, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, c, {crc_sql('name')} AS h FROM counted
), results AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), cuts AS (
  SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.rest
), best AS (
  SELECT a.word, any_value(a.n) AS n, count(b.word) AS n_near, first(b.word ORDER BY b.n DESC, b.word) AS top, max(b.n) AS top_n
  FROM words a LEFT JOIN near USING (word) LEFT JOIN words b ON b.word = near.other GROUP BY a.word
), formed AS (
  SELECT word, n, n_near, CASE WHEN top_n >= 5 * n THEN top END AS form, CASE WHEN top_n >= 5 * n THEN top_n END AS form_n FROM best
), walk AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk w ON w.word = f.word JOIN formed l ON l.word = w.at WHERE l.form IS NULL
"""
