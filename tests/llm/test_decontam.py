"""Benchmark decontamination against brute force on all passages."""

import random

import numpy as np

from corpusqa.llm import decontam


def edits(a, b):
    """Least word edits between ``a`` and any passage of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def damaged(rng, words, n, vocabulary):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(vocabulary)
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, rng.choice(vocabulary))
    return words


def case(seed=3, items=30, docs=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    asked = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 60)))) for i in range(items)]
    texts = []
    for d in range(docs):
        words = rng.choices(vocabulary, k=rng.randrange(0, 200))
        if d % 3:
            item = rng.choice(asked)[1].split()
            at = rng.randrange(len(words) + 1)
            words[at:at] = damaged(rng, item, rng.randrange(0, int(0.25 * len(item)) + 1), vocabulary)
        text = " ".join(w.upper() + "," if rng.random() < 0.2 else w for w in words)
        texts.append(text)
    return asked, texts


def test_recall_and_precision():
    asked, texts = case()
    found = decontam.Matcher(asked).of(texts)
    want = got = close = 0
    for text, rows in zip(texts, found):
        words = [w.decode() for w in decontam.plain_words(text)]
        hits = {r["item_id"]: r for r in rows}
        for i, item in asked:
            a = item.split()
            least = edits(a, words)
            inside = least <= int(0.2 * len(a) + 1e-9)
            want += inside
            if i in hits:
                assert inside and hits[i]["edits"] >= least
                got += 1
                close += hits[i]["edits"] == least
                passage = words[hits[i]["start"] : hits[i]["end"]]
                assert edits(a, passage) == hits[i]["edits"] and abs(len(passage) - len(a)) <= hits[i]["edits"]
    assert want > 60 and got >= 0.97 * want and close == got


def recall(size, share, seed=5, trials=100, known=False):
    """Share of items of ``size`` words that are found with ``share`` edits, in and among words that no item has."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    others = vocabulary if known else [f"u{i}" for i in range(100_000)]
    asked = [(i, " ".join(rng.choices(vocabulary, k=size))) for i in range(20)]
    put, texts = [], []
    for _ in range(trials):
        i, item = rng.choice(asked)
        words = damaged(rng, item.split(), int(share * size), others)
        put.append(i)
        texts.append(" ".join(rng.choices(others, k=rng.randrange(1, 90)) + words + rng.choices(others, k=rng.randrange(90))))
    found = decontam.Matcher(asked).of(texts)
    return sum(i in [r["item_id"] for r in rows] for i, rows in zip(put, found)) / trials


def test_recall_among_words_of_no_item():
    assert all(recall(30, share) >= 0.95 for share in (0.0, 0.1, 0.2))


def test_recall_of_long_items():
    for size in (100, 250, 500):
        assert recall(size, 0.2, trials=60) >= 0.97 and recall(size, 0.2, trials=60, known=True) >= 0.97
        assert recall(size, 0.0, trials=60) == 1


def test_hits_do_not_depend_on_other_documents():
    asked, texts = case(seed=4, docs=60)
    matcher = decontam.Matcher(asked)
    assert matcher.of(texts) == [rows for text in texts for rows in matcher.of([text])]


def test_short_items_are_found_whole():
    found = decontam.Matcher([(1, "a b c d e"), (2, "k l m")]).of(["x a b X d e y", "a b c X e", "b c d e k l m", "a X c Y e", "k l X m"])
    assert [[(r["item_id"], r["edits"]) for r in rows] for rows in found] == [[(1, 1)], [(1, 1)], [(1, 1), (2, 0)], [], []]
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(12)]
    for most in (0.2, 0.5):
        asked = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 13)))) for i in range(40)]
        texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(3, 40))) for _ in range(60)]
        for text, rows in zip(texts, decontam.Matcher([x for x in asked if len(x[1].split()) < 10], most).of(texts)):
            want = {i for i, x in asked if len(x.split()) < 10 and edits(x.split(), text.split()) <= int(most * len(x.split()) + 1e-9)}
            assert {r["item_id"] for r in rows} == want


def test_aligned():
    item, text = np.array([1, 2, 3, 4], np.uint64), np.array([9, 1, 2, 7, 4, 9], np.uint64)
    assert decontam.aligned(item, text) == (1, 1, 5)
    assert decontam.aligned(item, np.zeros(0, np.uint64))[0] == 4


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, "say the quick brown fox jumps over it", "a"), (1, "say the quick brown fox jumps over it", "a"), (2, None, "b"), (3, "", "c"),
         (None, "THE QUICK, brown fox JUMPS!", "d"), (4, "quick the fox brown", "e")], "doc_id long, text string, hits string")
    items = spark.createDataFrame([(7, "the quick brown fox jumps"), (8, None), (9, "over it"), (None, "say the quick")], "item_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.item_id, r.edits) for r in decontam.hits(docs, items).collect())
    assert got == [(False, 1, 7, 0), (False, 1, 7, 0), (False, 1, 9, 0), (False, 1, 9, 0), (True, None, 7, 0)]  # two words are found too
    left = decontam.clean(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4]
    none = items.where("false")
    assert decontam.hits(docs, none).count() == 0 and decontam.clean(docs, none).count() == 6
    assert decontam.hits(docs.where("false"), items).count() == 0
    split = decontam.with_hits(docs, items, block=1)  # the items in several blocks
    assert sorted(len(r.hits) for r in split.select("hits").collect()) == [0, 0, 0, 1, 2, 2]
