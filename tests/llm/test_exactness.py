"""Brute-force versions of operators 1, 2 and 8, extreme rows of 6 and 7, and columns with clashing names."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusqa.llm import decontam, jaccard, linededup, neardup, packing, quality, sharding, shared, toxicity, urltree


# Operator 1

def score_by_hand(text, lexicon):
    """Word by word, without an automaton."""
    words = toxicity.fold(text).split()
    covered = [False] * len(words)
    for phrase in lexicon.exceptions:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                covered[i : i + len(p)] = [True] * len(p)
    total = 0.0
    for word, out in zip(words, covered):
        found = [(len(b) + 1, w) for b, w in lexicon.beginnings.items() if word.startswith(b)]
        found += [(len(word) + 2, lexicon.words[word])] if word in lexicon.words else []
        if found and not out:
            total += max(found)[1]
    x = lexicon.slope * np.log1p(total / max(len(words), 1) ** lexicon.power) + lexicon.offset
    return 1 / (1 + np.exp(-x))


def test_toxicity_against_brute_force(spark):
    rnd = random.Random(4)
    words = ["alpha", "alphabet", "beta", "bet", "gamma", "1d10t", "idiot", "Δelta", "be", "proof", "x"]
    fold = lambda s: toxicity.fold(s).strip()
    lexicon = toxicity.Lexicon({fold("idiot"): 3.0, fold("beta"): 1.5, fold("alphabet"): 0.5}, {fold("alph"): 2.0, fold("gam"): 0.7},
                               [fold("idiot proof"), fold("x beta"), fold("alpha")], power=0.25, slope=1.3, offset=-0.8)
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in toxicity.score(docs, lexicon).collect():
        assert r.score == pytest.approx(score_by_hand(texts[r.doc_id], lexicon), abs=1e-12), texts[r.doc_id]


def test_the_length_always_counts():
    rng = np.random.default_rng(1)
    total, words = rng.uniform(0, 9, 400), rng.integers(1, 2000, 400).astype(float)
    lexicon = toxicity.Lexicon({}, {})
    toxicity.calibrate(lexicon, total, words, (total > 4).astype(float))  # labels that do not depend on the length
    assert lexicon.power > 0


# Operator 2

def test_quality_against_brute_force(spark):
    rnd = random.Random(5)
    signs = "ab cdE.\n\t1é漢!?- "
    texts = [None, "", " ", *("".join(rnd.choices(signs, k=rnd.randint(1, 300))) for _ in range(200))]
    x = np.array([quality.features(t) for t in texts])
    model = quality.boost(x, np.array([len(t or "") % 2 for t in texts], float), bins=8, coarse=4, rounds=5, pair_rounds=5, n_pairs=3)

    def by_hand(row):
        """Bin by bin: how many cuts are not above the value."""
        place = lambda cuts, v: sum(bool(c <= v) for c in cuts)
        z = model.base + sum(t[place(e, v)] for t, e, v in zip(model.tables, model.edges, row))
        z += sum(t[place(model.coarse[i], row[i]), place(model.coarse[j], row[j])] for i, j, t in model.pairs)
        return 1 / (1 + np.exp(-z))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in quality.score(docs, model).collect():
        assert r.score == pytest.approx(by_hand(x[r.doc_id]), abs=1e-12)


# Operator 8

def templates_by_hand(paths, min_rows, min_share):
    """Grown segment by segment, branch by branch."""
    out = {}

    def half_up(v):
        return int(v + 0.5)

    def grow(branch, rows):
        if sum(n for _, _, n, _, _ in rows) < min_rows:
            out.update({key: branch + "/*" * len(rest) for key, rest, *_ in rows})
            return
        out.update({key: branch for key, rest, *_ in rows if not rest})
        inner, parts = [r for r in rows if r[1]], defaultdict(lambda: [0, 0, 0])
        for _, rest, *facts in inner:
            parts[rest[0]] = [a + b for a, b in zip(parts[rest[0]], facts)]
        n, b, a = (sum(p[k] for p in parts.values()) for k in range(3))
        usual = {p: (half_up(4 * (f[1] + b / n) / (f[0] + 1)), half_up(4 * (f[2] + a / n) / (f[0] + 1)))
                 for p, f in parts.items() if f[0] >= min_rows and f[0] >= min_share * n}
        alike = defaultdict(list)
        for p, quarters in usual.items():
            alike[quarters].append(p)
        escaped = lambda p: p.replace("~", "~0").replace("*", "~1")
        token = {p: escaped(p) if len(alike[q]) == 1 else "*%d%d" % q for p, q in usual.items()}
        grouped = defaultdict(list)
        for key, rest, *facts in inner:
            grouped[token.get(rest[0], "*")].append((key, rest[1:], *facts))
        for t, some in grouped.items():
            grow(f"{branch}/{t}", some)

    hosts = defaultdict(list)
    for host, path, *facts in paths:
        hosts[host].append(((host, path), [p for p in path.split("/") if p], *facts))
    for host, rows in hosts.items():
        grow(host, rows)
    return out


@pytest.mark.parametrize("seed,depth,share", [(1, 3, 0.01), (2, 6, 0.2)])
def test_url_tree_against_brute_force(spark, seed, depth, share):
    rnd = random.Random(seed)
    parts = ["a", "a", "b", "*", "**", "*12", "~1", "~", "c d"] + [str(i) for i in range(12)]
    paths = {}
    for _ in range(500):
        path = "".join("/" + rnd.choice(parts) for _ in range(rnd.randint(0, depth))) + rnd.choice(["", "/"])
        n = rnd.choice([1, 1, 2, 6])
        blocked = rnd.randint(0, n) if "b" in path else 0
        paths[rnd.choice(["h.net", "k.org"]), path] = (n, blocked, rnd.randint(0, n - blocked))
    rows = [(*k, *v) for k, v in paths.items()]
    frame = spark.createDataFrame(rows, "host string, path string, n long, blocked long, allowed long").repartition(4)
    got = {(r.host, r.path): r.template for r in urltree.templates(frame, min_rows=5, min_share=share).collect()}
    assert got == templates_by_hand(rows, 5, share)
    # The verdicts of whole pages, of which some are labelled by rules.
    urls = [f"http://{h}{p}" for (h, p), v in paths.items() for _ in range(v[0])]
    rules = [("h.net", "/b", "block"), ("k.org", "/a/b", "block"), ("net", "/a", "allow"), ("h.net", "/*", "block")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    judged = urltree.judge(pages, rules, min_share=share).collect()
    told = {r.page_id: r for r in judged}
    facts = defaultdict(lambda: [0, 0, 0])
    for r in judged:
        facts[r.host, r.path][0] += 1
        facts[r.host, r.path][1 if r.rule and r.verdict == "block" else 2] += r.rule is not None
    made = templates_by_hand([(*k, *v) for k, v in facts.items()], 5, share)
    labelled = defaultdict(lambda: [0, 0])
    for k, (_, b, a) in facts.items():
        labelled[made[k]][0] += b
        labelled[made[k]][1] += b + a
    prior = min(0.5, sum(b for b, _ in labelled.values()) / (sum(n for _, n in labelled.values()) or 1))
    for r in told.values():
        if r.rule is None:
            b, n = labelled[made[r.host, r.path]]
            assert r.verdict == ("block" if (b + 4 * prior) / (n + 4) >= 0.8 else "allow")


def test_a_literal_star_is_no_wildcard(spark):
    urls = [f"http://h.net/x/{i}" for i in range(300)] + ["http://h.net/x/*"] * 20
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = urltree.judge(pages, [("h.net", "/x/*", "block")]).collect()
    assert {r.verdict for r in got if r.page_id < 300} == {"allow"} and {r.verdict for r in got if r.page_id >= 300} == {"block"}


def test_rounds_follow_splits(spark, monkeypatch):
    written = []
    monkeypatch.setattr(urltree, "kept", lambda df, tag: written.append(tag) or shared.kept(df, tag))

    def rounds(levels):
        written.clear()
        path = "/".join(f"s{i}" for i in range(levels))
        rows = [("h", f"/{path}", 5, 0, 0), ("h", f"/{path}/a", 6, 0, 0), ("h", "/t", 9, 0, 0)]
        got = urltree.templates(spark.createDataFrame(rows, "host string, path string, n long, blocked long, allowed long")).collect()
        assert {(r.host, r.path): r.template for r in got} == templates_by_hand(rows, 5, 0.01)
        return len(written)

    assert rounds(300) == rounds(10)


# Operators 6 and 7

def test_vectors_of_any_magnitude(spark):
    rows = [(k, [s, s * c], lab) for lab, s in enumerate((1e200, 1e-200, 5e-324, 1.7e308, 1e-310, 3.0)) for k, c in ((10 * lab, 1.0), (10 * lab + 1, 1.0))]
    rows += [(100, [1e200, 1.01e200], 0), (101, [1e-200, 1.01e-200], 1), (102, [1e200, -1e200], 0), (103, [1e200, 1e-200], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(frame).collect()}
    assert got[0] == got[1] == got[100] == 2 and got[10] == got[11] == got[101] == 2
    assert all(got[10 * k] == got[10 * k + 1] == 1 for k in (2, 3, 4, 5)) and got[102] == got[103] == 0


def test_items_of_one_and_two_words(spark):
    items = spark.createDataFrame([(1, "Alpha"), (2, "two words"), (3, ""), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha, y"), (2, "two other words"), (3, "so two WORDS."), (4, "alphabet"), (5, None)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.start, r.end) for r in decontam.hits(docs, items).collect()} == {(1, 1, 1, 2), (3, 2, 1, 3)}
    assert {r.doc_id for r in decontam.clean(docs, items).collect()} == {2, 4, 5}


def test_blocks_of_items_are_read_by_tasks(spark):
    texts = [f"item number {i} has these {i * 7} words and some more of its own {i * i}" for i in range(60)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts)], "doc_id long, text string")
    for block in (7, 20_000):
        got = decontam.with_hits(docs, items, max_edits=0.0, block=block).collect()
        assert all([h.item_id for h in r.hits] == [r.doc_id] for r in got)


# Names

def test_columns_with_clashing_names(spark):
    line = "a line that is long enough to be dropped where it repeats"
    rows = [(i, f"own {i}\n{line}") for i in range(6)] + [(None, "no id"), (9, None)]
    extra = ["hits", "_key", "_doc", "_body", "_n", "_dropped", "_lost", "lost", "row", "id", "salt", "doc", "key", "body", "dropped", "_toxic", "found",
             "_address", "_in", "_cell0", "_depth0", "address", "bytes", "block", "n", "_row", "whole", "label"]
    docs = spark.createDataFrame([(*r, *(f"{c} {r[0]}" for c in extra)) for r in rows], ["doc_id", "text", *extra])
    want = {r.doc_id: tuple(r[c] for c in extra) for r in docs.collect()}
    items = spark.createDataFrame([(1, "own 3")], "item_id long, text string")

    def same(df, n):
        got = df.collect()
        assert len(got) == n and all(tuple(r[c] for c in extra) == want[r.doc_id] for r in got)
        assert df.columns[: 2 + len(extra)] == docs.columns
        return got

    same(decontam.clean(docs, items), 7)
    lean = same(linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs)), 8)
    assert sorted(r._n_dropped for r in lean) == [0, 0, 0, 1, 1, 1, 1, 1]
    same(jaccard.one_of_each(docs.unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(5)))), 9)
    same(toxicity.score(docs, toxicity.Lexicon({}, {})), 8)
    same(sharding.shard(docs, 100), 8)
    same(sharding.shard(docs, 1), 8)
    assert packing.pack(docs, __import__("public_tokenizers").path("word_bpe_49k.json")).select("doc_id").distinct().count() == 8


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    """On a cluster no temporary folder stands in for spark.checkpoint.dir."""
    from corpusqa.sources import tables

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = type("X", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        tables.scratch_folder(Session)
