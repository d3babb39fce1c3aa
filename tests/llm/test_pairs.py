"""Operators 3, 5, 6 and 10 against brute force, with nulls, empties, ties, repeats and extra columns."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusqa.llm import jaccard, linededup, neardup, sharding
from corpusqa.llm.shared import components, shared_folder

SCHEMA = "doc_id long, text string, key string, root string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3)


def closure(nodes, links):
    low = {n: n for n in nodes}

    def root(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        low[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(70)] + [(300, 300 + i) for i in range(50)] + [(7, 7)]
    want = closure({n for ab in links for n in ab}, links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    assert got == {n: want[n] for ab in links for n in ab if ab[0] != ab[1]}
    assert components(spark.createDataFrame([], "a binary, b binary"), "test").count() == 0
    assert shared_folder(spark)


def near_texts(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for base in range(30):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 8, 11, 15, 30, 60, 140, 400]))
        for _ in range(rng.choice([1, 2, 6])):
            own = list(words)
            for _ in range(rng.randrange(0, 1 + len(own) // 15)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    return rows + [(900, None), (901, ""), (902, " \n\t"), (None, rows[0][1]), (903, rows[5][1].upper()), (904, rows[5][1]), (904, rows[5][1])]


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("words,num,den", [(3, 90, 100), (5, 80, 100), (2, 60, 100), (1, 100, 100)])
def test_similar(spark, words, num, den):
    rows = near_texts()
    sets = [shingles(t, words) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None
             and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    roots = closure(range(len(rows)), links)
    low = defaultdict(list)
    for i, r in roots.items():
        low[r].append(rows[i][0])
    want = Counter((rows[i][0], len(sets[i]), None if rows[i][0] is None else min(low[r])) for i, r in roots.items())
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(frame(spark, rows), words, num, den).collect())
    assert got == want
    left = jaccard.one_of_each(frame(spark, rows), words, num, den)
    firsts = {d for d, n, c in want if d == c or d is None}
    assert left.columns == frame(spark, []).columns and Counter(r.doc_id for r in left.collect()) == Counter(d for d, _ in rows if d in firsts)


def test_similar_large_cluster_and_empty(spark, monkeypatch):
    assert jaccard.similar(frame(spark, [])).count() == 0
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)  # a cluster of many tiles
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(90):
        own = list(base)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(own)))
    sets = [shingles(t, 3) for _, t in rows]
    links = [(i, j) for i in range(90) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    assert {r.doc_id: r.component_id for r in jaccard.similar(frame(spark, rows), 3, 90, 100).collect()} == closure(range(90), links)


def test_signatures_lose_no_link():
    """Also with every part counted as small."""
    rng = np.random.default_rng(0)
    for small in (0, 2, 8):
        for trial in range(300):
            n = int(rng.integers(4, 120))
            a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
            most = int(len(a) * 0.25)
            out, new = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[out:], rng.integers(0, 1 << 62, new, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            signer = jaccard.Signer(80, 100, {})
            signer.small = dict.fromkeys(range(200), small)
            x, y = signer.of(a), signer.of(b)
            whole = lambda s: set((s[(s & np.uint64(1)) == 0] >> np.uint64(1)).tolist())
            every = lambda s: set((s >> np.uint64(1)).tolist())
            assert whole(x) & every(y) or every(x) & whole(y)


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(260):
        v = base[i % 40] + rng.normal(size=16) * rng.choice([0, 0.1, 0.25, 0.6])
        rows.append((i, v.astype("float32").tolist(), int(i % 40) % 3))
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] + [1.0] * 15, 1), (304, [], 1), (305, rows[0][1], None),
             (306, rows[0][1][:8], 0), (None, rows[0][1], 0), (307, rows[0][1], 0), (308, rows[0][1], 0)]
    sound = [i for i, (d, v, lab) in enumerate(rows) if d is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = []
    for i in sound:
        for j in sound:
            a, b = np.array(rows[i][1], "float32").astype(float), np.array(rows[j][1], "float32").astype(float)
            if j < i and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93:
                links.append((i, j))
    degree, roots = Counter(x for ab in links for x in ab), closure(range(len(rows)), links)
    want = Counter((d, degree[i], None if d is None else rows[roots[i]][0], d is not None and d == rows[roots[i]][0]) for i, (d, _, _) in enumerate(rows))
    df = spark.createDataFrame([(d, v, lab, 1) for d, v, lab in rows], "vec_id long, embedding array<float>, label int, links int")
    for block in (2048, 20):
        assert Counter(tuple(r) for r in neardup.near_duplicates(df, 0.93, block).collect()) == want
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_line_dedup(spark):
    rng = random.Random(9)
    shared = [f"A shared line number {i} that is certainly long enough é" for i in range(12)]
    rows = []
    for d in range(60):
        lines = [rng.choice(shared[: 1 + d % 12]) for _ in range(rng.randrange(0, 6))] + ["short", f"own line {d} that is also long enough to be counted here"]
        lines = [x.upper() if rng.random() < 0.1 else f"\t{x} " if rng.random() < 0.2 else x for x in lines]
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, shared[0]), (103, shared[0]), (103, shared[0]), (104, "É" * 40 + "\n" + shared[1] * 2000)]
    ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ascii_lower)
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n") if d is not None else ():
            if len(key(x)) >= 40:
                holders[key(x)].add(d)
    want = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or len(holders[key(x)]) < 5 or max(holders[key(x)]) == d]
        want[d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()] += 1
    for hot in (10_000, 3):  # all keys streamed; the usual ones by broadcast
        linededup.HOT = hot
        assert Counter(tuple(r) for r in linededup.digest(frame(spark, rows)).collect()) == want
    linededup.HOT = 10_000
    assert linededup.digest(frame(spark, [])).count() == 0
    out = linededup.apply_bitmaps(frame(spark, rows), linededup.keep_bitmaps(frame(spark, rows)))
    assert out.columns[:4] == ["doc_id", "text", "key", "root"] and out.where("doc_id = 100 and text is null").count() == 1


@pytest.mark.parametrize("limit", [200, 5_000, 10**9])
def test_sharding(spark, limit):
    rng = random.Random(limit)
    rows = [(d, "é" * rng.randrange(0, 120)) for d in range(400)] + [(900, "long" * 3000), (901, None), (None, "no id"), (None, "none")] + [(902, "repeated " * 5)] * 30
    got = sharding.shard(frame(spark, rows), limit).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    held = defaultdict(list)
    for r in got:
        assert r.n_bytes == len((r.text or "").encode()) and r.shard >> r.shard_depth == 1
        held[r.shard, r.shard_part].append(r)
    assert all(sum(r.n_bytes for r in s) <= limit or len(s) == 1 for s in held.values())
    names = sorted(f"{r:b}"[1:] for r, _ in held)  # no shard is below another
    assert not any(b.startswith(a) and a != b for a, b in zip(names, names[1:]))
    total = defaultdict(int)
    for r in got:
        total[r.shard] += r.n_bytes
    for s, p in held:  # a bucket that fits is not split
        if s > 1:
            assert sum(n for x, n in total.items() if f"{x:b}".startswith(f"{s >> 1:b}")) > limit
    assert sharding.shard(frame(spark, []), limit).count() == 0
