"""Operators 11 to 13 against brute-force versions, on odd rows and on small shards, ranges and groups."""

import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusqa.llm import spelling, trie, warc

PAGES = "page_id bigint, url string, html string, digest string, kind int, keeper string"


def page_rows():
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcdeé漢 \n") for _ in range(40_000))
    copies = [(100 + i, f"http://a/{i}", "x" * 1000, "d", 1, "k") for i in range(40)]
    just_short = [(200 + i, "http://b", "y" * 999, None, None, None) for i in range(3)]
    odd = [(1, None, None, "a", 7, "b"), (2, "http://c/ d\r\nX-Page-ID: 9", "", "a", 7, "b"), (None, "http://n", "z" * 1200, "a", 7, "b"),
           (None, "http://n", "z" * 1200, "a", 7, "b"), (3, "u", "é" * 499 + "a", "", 0, ""), (4, "u", "é" * 500, "", 0, ""), (5, "u", "é" * 500, "", 0, ""),
           (5, "u", "é" * 500, "", 0, ""), (6, "v", long, "", 0, ""), (7, "v", long, "", 0, ""), (8, "w", "WARC/1.1\r\n\r\n" * 200, "", 0, "")]
    return copies + just_short + odd


def page_answer(rows, least=1000):
    groups, out = defaultdict(list), []
    for r in rows:
        groups[r[2] or ""].append(r[0])
    for html, ids in groups.items():
        raw = html.encode()
        ids.sort(key=lambda x: (x is None, -(x or 0)))
        for k, i in enumerate(ids):
            again = len(raw) >= least and k > 0
            out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return Counter(out)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_warc_round_trip(spark, tmp_path, monkeypatch, hot):
    """With every large payload decided in its task, and by broadcast; files of few bytes, ranges of 700."""
    monkeypatch.setattr(warc, "HOT", hot)
    pages = spark.createDataFrame(page_rows(), PAGES).repartition(5)
    folder = str(tmp_path / f"a-{hot}")
    manifest = warc.write(pages, folder, file_bytes=3000)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(page_rows())
    for split in (700, 64 << 20):
        records = warc.read(manifest, folder, split=split, with_payload=True).collect()
        assert not [r for r in records if r.problem]
        assert len(records) == len(page_rows()) + manifest.count()
        assert len({r.record_id for r in records}) == len(records)
        got = Counter(tuple(r) for r in warc.pages_of(warc.read(manifest, folder, split=split)).collect())
        assert got == page_answer(page_rows())
        whole = {r.record_id: r for r in records if r.record_type == "response"}
        for r in records:
            if r.record_type == "revisit":
                assert r.payload is None and whole[r.refers_to].payload_digest == r.payload_digest
            elif r.record_type == "response":
                assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
    listed = warc.archives(spark, folder)
    assert {r.file.rsplit("/", 1)[1]: r.bytes for r in listed.collect()} == {r.file: r.bytes for r in manifest.collect()}
    assert warc.read(listed, split=2000).count() == len(page_rows()) + manifest.count()


def test_warc_files_are_plain_gzip_members(spark, tmp_path):
    folder = str(tmp_path / "plain")
    manifest = warc.write(spark.createDataFrame(page_rows(), PAGES), folder, parts=1, date="2020-01-01T00:00:00Z")
    name = manifest.first().file
    text = gzip.open(f"{folder}/{name}").read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.count(b"\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n") == len(page_rows()) + 1


def archive(bodies, info="<urn:uuid:i>", named=True):
    out = [warc._record("warcinfo", info, "", "2020", [("Content-Type", "application/warc-fields")], b"a: b\r\n")]
    for k, body in enumerate(bodies):
        out.append(warc._record("resource", f"<urn:{k}>", info if named else "<urn:uuid:other>", "2020", [("Content-Type", "text/plain")], body))
    return out


def scan(raw, start=0, stop=None, block=97):
    return list(warc.records_of(lambda at: raw[at : at + block], start, len(raw) if stop is None else stop, True))


def test_warc_ranges_own_what_starts_inside():
    raw = b"".join(archive([b"one" * k for k in range(1, 60)]))
    whole = scan(raw)
    assert [r["payload"] for r in whole[1:]] == [b"one" * k for k in range(1, 60)]
    for width in (1, 2, 3, 50, 333):
        cut = [r for at in range(0, len(raw), width) for r in scan(raw, at, min(at + width, len(raw)))]
        assert [(r["at"], r["length"]) for r in cut] == [(r["at"], r["length"]) for r in whole]


def test_warc_archive_inside_a_payload_is_no_record():
    """Stored, not compressed, so that the magic of the inner members is found."""
    inner = b"".join(archive([b"inner"] * 5, info="<urn:uuid:inner>"))
    outer = archive([b"first", b"last"])
    block = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nWARC-Warcinfo-ID: <urn:uuid:i>\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n"
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = pack.compress(block) + pack.flush()
    raw = outer[0] + outer[1] + stored + outer[2]
    assert inner[:60] in raw
    for width in (7, 100, len(raw)):
        found = [r for at in range(0, len(raw), width) for r in scan(raw, at, min(at + width, len(raw)))]
        assert [r["record_id"] for r in found] == ["<urn:uuid:i>", "<urn:0>", "<urn:x>", "<urn:1>"]
        assert found[2]["payload"] == inner


def test_warc_damage_is_told_and_passed():
    rnd = random.Random(2)
    parts = archive([bytes(rnd.choices(range(33, 127), k=400)) for _ in range(3)])
    cut = parts[2][: len(parts[2]) - 12]
    found = scan(b"junk\x1f\x8b\x08" + parts[0] + parts[1] + cut + parts[3])
    assert [(r["record_id"], bool(r["problem"])) for r in found] == [("<urn:uuid:i>", False), ("<urn:0>", False), ("<urn:1>", True), ("<urn:2>", False)]
    wrong = warc._record("resource", "<urn:w>", "", "2020", [("WARC-Payload-Digest", "sha1:" + "A" * 32)], b"x")
    assert scan(wrong)[0]["problem"] and not scan(b"") and not scan(b"\x1f\x8b\x08" * 20)


def test_warc_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    folder = str(tmp_path / "none")
    manifest = warc.write(none, folder)
    assert manifest.count() == 0 and warc.read(manifest, folder).count() == 0


# Conversations

TURNS = "conv_id bigint, turn bigint, role string, text string, id string, words string, ends int"


def conversation_rows(seed, n=160, texts="ab"):
    rnd = random.Random(seed)
    out = []
    for c in rnd.sample(range(-30, 400), n):
        for t in range(rnd.choice([1, 1, 2, 3, 5, 9])):
            out.append((c, rnd.choice([t, t, None]) if t == 0 else t, rnd.choice(["u", "u", None, ""]),
                        rnd.choice([*texts, None, "two words", " \t x\x0b", "é"]), "i", "w", 1))
    out += [(500, t, "u", "a" if t % 3 else "long one", "i", "w", 0) for t in range(300)]
    out += [(501, t, "u", "a" if t % 3 else "long one", "i", "w", 0) for t in range(290)]
    return out + [(None, 0, "u", "no id", "i", "w", 1), (0, 5, "u", "same", "", "", 1), (0, 5, "u", "same", "", "", 1)]


def rebuilt_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0, name), (role, text)))
    own = {c: [x for _, x in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(abs(c) % 20 * (1 if c >= 0 else -1))
        out[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return out


def trie_by_hand(made):
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        own = (len(cs) - 1) * len([w for w in p[-1][1].replace("\x0b", " ").replace("\x0c", " ").split() if w]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += own
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if made[c] == p))).encode()).hexdigest()
    return Counter((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p], sha(p)) for p, cs in members.items())


@pytest.mark.parametrize("shard", [1, 7, 100_000])
def test_trie_is_the_one_by_hand(spark, shard):
    """Shards of one sequence, a few, and all."""
    rows = conversation_rows(shard)
    convs = trie.rebuilt(spark.createDataFrame(rows, TURNS).repartition(6))
    got = Counter(tuple(r) for r in trie.prefix_trie(convs, shard=shard).collect())
    assert got == trie_by_hand(rebuilt_by_hand(rows))


def test_trie_of_copies_and_of_nothing(spark):
    made = spark.range(3000).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("u").alias("role"),
                                    F.when(F.col("id") % 3 == 0, "same words here").otherwise(F.col("id").cast("string")).alias("text"))
    rows = [tuple(r) for r in made.collect()]
    got = Counter(tuple(r) for r in trie.conversation_trie(made).collect())
    assert got == trie_by_hand(rebuilt_by_hand(rows))
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_balanced_by_medians():
    assert sorted(trie.medians(100)) == list(range(100)) and list(trie.medians(0)) == []
    tree = trie.Tree()
    for k in trie.medians(1023):
        tree.insert([k], [1])

    def height(node):
        return 1 + max(height(tree.low[node]), height(tree.high[node])) if node else 0

    assert height(tree.same[0]) == 10


# Spelling

def words_by_hand(rows, least, often, slip):
    import regex

    counts = Counter()
    for doc, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= often}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1 :]


def spelled_by_hand(rows, least=6, often=5, slip=199, ratio=5):
    n = words_by_hand(rows, least, often, slip)
    out, form = {}, {}
    for w in n:
        close = [v for v in n if near(v, w)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = len(close)
    rows_ = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows_.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return Counter(rows_)


def texts(seed, letters, size, docs=60, words=60):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choices(letters, k=rnd.randint(5, size))) for _ in range(40)]
    pool += [w[:k] + w[k + 1 :] for w in pool for k in (0, len(w) // 2, len(w) - 1)]
    pool += [w[:k] + rnd.choice(letters) + w[k:] for w in pool[:60] for k in (0, len(w) // 2, len(w))]
    weights = [rnd.paretovariate(0.6) for _ in pool]
    return [(i, rnd.choice([" ", ", ", "1", "\n"]).join(rnd.choices(pool, weights, k=words))) for i in range(docs)]


SPELLED = "doc_id bigint, text string, word string, n long, key long"


@pytest.mark.parametrize("seed,letters,size,group", [(1, "aab", 9, 32), (3, "aB÷×À", 12, 2), (5, "abc", 40, 3)])
def test_variants_are_the_ones_by_hand(spark, monkeypatch, seed, letters, size, group):
    """Few letters, so that many words have chunks in common; small groups, so that they are cut to the end."""
    monkeypatch.setattr(spelling, "GROUP", group)
    rows = texts(seed, letters, size) + [(None, "nothing Nothing nothing nothing NOTHING"), (7, None), (8, ""), (9, "short a é " * 9)]
    long = 400 if seed == 5 else 30
    rows += [(90 + k, "z" * long + " " + "z" * (long - 1) + "y") for k in range(6)]
    rows += rows[:3]
    frame = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], SPELLED).repartition(5)
    got = Counter(tuple(r) for r in spelling.variants(frame, often=2, slip=5, ratio=2).collect())
    assert got == spelled_by_hand(rows, often=2, slip=5, ratio=2)


def test_every_near_pair_is_found_once(spark):
    """All words over two letters of length 6 to 8: each is near to many."""
    words = [format(i, f"0{n}b").replace("0", "a").replace("1", "b") for n in (6, 7, 8) for i in range(1 << n)]
    found = [tuple(r) for r in spelling.links(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if near(a, b)}
    assert len(found) == len(want) and {frozenset(p) for p in found} == want


def test_no_words(spark):
    none = spark.createDataFrame([], SPELLED)
    assert spelling.variants(none).count() == 0
    few = spark.createDataFrame([(1, "tiny words of no use", "", 1, 1)], SPELLED)
    assert spelling.variants(few).count() == 0
