"""Operators 1, 2 and 8: held-out accuracy, planted cases, edge rows; the pipeline on planted documents."""

import random

import numpy as np
import pytest

from corpusqa.llm import quality, queries, toxicity, urltree

SF = "/root/testdata/sf0.1"


def auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    order = np.sort(neg)
    return np.mean([(np.searchsorted(order, s, "left") + np.searchsorted(order, s, "right")) / 2 / len(neg) for s in pos])


# About one toxic document in ten of this folder has no word that the labels teach: it is too small for that.
@pytest.mark.parametrize("name,label,least", [("op1_toxicity", "toxic", 0.93), ("op2_quality", "quality", 0.97)])
def test_held_out(spark, name, label, least):
    found = queries.REGISTERED[name](spark, SF)
    rows = found.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("score", label, "predicted").collect()
    assert len(rows) > 500 and auc([(r[0], r[1]) for r in rows]) > least
    assert np.mean([r[1] == r[2] for r in rows]) > 0.97


def test_fold_and_exceptions():
    lexicon = toxicity.Lexicon({toxicity.fold("idiot"): 5.0}, {"vequ": 5.0}, [toxicity.fold("idiot proof")])
    found = lambda text: len(toxicity.hits(lexicon.automaton(), toxicity.spaced(text)[0]))
    for text in ("idiot", "An IDIOT!", "1d10t", "іԁіоt", "ｉｄｉｏｔ", "i\u200bdiot", "ïdiot", "vequeur"):
        assert found(text) == 1, text
    assert found("idiot-proof") == 0 and found("idiots") == 0 and found("idiot proof idiot") == 1 and found("") == 0


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "an idiot " * 20000, "c"), (None, "an idiot " * 20000, "c")], "doc_id long, text string, score string")
    lexicon = toxicity.Lexicon({"idiot": 5.0}, {}, slope=4.0)
    got = toxicity.score(docs, lexicon).collect()
    assert sorted(r.predicted for r in got) == [0, 0, 1, 1] and all(0 <= r.score <= 1 for r in got)
    labels = spark.createDataFrame([(2, None, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 4  # nothing to learn from
    model = quality.fit(docs, labels)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    assert toxicity.score(docs.where("false"), lexicon).count() == 0 == quality.score(docs.where("false"), model).count()


def test_boost_learns_a_pair():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality.boost(x[:2000], y[:2000], n_pairs=2)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95 and (2, 0) in [(i, j) for i, j, _ in model.pairs]


def judged(url, rules):
    """Host, path and rule, by the letter of the contract."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fit = [(h, p) for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1]


def test_urls(spark):
    rng = random.Random(3)
    urls = [None, "", "no scheme", "http://", "http://A.Example.NET/en/x?y#z", "x://net", "x://net/", "x://subnet/", "http://a.org/fr/?q=://b.net/", "ftp://ÀB.com\n/de/", "http://u:p@h.net:80/q"]
    hosts = ["www.example.net", "b.example.com", "c.example.org", "d.info"]
    urls += [f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(10**6)}.html" for _ in range(400)]
    urls += [f"https://mixed.example.com/ads/{i}" for i in range(40)] + ["https://www.example.net/" + "/".join("s" * 1 for _ in range(300))]
    pages = spark.createDataFrame([(i if i != 3 else None, u, "t") for i, u in enumerate(urls)], "page_id long, url string, template string")
    got = urltree.judge(pages, queries.URL_RULES).collect()
    assert len(got) == len(urls)
    verdicts = {h + p: v for h, p, v in queries.URL_RULES}
    for r in got:
        if r.page_id is not None:
            host, path, rule = judged(urls[r.page_id], queries.URL_RULES)
            assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
            assert r.verdict == verdicts[rule] if rule else r.verdict in ("block", "allow")
    assert urltree.judge(pages.where("false"), queries.URL_RULES).count() == 0


def test_templates_and_purity(spark):
    """A branch whose rows are mostly blocked is rejected, its unlabelled rows too; others stay."""
    rules = [("h.net", f"/bad/{i}", "block") for i in range(10, 60)] + [("h.net", "/good/1", "allow")]
    urls = [f"http://h.net/bad/{i}" for i in range(10, 70)] + [f"http://h.net/good/{i}" for i in range(60)] + [f"http://h.net/new/{i}" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: r for r in urltree.judge(pages, rules).collect()}
    assert got["http://h.net/bad/65"].verdict == "block" and got["http://h.net/bad/65"].rule is None and got["http://h.net/bad/65"].template == "h.net/bad/*"
    assert got["http://h.net/new/5"].verdict == "allow" and got["http://h.net/good/30"].verdict == "allow"


def test_pipeline(spark, tmp_path):
    """Planted documents through all stages, against what each stage should do."""
    import corpus_pipeline

    rng = random.Random(8)
    words = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    item, line = text(30), text(12)
    docs = {i: text(80) for i in range(40)}
    toxic = {i: f"{text(30)} stupid {text(30)}" for i in range(100, 140)}
    near = {200: text(100)}
    near[201], near[202] = near[200], near[200] + " tail"
    leak = {300: f"{text(40)} {item} {text(40)}"}
    lined = {i: f"{text(40)}\n{line}\n{text(40)}" for i in range(400, 406)}
    every = docs | toxic | near | leak | lined
    folder = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in every.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d in toxic)) for d in [*docs, *toxic]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == set(docs) | {200} | set(lined)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    for d in {r.doc_id for r in got}:
        kept = every[d] if d not in lined or d == 405 else "\n".join(x for x in every[d].split("\n") if x != line)
        ids = np.array(whole.encode(kept, add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert b"".join(r.ids for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)) == ids
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
