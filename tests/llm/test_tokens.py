"""Token ids through the memory of pieces against the tokenizer on whole texts; packing and files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from corpusqa.llm import packing, tokenfile
from corpusqa.llm.tokens import encoded, encoder

FILES = {"byte": public_tokenizers.path("byte_bpe_50k.json"), "word": public_tokenizers.path("word_bpe_49k.json")}
CHARS = "ab Z\n\t\r'.,!1é́ßΣσ漢  ​\x1c\x85<|>|  "
WHOLE = {}


def whole(kind, text):
    if kind not in WHOLE:
        WHOLE[kind] = Tokenizer.from_file(FILES[kind])
        WHOLE[kind].encode_special_tokens = True
    return WHOLE[kind].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["byte", "word"])
@settings(max_examples=400, deadline=None)
@given(text=st.text(st.sampled_from(CHARS), max_size=40) | st.text(max_size=20).filter(lambda s: s.encode("utf-8", "ignore").decode() == s))
def test_pieces_give_the_ids_of_the_whole(kind, text):
    got = np.frombuffer(encoder(FILES[kind], kind).ids(text), "<u4").tolist()
    assert got == whole(kind, text)


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_special_strings_and_null(kind):
    texts = ["a <|endoftext|> b <|startoftext|>", None, "", "  ", "\n"]
    for text, ids in zip(texts, encoded(texts, FILES[kind], kind, 7)):
        assert np.frombuffer(ids, "<u4").tolist() == (whole(kind, text) if text else []) + [7]


def test_full_memory_still_encodes():
    small = type(encoder(FILES["byte"], "byte"))(FILES["byte"], "byte", limit=1000)
    text = " ".join(f"word{i}" for i in range(50))
    assert np.frombuffer(small.ids(text), "<u4").tolist() == whole("byte", text) and 0 < len(small) < 10
    small.forget()
    assert not small and not small.held and np.frombuffer(small.ids(text), "<u4").tolist() == whole("byte", text)


def test_lengths():
    for n in range(1, 5000, 7):
        parts = packing.lengths(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts)
        assert parts == sorted(parts, reverse=True)
    with pytest.raises(ValueError):
        packing.lengths(3, 100)


ROWS = [(5, "A text of words, and more words."), (3, None), (4, ""), (None, "no id"), (5, "A text of words, and more words."),
        (9, " ".join(random.Random(1).choices(["alpha", "beta", "Gamma"], k=6000)))]


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, start string")


def test_pack(spark):
    got = [r.asDict() for r in packing.pack(docs(spark, ROWS), FILES["word"]).collect()]
    assert len({r["sequence_id"] for r in got}) == len(got)
    by = {}
    for r in sorted(got, key=lambda r: r["sequence_id"]):
        assert r["length"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == 1 << r["bucket"]
        by.setdefault(r["doc_id"], []).append(r)
    for doc, text in set(ROWS):
        ids = np.array((whole("word", text) if text else []) + [1], "<u4").tobytes()
        parts = by[doc]
        copies = ROWS.count((doc, text))
        assert b"".join(p["ids"] for p in parts) == ids * copies
        assert all(p["doc_tokens"] * 4 == len(ids) for p in parts)
    assert packing.pack(docs(spark, []), FILES["word"]).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_files_round_trip(spark, tmp_path, width):
    manifest = tokenfile.write(docs(spark, ROWS), str(tmp_path / "set"), FILES["byte"], parts=3, width=width)
    assert sum(r["n_docs"] for r in manifest.collect()) == len(ROWS)
    got = sorted((tuple(r) for r in tokenfile.read(spark, str(tmp_path / "set")).collect()), key=lambda r: r[1])
    at = 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (doc, text), row in zip(order, got, strict=True):
        ids = np.array((whole("byte", text) if text else []) + [2], "<u4")
        assert row == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    tokenfile.write(docs(spark, []), str(tmp_path / "none"), FILES["byte"])
    assert tokenfile.read(spark, str(tmp_path / "none")).count() == 0
