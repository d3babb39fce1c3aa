"""Operator 7: benchmark decontamination by CGK embedding and bit-sampling.

A benchmark item contaminates a document if a passage of it is within ``max_edits`` (a share of the item's
words) word edits of the item.

Long items are searched by pieces: of ``m`` pieces of an item, one at least has no more than an ``m``-th of its edits.

1. *Gate.* A passage within ``d`` edits of an item of ``w`` words keeps at least ``w - 2 - 3 d`` of its
   three-word runs. Window starts with fewer runs of any item ahead of them are left out; this loses nothing. Where
   that bound is below 1, or no number of walks reaches the target recall, and for items under ``_SHORT`` words,
   steps 2 and 3 are left out: a window is a candidate if it has as many of the item's own runs (of three, two or
   one words) as such a bound asks for, which loses nothing either.
2. *Embedding.* From each remaining start, and for each class of piece sizes, CGK random walks copy words and advance
   by one on a random bit of (step, word): few edits become few differing places. Words that no item has walk on
   their own hashes too.
3. *Sampling.* Each table hashes a few sampled places of a walk. Windows and pieces that agree in a table are
   candidates; walks repeat until edited passages of the class's size are found at the target recall, which is
   computed on random ones with the most edits that a piece may have (``_rounds``; tests measure whole items).
4. *Verification.* Candidates are aligned exactly: least edits between the item and any passage around the window.

Items come in blocks of bounded number, each one pass in the same scan. Documents never meet: there is no shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache, reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.llm.shared import WordHashes, lean, mix, plain_path, shared_folder, store

U64 = np.uint64
HITS = "array<struct<item_id:long,edits:int,start:int,end:int>>"
#: Words that are searched together.
_TOGETHER = 1_000_000
#: Most words of a piece of an item.
_PIECE = 32
#: Items of fewer words are found by their own runs, without walks.
_SHORT = 10
_SIGNS = b".,;:!?\"'()[]{}"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _SIGNS, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(_SIGNS))


def plain_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space or signs, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_PLAIN).split() if text else []


def _runs(words: np.ndarray, n: int = 3) -> np.ndarray:
    """A hash for each ``n`` words in a row."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = mix(words[: len(words) - n + 1])
    for k in range(1, n):
        out = mix(out + words[k : len(words) - n + 1 + k])
    return out


def _spread(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``x`` once for each index from its ``first`` to before its ``last``, and these indices."""
    n = last - first
    return np.repeat(x, n), np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def aligned(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the passage of ``text`` nearest to ``item``; the first end, then the shortest passage."""

    def last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        """Edits between all of ``a`` and each prefix of ``b`` (or its nearest suffix)."""
        steps = np.arange(len(a) + 1)
        column, out = steps.copy(), [len(a)]
        for j, word in enumerate(b, 1):
            new = np.concatenate([[0 if free else j], np.minimum(column[1:] + 1, column[:-1] + (a != word))])
            column = np.minimum.accumulate(new - steps) + steps
            out.append(column[-1])
        return np.array(out)

    ends = last_row(item, text, True)
    end = int(ends.argmin())
    back = last_row(item[::-1], text[:end][::-1][: 2 * len(item) + 1], False)
    return int(ends[end]), end - int(back.argmin()), end


@cache
def _rounds(size: int, edits: int, tables: int, places: int, recall: float, most: int = 256, trials: int = 1000) -> int:
    """Walks after which ``recall`` of random passages are found that are ``edits`` from a piece of ``size`` words,
    if only the walk from their first word counts; 0 if ``most`` do not do."""
    rng = np.random.default_rng(size * 1000 + edits)
    steps = max(places, int(1.5 * size))
    draw = lambda *shape: rng.integers(1, 1 << 63, shape, dtype=np.uint64) | U64(1)
    item = np.concatenate([draw(trials, size), np.zeros((trials, steps + 1), U64)], axis=1)
    text = draw(trials, size + edits + steps + 1)
    for t in range(trials):
        words = item[t, :size].tolist()
        for kind, new in zip(rng.integers(0, 3, edits).tolist(), draw(edits).tolist()):
            at = int(rng.integers(0, max(1, len(words))))
            words[at : at + (kind != 2)] = [] if kind == 1 else [new]
        text[t, : len(words)] = words
    row, found = np.arange(trials), np.zeros(trials, bool)
    for r in range(most):
        a, b, same = np.zeros(trials, np.int64), np.zeros(trials, np.int64), []
        for odd in draw(steps):
            x, y = item[row, a], text[row, b]
            same.append(x == y)
            a, b = a + ((x * odd) >> U64(63)).astype(np.int64), b + ((y * odd) >> U64(63)).astype(np.int64)
        same = np.stack(same)
        for _ in range(tables):
            found |= same[rng.choice(steps, places, replace=False)].all(axis=0)
        if found.mean() >= recall:
            return r + 1
    return 0


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str | None]], max_edits: float = 0.2, recall: float = 0.995, tables: int = 8, places: int = 3, seed: int = 7):
        self.max_edits = max_edits
        split = [(i, plain_words(t)) for i, t in items]
        #: Words of the items. For the gate, all others are 0: they equal no word of an item.
        self.known = {w: U64(xxhash.xxh3_64_intdigest(w) | 1) for _, ws in split for w in ws}
        self.others = WordHashes()
        words = [(i, self._numbers(ws)) for i, ws in split]
        self.items = [(i, w) for i, w in words if len(w)]
        self.edits = [int(max_edits * len(w) + 1e-9) for _, w in self.items]
        if not self.items:
            return
        self.runs = np.unique(np.concatenate([_runs(w) for _, w in self.items]))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.runs & U64((1 << 22) - 1)] = True
        self.pad = 2 * _PIECE + 4
        flat = np.concatenate([x for _, w in self.items for x in (w, np.zeros(self.pad, U64))])
        base = np.cumsum([0, *(len(w) + self.pad for _, w in self.items)])
        #: (item, first word, words, edits)
        #: Items that are found by their own runs: of how many words, and how many of them.
        self.direct = {k: self._bound(k) for k, (_, w) in enumerate(self.items) if len(w) < _SHORT}
        self.pieces = [p for k in range(len(self.items)) if k not in self.direct for p in self._pieces(k)]
        for p in self.pieces:
            if p[2] - 2 - 3 * p[3] < 1:
                self.direct[p[0]] = self._bound(p[0])
        self.pieces = [p for p in self.pieces if p[0] not in self.direct]
        self.owner, self.offset = (np.array([p[c] for p in self.pieces], np.int64) for c in (0, 1))
        rng = np.random.default_rng(seed)
        self.classes = []
        for members in self._sizes():
            lo, hi = (f(self.pieces[p][2] for p in members) for f in (min, max))
            edits = max(self.pieces[p][3] for p in members)
            need = min(self.pieces[p][2] - 2 - 3 * self.pieces[p][3] for p in members)
            steps, walks = max(places, int(1.5 * lo)), _rounds(lo, edits, tables, places, recall)
            if not walks:
                self.direct |= {self.pieces[p][0]: self._bound(self.pieces[p][0]) for p in members}
                continue
            odd = rng.integers(1, 1 << 63, (walks, steps), dtype=np.uint64) | U64(1)
            at = np.stack([np.stack([np.sort(rng.choice(steps, places, replace=False)) for _ in range(tables)]) for _ in range(walks)])
            signs = self._signs(flat, base[self.owner[members]] + self.offset[members], odd, at)  # (walks * tables, members)
            order = np.argsort(signs, axis=1)
            self.classes.append((hi + edits, need, odd, at, np.take_along_axis(signs, order, 1), np.array(members)[order]))

        #: For each run length: sorted runs of the items found by them, and whose they are.
        self.short = {}
        self.asked = np.array([self.direct.get(k, (0, 0))[1] for k in range(len(self.items))], np.int64)
        self.reach = np.array([len(w) + e for (_, w), e in zip(self.items, self.edits)], np.int64)
        for n in sorted({n for n, _ in self.direct.values()}):
            mine = [(np.unique(_runs(self.items[k][1], n)), k) for k, (m, _) in self.direct.items() if m == n]
            run, who = np.concatenate([x for x, _ in mine]), np.repeat([k for _, k in mine], [len(x) for x, _ in mine])
            order = np.argsort(run, kind="stable")
            self.short[n] = run[order], who[order]

    def _bound(self, k: int) -> tuple[int, int]:
        """The longest runs, of three words at most, of which a passage must keep any, and how many it keeps."""
        size, most = len(self.items[k][1]), self.edits[k]
        return next(((n, size - n + 1 - n * most) for n in (3, 2) if size - n + 1 - n * most > 0), (1, max(1, size - most)))

    def _near(self, words: np.ndarray) -> np.ndarray:
        """(item, place) of runs from which on there are as many of the item's own as its bound asks for."""
        out = [np.zeros((0, 2), np.int64)]
        for n, (runs, owner) in self.short.items():
            run = _runs(words, n)
            first, last = np.searchsorted(runs, run, "left"), np.searchsorted(runs, run, "right")
            x = np.flatnonzero(last > first)
            at, which = _spread(x, first[x], last[x])
            who = owner[which]
            order = np.lexsort((at, who))
            at, who = at[order], who[order]
            need, longest = self.asked[who], self.reach[who]
            end = np.arange(len(who)) + need - 1
            held = np.minimum(end, len(who) - 1)
            ok = (end < len(who)) & (who[held] == who) & (at[held] - at <= longest - n)
            out.append(np.stack([who[ok], at[ok]], axis=1))
        return np.concatenate(out)

    def _pieces(self, k: int) -> list[tuple[int, int, int, int]]:
        size = len(self.items[k][1])
        m = -(-size // _PIECE)
        cuts = [size * j // m for j in range(m + 1)]
        return [(k, a, b - a, self.edits[k] // m) for a, b in zip(cuts, cuts[1:])]

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.get, words, repeat(0)), dtype=np.uint64, count=len(words))

    def _filled(self, words: np.ndarray, split: list[bytes]) -> np.ndarray:
        """``words`` with hashes for those that no item has, so that walks go on over them."""
        at = np.flatnonzero(words == 0)
        words[at] = self.others.of([split[k] for k in at]) | U64(1)
        return words

    def _hits(self, words: np.ndarray) -> np.ndarray:
        """Places where a three-word run of an item begins."""
        at = np.flatnonzero(words)
        at = at[:-2][(at[2:] - at[:-2]) == 2] if len(at) > 2 else at[:0]  # three words of items in a row
        run = mix(mix(mix(words[at]) + words[at + 1]) + words[at + 2])
        may = self.bits[run & U64((1 << 22) - 1)]
        at, run = at[may], run[may]
        if not len(run):
            return at
        return at[self.runs[np.minimum(np.searchsorted(self.runs, run), len(self.runs) - 1)] == run]

    def _sizes(self) -> list[list[int]]:
        """Pieces of about the same size, smallest first."""
        out: list[list[int]] = []
        for p in sorted(range(len(self.pieces)), key=lambda p: self.pieces[p][2]):
            if out and self.pieces[p][2] <= 1.15 * self.pieces[out[-1][0]][2]:
                out[-1].append(p)
            else:
                out.append([p])
        return out

    def _signs(self, words: np.ndarray, starts: np.ndarray, odd: np.ndarray, at: np.ndarray) -> np.ndarray:
        """CGK walks from ``starts`` and the hashes of their sampled places, a row for each table."""
        out = []
        for r in range(len(odd)):
            wanted, seen, place = set(at[r].ravel().tolist()), {}, starts.copy()
            for j in range(int(at[r].max()) + 1):
                word = words[place]
                if j in wanted:
                    seen[j] = word * U64(2 * j + 3)
                place = place + ((word * odd[r, j]) >> U64(63)).astype(np.int64)
            out += [mix(reduce(np.add, (seen[int(j)] for j in table))) for table in at[r]]
        return np.stack(out)

    def of(self, texts: list[str | None]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        if not self.items:
            return out
        least = min((c[1] for c in self.classes), default=None)
        docs, own, gate, near, size = [], [], [], [], 0
        for k, text in enumerate(texts):
            split = plain_words(text)
            words = self._numbers(split)
            hits = self._hits(words)
            close = self._near(words)
            if len(close) or (least is not None and len(hits) >= least):
                docs.append(k)
                own.append(self._filled(words, split))
                gate.append(hits)
                near.append(close)
                size += len(words) + self.pad
                if size > _TOGETHER:
                    self._search(docs, own, gate, near, out)
                    docs, own, gate, near, size = [], [], [], [], 0
        if docs:
            self._search(docs, own, gate, near, out)
        return out

    def _search(self, docs: list[int], own: list[np.ndarray], gate: list[np.ndarray], near: list[np.ndarray], out: list[list[dict]]) -> None:
        """Adds to ``out`` at ``docs`` what is found in their words, where items' runs begin at ``gate``, and
        around ``near`` (item, place)."""
        gap = np.zeros(self.pad, U64)
        words = np.concatenate([x for w in own for x in (w, gap)])
        base = np.cumsum([0, *(len(w) + self.pad for w in own)])
        hit = np.zeros(len(words) + 1, np.int64)
        hit[np.concatenate([at + b for at, b in zip(gate, base)]) + 1] = 1
        before = np.cumsum(hit)
        codes = [np.zeros(0, np.int64)]
        for window, need, odd, at, signs, members in self.classes:
            ends = np.minimum(np.arange(len(before)) + max(1, window - 2), len(before) - 1)
            starts = np.flatnonzero(before[ends] - before >= need)
            starts = starts[starts < len(words)]
            starts = starts[words[starts] != 0]
            for k in range(0, len(starts), 1 << 14):
                some, pairs = starts[k : k + (1 << 14)], []
                for mine, theirs, who in zip(self._signs(words, some, odd, at), signs, members):
                    first, last = np.searchsorted(theirs, mine, "left"), np.searchsorted(theirs, mine, "right")
                    x = np.flatnonzero(last > first)
                    own_x, which = _spread(x, first[x], last[x])
                    pairs.append(who[which] * len(words) + some[own_x])
                codes.append(np.unique(np.concatenate(pairs)))
        piece, start = np.divmod(np.concatenate(codes), len(words))
        doc, member, start = np.searchsorted(base, start, "right") - 1, self.owner[piece], start - self.offset[piece]
        places = [np.stack([doc, member, start], axis=1)]
        places += [np.column_stack([np.full(len(x), d), x[:, 0], x[:, 1] + base[d]]) for d, x in enumerate(near) if len(x)]
        regions: dict[tuple[int, int], list[list[int]]] = {}
        for d, m, at in np.unique(np.concatenate(places), axis=0).tolist():
            spans = regions.setdefault((d, m), [])
            if spans and at - spans[-1][1] <= len(self.items[m][1]):
                spans[-1][1] = at
            else:
                spans.append([at, at])
        for (doc, member), spans in regions.items():
            item, most = self.items[member][1], self.edits[member]
            best = None
            for low, high in spans:
                a, b = max(base[doc], low - len(item) - most), min(base[doc] + len(own[doc]), high + len(item) + 2 * most + _PIECE)
                if np.isin(_runs(words[a:b]), _runs(item)).sum() < len(item) - 2 - 3 * most:
                    continue  # the gate's bound, for this item's own runs
                edits, start, end = aligned(item, words[a:b])
                if best is None or edits < best[0]:
                    best = (edits, start + a - base[doc], end + a - base[doc])
            if best and best[0] <= most:
                out[docs[doc]].append({"item_id": self.items[member][0], "edits": int(best[0]), "start": int(best[1]), "end": int(best[2])})


def with_hits(docs: DataFrame, items: DataFrame, max_edits: float = 0.2, block: int = 20_000) -> DataFrame:
    """``docs`` with ``hits``: for each item found, its id, the edits and the words [start, end) of the nearest passage.

    ``items`` has (item_id, text). It is written into the shared folder in blocks of ``block`` items (or 300 letters for each), which the
    tasks read. Signs read as white space, A-Z are lower-cased. Whole texts are read.

    Items of no words (null and empty) or without an id: never found. Null or empty text: no hits. Null doc_id, repeated rows: each row by itself. Items that repeat an id are found each. Empty tables: no
    hits, no rows. A column ``hits`` of ``docs`` is replaced.
    """
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    n, letters = asked.agg(F.count("*"), F.sum(F.length("text"))).first()
    blocks = max(1, -(-n // block), -(-(letters or 0) // (300 * block)))
    folder = f"{shared_folder(docs.sparkSession)}/corpusqa-items-{uuid.uuid4().hex}"
    asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(folder)
    found = [_finder(f"{plain_path(folder)}/block={k}", max_edits)(F.col("text").cast("string")) for k in range(blocks)]
    return docs.drop("hits").withColumn("hits", found[0] if len(found) == 1 else F.concat(*found))


def _items(folder: str) -> list[tuple[int, str | None]]:
    """A block of items, read by the task; a block without items has no folder."""
    disk, path = store(folder)
    out = []
    for info in disk.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if info.base_name.endswith(".parquet"):
            with disk.open_input_file(info.path) as file:
                rows = pq.read_table(file, columns=["item_id", "text"])
            out += zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())
    return sorted(out, key=lambda r: (r[0], r[1] or ""))


def _finder(folder: str, max_edits: float):
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(_items(folder), max_edits)
        for series in texts:
            yield pd.Series(matcher.of(series.tolist()), dtype=object)

    @F.pandas_udf(HITS)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return lean(found)(texts)

    return find


def hits(docs: DataFrame, items: DataFrame, max_edits: float = 0.2) -> DataFrame:
    """doc_id, item_id, edits, start, end: a row for each document and item found in it."""
    return with_hits(docs.select("doc_id", "text"), items, max_edits).select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def clean(docs: DataFrame, items: DataFrame, max_edits: float = 0.2) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns, whatever they are called."""
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return with_hits(rows, items, max_edits).where(F.size("hits") == 0).select("row.*")
