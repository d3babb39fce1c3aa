"""Operator 5: exact set-similarity join of documents on word shingles.

Two sets link when their Jaccard similarity is at least ``num / den``. Then a pair whose smaller size is in the
band ``[lo, hi]`` (``hi = lo * den // num``) differs in at most ``H = hi * (den - num) // num`` elements. Hashing
cuts the universe into ``H + 1`` segments, so by the pigeonhole principle the two sets are equal in at least one
of them. A set is segmented for its own band and for the band below, as the larger partner there.

*Segment subsets.* The part of a set in a segment gives one signature; equal signatures are candidates.

*One-deletion neighbourhoods.* A part with few elements selects badly: many unrelated sets have it. Such a part
counts only together with the next segment, in which the two sets may differ by one element: the
signature is of both parts, and of both with one element of the next one left out. This loses nothing: let Z be the
segments without a difference, all of them small. If each segment after one of Z had two differences or
more, there would be ``|Z|`` such segments outside Z and more than ``H`` differences in all.

*Allocation by cost.* How small is small is chosen for each band from the number of documents in it: more
signatures against more expected candidates.

Equal sets are one node from the start, so copies are never compared. The sets of a signature are sifted within a
task by parity sketches: the bits in which two sketches differ are at most the elements in which the sets do,
so no link is lost. What passes is returned as a spanning forest, and the forests' components are clusters that hold
every link. Each cluster is verified exactly, in tiles of bounded size, again with a forest as the result.
Pairs are never written. (The sets of a signature that has more than ``SIFTED`` of them are chained as they are.)
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.llm.shared import WordHashes, ascii_words, components, forest, kept, lean, mix, shingle_set, small_batches

U64 = np.uint64
#: Sets and elements in a block; a tile has at most two blocks.
BLOCK_SETS, BLOCK_ELEMENTS = 1024, 1_000_000
_CELLS = 1 << 23
#: Sets of one signature that are sifted together.
SIFTED = 2048


def bands(longest: int, num: int, den: int) -> list[tuple[int, int]]:
    """Size bands up to ``longest``: a partner of similarity ``num / den`` is in the same or the next one."""
    out, lo = [], 1
    while lo <= longest:
        hi = lo * den // num
        out.append((lo, hi))
        lo = hi + 1
    return out


def smallness(documents: float, mean: float, overlap: float = 0.02, price: float = 0.05) -> int:
    """The part size up to which a part counts only with its neighbour: least expected signatures and candidates for
    one set, among ``documents`` sets whose parts have ``mean`` elements and share each with ``overlap``. A candidate
    costs ``price`` signatures, as candidates are sifted by sketch and never written as pairs."""
    share = [math.exp(-mean) * mean**c / math.factorial(c) for c in range(24)]
    documents *= price
    near = math.exp(-mean * (1 - overlap)) * (1 + mean)  # the next parts differ by one at most

    def cost(most: int) -> float:
        alone = sum(p * (1 + documents * overlap**c) for c, p in enumerate(share) if c > most)
        paired = sum(p * (1 + mean + documents * overlap**c * near) for c, p in enumerate(share) if c <= most)
        return alone + paired

    return min(range(0, 9), key=cost)


class Signer:
    """Signatures of sets. ``small`` gives the part size by band."""

    def __init__(self, num: int, den: int, crowd: dict[int, int]):
        self.num, self.den, self.crowd = num, den, crowd
        self.bands: list[tuple[int, int]] = []
        self.highs: list[int] = []
        self.small: dict[int, int] = {}

    def band(self, n: int) -> int:
        if not self.highs or self.highs[-1] < n:
            self.bands = bands(2 * n, self.num, self.den)
            self.highs = [hi for _, hi in self.bands]
        return bisect_left(self.highs, n)

    def of(self, elements: np.ndarray) -> np.ndarray:
        """Signatures of one set of distinct 64-bit elements. The lowest bit is 1 where an element was left out."""
        n = len(elements)
        own = self.band(n)
        return np.concatenate([self._level(elements, b) for b in (own, own - 1) if b >= 0])

    def _level(self, elements: np.ndarray, b: int) -> np.ndarray:
        lo, hi = self.bands[b]
        m = hi * (self.den - self.num) // self.num + 1
        if m < 2:  # only equal sets link
            return np.zeros(0, U64)
        if b not in self.small:
            self.small[b] = smallness(self.crowd.get(coarse_band(hi, self.num, self.den), 0), (lo + hi) / 2 / m)
        at = mix(elements + U64(0x51ED270B * (b + 1)))
        slot = (((at >> U64(32)) * U64(m)) >> U64(32)).astype(np.int64)
        value = mix(at ^ U64(0xA0761D6478BD642F))
        total, count = np.zeros(m, U64), np.bincount(slot, minlength=m)
        np.add.at(total, slot, value)
        own = mix(total + mix(np.arange(m, dtype=U64) + U64((b + 1) << 40)))
        few = count <= self.small[b]
        out = [own[~few] & ~U64(1)]
        if few.any():
            i = np.flatnonzero(few)
            out.append(mix(own[i] + total[(i + 1) % m]) & ~U64(1))
            left = few[slot - 1]  # the element's segment follows a small part; -1 is the last one
            out.append(mix(own[slot[left] - 1] + total[slot[left]] - value[left]) | U64(1))
        return np.concatenate(out)


def coarse_band(n: int, num: int, den: int) -> int:
    return int(math.log(max(n, 1)) / math.log(den / num))


def _key(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def sketch(elements: np.ndarray, num: int, den: int) -> bytes:
    """Parity of the number of elements in each cell. Cells are a power of two, at least four for each
    difference that a link may have; half the cells are the two halves' exclusive or."""
    most = len(elements) * (den - num) // num + 1
    cells = 1 << max(6, (4 * most - 1).bit_length())
    at = (mix(elements ^ U64(0xE7037ED1A0B428DB)) & U64(cells - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=cells) & 1, bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """All at the fewest cells among them, as rows of 64-bit words."""
    least = min(map(len, sketches))
    out = []
    for raw in sketches:
        row = np.frombuffer(raw, np.uint64)
        while row.nbytes > least:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out.append(row)
    return np.stack(out)


def sifted(sizes: np.ndarray, sketches: list[bytes], num: int, den: int) -> np.ndarray:
    """Smallest position of each set's component, for pairs that may link by size and sketch."""
    rows, c = _folded(sketches), len(sizes)
    low = np.arange(c)
    for at in range(0, c, 128):
        i = slice(at, at + 128)
        differ = np.zeros((len(sizes[i]), c), np.int64)
        for word in range(rows.shape[1]):
            differ += np.bitwise_count(rows[i, word, None] ^ rows[None, :, word])
        both = sizes[i, None] + sizes
        may = (differ * (den + num) <= both * (den - num)) & (np.minimum(sizes[i, None], sizes) * den >= np.maximum(sizes[i, None], sizes) * num)
        left, right = np.nonzero(may)
        left += at
        cross = low[left] != low[right]
        low = forest(c, np.concatenate([np.arange(c), left[cross]]), np.concatenate([low, right[cross]]))
    return low


def sets(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, key, short, sketch): size, 128-bit digest and sketch of each document's shingle set; ``short`` is
    half the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in small_batches(batches):
            found = [shingle_set(known.of(ascii_words(t)), words) for t in batch.column(1).to_pylist()]
            keys = [_key(s) for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array(keys, pa.binary()),
                 pa.array([_short(k) for k in keys], pa.int64()), pa.array([sketch(s, num, den) for s in found], pa.binary())],
                names=["doc_id", "n", "key", "short", "sketch"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, key binary, short long, sketch binary")


def signatures(docs: DataFrame, words: int, signer: Signer, remember: int = 200_000) -> DataFrame:
    """(sig, short). A set that its task has just met is not signed again: copies shrink before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = WordHashes(), set()
        for batch in small_batches(batches, 128):
            sigs, owners = [], []
            for text in batch.column(1).to_pylist():
                elements = shingle_set(known.of(ascii_words(text)), words)
                if not len(elements):
                    continue
                short = _short(_key(elements))
                if short in met:
                    continue
                if len(met) >= remember:
                    met.clear()
                met.add(short)
                own = signer.of(elements)
                sigs.append(own.view(np.int64))
                owners.append(np.full(len(own), short))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(owners))], names=["sig", "short"])

    return docs.where("doc_id is not null").mapInArrow(lean(run), "sig long, short long")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature as lists of the different sets of each: every list once, as far as this task
    knows. A signature that every set has by leaving an element out says nothing; rows without that come
    first. Lists end at ``SIFTED`` sets; the next one then begins with the last set of the one before."""
    met: set[bytes] = set()
    rest: list[np.ndarray] = []  # the rows of the signature that the last batch ended with
    size = 0

    def lists(sig: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        bucket = sig >> 1
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        many = np.flatnonzero((np.diff(cuts) > 1) & ((sig[cuts[:-1]] & 1) == 0))
        out = []
        for k in many:
            own = np.unique(owner[cuts[k] : cuts[k + 1]])
            for at in range(0, len(own) - 1, SIFTED - 1):
                part = own[at : at + SIFTED]
                name = hashlib.blake2b(part.tobytes(), digest_size=12).digest()
                if name not in met:
                    if len(met) >= 500_000:
                        met.clear()
                    met.add(name)
                    out.append((part, len(own) > SIFTED))
        return pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in out], pa.list_(pa.int64())), pa.array([c for _, c in out], pa.bool_())], names=["members", "chained"])

    def gathered() -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate(rest)
        return both[:, 0], both[:, 1]

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1)
        last = np.searchsorted(rows[:, 0], rows[-1, 0] & ~1)  # sorted: where the last signature begins
        if last > 0:
            rest.append(rows[:last])
            yield lists(*gathered())
            rest, size = [rows[last:]], len(rows) - last
        elif rest and rest[-1][-1, 0] >> 1 != rows[0, 0] >> 1:
            yield lists(*gathered())
            rest, size = [rows], len(rows)
        else:  # one signature only: keep each set once, the rows without a missing element first
            rest.append(rows)
            size += len(rows)
            if size > 1 << 20:
                sig, owner = gathered()
                _, first = np.unique(owner, return_index=True)
                first.sort()
                rest = [np.stack([sig[first], owner[first]], 1)]
                size = len(first)
    if rest:
        yield lists(*gathered())


def _sift(num: int, den: int):
    def settle(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(rows)
        owner, sizes = group.column("short").to_numpy(), group.column("n").to_numpy()
        if len(owner) < 2:
            return
        low = np.maximum(np.arange(len(owner)) - 1, 0) if group.column("chained")[0].as_py() else sifted(sizes, group.column("sketch").to_pylist(), num, den)
        hit = np.flatnonzero(low != np.arange(len(low)))
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(owner[hit]), pa.array(owner[low[hit]])], names=["a", "b"])

    return _grouped(["list"], settle)


def _grouped(keys: list[str], settle):
    """Applies ``settle`` to the rows of each key, in batches that are sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], 1)
            cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if now != tuple(own[i]) and rows:
                    yield from settle(rows)
                    rows = []
                now = tuple(own[i])
                rows.append(batch.slice(i, j - i))
        if rows:
            yield from settle(rows)

    return run


def linked(found: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Smallest position of each set's component among ``found``, by exact intersections."""
    c = len(found)
    sizes = np.array([len(s) for s in found], np.int64)
    elements, owner = np.concatenate(found), np.repeat(np.arange(c), sizes)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    new = np.concatenate([[True], elements[1:] != elements[:-1]])
    rank = np.cumsum(new) - 1
    often = np.bincount(rank)[rank] > 1
    rank, owner = rank[often], owner[often]
    _, rank = np.unique(rank, return_inverse=True)
    shared, width = np.zeros((c, c), np.float32), max(1, _CELLS // c)  # counts below 2 ** 24 are exact
    columns = int(rank.max()) + 1 if len(rank) else 0
    for at in range(0, columns, width):
        i, j = np.searchsorted(rank, [at, at + width])
        cells = np.zeros((c, min(width, columns - at)), np.float32)
        cells[owner[i:j], rank[i:j] - at] = 1
        shared += cells @ cells.T
    both = shared.astype(np.int64)
    left, right = np.nonzero(den * both >= num * (sizes[:, None] + sizes - both))
    keep = left < right
    return forest(c, left[keep], right[keep])


def _verify(words: int, num: int, den: int):
    known = WordHashes()  # each task gets an empty one

    def settle(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(rows)
        if group.num_rows < 2:
            return
        keys = group.column("key").to_pylist()
        found = [shingle_set(known.of(ascii_words(t)), words) for t in group.column("text").to_pylist()]
        low = linked(found, num, den)
        hit = np.flatnonzero(low != np.arange(len(low)))
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit], pa.binary()), pa.array([keys[low[i]] for i in hit], pa.binary())], names=["a", "b"])

    return _grouped(["cluster", "one", "other"], settle)


def similar(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, group of every row of ``docs`` (doc_id, text).

    A document's set holds its distinct runs of ``words`` words (between ASCII white space, A-Z lower-cased); a
    shorter text is one run. Sets link when ``den * |intersection| >= num * |union|``; ``component_id`` is the smallest
    doc_id that links reach and ``group`` names the component.

    Null, empty or blank text: empty set, links with nothing. Null doc_id: links with nothing, component_id
    null. Rows that share an id are sets of their own. Repeated rows: one set. Empty table: no rows. Other
    columns are not read.
    """
    if not 0 < num <= den:
        raise ValueError("a similarity in (0, 1] is needed")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = kept(sets(docs, words, num, den), "sets")
    if num < den:
        level = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).cast("int")
        crowd = {r["level"]: r["count"] for r in every.where("n > 0").groupBy(level.alias("level")).count().collect()}  # a row for each band
    else:
        crowd = {}
    links = _cluster_links(docs, every, words, num, den, crowd, parts) if num < den else None
    nodes = every.where("n > 0 and doc_id is not null")
    if links is None:
        comps = None
    else:
        clusters = components(links, "clusters").toDF("short", "cluster")
        members = kept(nodes.join(clusters, "short").groupBy("key", "cluster").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "members")
        load = members.groupBy("cluster").agg(F.greatest(
            F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_ELEMENTS)).alias("blocks"), F.count("*").alias("size"))
        dealt = members.join(load.where("size > 1"), "cluster").select(
            "doc_id", "key", "cluster", "blocks", F.pmod(F.xxhash64("key"), "blocks").alias("block"))
        # a merge join at every size: the list of members grows with the corpus
        tiles = docs.join(dealt.hint("merge"), "doc_id").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
            "cluster", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), "key", "text")
        tile = ["cluster", "one", "other"]
        found = tiles.repartition(parts, *tile).sortWithinPartitions(*tile).mapInArrow(lean(_verify(words, num, den)), "a binary, b binary")
        comps = components(found, "similar").toDF("key", "root")
    rooted = nodes.select("doc_id", "n", "key")
    rooted = rooted.join(comps, "key", "left").withColumn("root", F.coalesce("root", "key")) if comps is not None else rooted.withColumn("root", F.col("key"))
    rooted = kept(rooted.select("doc_id", "n", "root"), "rooted")
    # Written, so that adaptive execution may split a root that holds many rows.
    low = kept(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "lowest")
    placed = rooted.join(low, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.hex("root").alias("group"))
    alone = every.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("string").alias("group"))
    return placed.unionAll(alone)


def _cluster_links(docs: DataFrame, every: DataFrame, words: int, num: int, den: int, crowd: dict[int, int], parts: int) -> DataFrame:
    signed = signatures(docs, words, Signer(num, den, crowd))
    buckets = signed.repartition(parts, F.call_function("shiftright", F.col("sig"), F.lit(1))).sortWithinPartitions("sig").mapInArrow(
        lean(_buckets), "members array<long>, chained boolean")
    lists = kept(kept(buckets, "buckets").distinct().withColumn("list", F.monotonically_increasing_id()), "lists")
    facts = every.where("n > 0 and doc_id is not null").dropDuplicates(["short"]).select("short", "n", "sketch")
    rows = lists.select("list", "chained", F.explode("members").alias("short")).join(facts, "short")
    return rows.repartition(parts, "list").sortWithinPartitions("list", "short").mapInArrow(lean(_sift(num, den)), "a long, b long")


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group, with all their columns, whatever they are called.

    Documents that link with nothing stay, those without text or id too. Rows that share an id stay if one of
    them does.
    """
    found = similar(docs, words, num, den)
    lost = found.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("lost")).where("lost").select(
        F.col("doc_id").alias("lost_id"), F.pmod("doc_id", F.lit(1)).cast("long").alias("lost_salt"))  # 0, but nothing to fold
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    # Rows without an id link with nothing; they are spread over the join by their text.
    salt = F.when(F.col("id").isNull(), F.xxhash64("row.text")).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("salt", salt).join(
        lost.hint("merge"), (F.col("id") == F.col("lost_id")) & (F.col("salt") == F.col("lost_salt")), "left_anti").select("row.*")


def sql(words: int, num: int, den: int) -> str:
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - {words} + 1, 1) + 1), lambda i: array_to_string(w[i : i + {words - 1}], ' '))) AS s
  FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * c >= {num} * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""
