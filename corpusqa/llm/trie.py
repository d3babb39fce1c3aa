"""Operator 12: prefix trie of conversations, by ternary search trees over range shards.

1. A conversation is one row: the 128-bit digests of its turns in order and their words. Texts stay behind.
   (A row takes 20 bytes a turn, so a conversation may have some 100 million turns.)
2. Equal conversations are one sequence with a weight, found by partial aggregation: a group of copies of any size is
   one row from there on.
3. Sequences are range-partitioned in their order. A *shard* is a run of them with about ``SHARD`` turns, whatever the size of
   the partition. A task numbers the digests of a shard in order (its dictionary) and inserts the sequences into
   a ternary search tree, medians first, so the trees of siblings are balanced. One pass over the nodes, children before
   parents and without recursion, adds up members, leaves and savings.
4. Only nodes on the first and the last path of a shard can be in others too. These few are merged: sums over shards, less what
   neighbours count twice, which follows from the path that the last sequence of one and the first of the next share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusqa.llm.shared import crc_of, kept, lean
from corpusqa.operators.skew import attach

#: Turns in a shard.
SHARD = 100_000
#: Characters of joined ids that are handed on at a time.
_PIECE = 1 << 16
_ROOT = hashlib.blake2b(b"", digest_size=16).digest()

_NODES = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("least", pa.int64()),
    ("parent_least", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends", pa.string()), ("words", pa.int64()), ("path_words", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("tail", pa.bool_())])
NODES = ("part int, shard int, node binary, parent binary, depth long, least long, parent_least long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, ends string, words long, path_words long, first boolean, last boolean, tail boolean")


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns (id, words) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    name = F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), name.alias("id"),
                 F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")).alias("turn"))
    ordered = F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def rebuilt(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, turns) with the first turns of a conversation replaced by those of its group's first one: ``h`` of
    them, the crc32 of the id as text modulo ``heads``."""
    own = kept(own_turns(conversations), "turns")
    empty = F.array().cast(own.schema["turns"].dataType)
    base = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (crc_of("conv_id") % heads).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(base, "base", "left")
    turns = F.concat(F.slice(F.coalesce("head", empty), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return both.select("conv_id", turns.alias("turns"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by group, as pieces of joined text: (h1, h2, first id, text)."""
    now, ids, size = None, [], 0
    out: list[tuple] = []
    for batch in batches:
        for h1, h2, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (h1, h2) or size > _PIECE:
                if ids:
                    out.append((*now, ids[0], ",".join(map(str, ids))))
                now, ids, size = (h1, h2), [], 0
            ids.append(conv)
            size += 20
        if out:
            yield _rows(out, _PIECES)
            out = []
    if ids:
        yield _rows([(*now, ids[0], ",".join(map(str, ids)))], _PIECES)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's pieces, in their order and with commas between."""
    now, sha = None, None
    for batch in batches:
        out = []
        for h1, h2, _, text in zip(*(c.to_pylist() for c in batch.columns)):
            if now == (h1, h2):
                sha.update(b",")
            else:
                if sha is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (h1, h2), hashlib.sha256()
            sha.update(text.encode())
        if out:
            yield _rows(out, _ENDS)
    if sha is not None:
        yield _rows([(*now, sha.hexdigest())], _ENDS)


_PIECES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.int64()), ("text", pa.string())])
_ENDS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("ends", pa.string())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def sequences(convs: DataFrame) -> DataFrame:
    """(least, n, ends, ids, words): each different sequence once, with its smallest conversation, how many have
    it, and the SHA-256 of their ids."""
    spark = convs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(convs.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words")).withColumns(
        {"h1": F.xxhash64("ids"), "h2": F.xxhash64(F.lit(1), "ids")}), "sequences")
    group = ["h1", "h2"]
    weight = rows.groupBy(*group).agg(F.min("conv_id").alias("least"), F.count("*").alias("n"))
    # Ids become text in all tasks; only the text of a group goes through one, a piece at a time.
    pieces = rows.select(*group, "conv_id").repartitionByRange(parts, *group, "conv_id").sortWithinPartitions(*group, "conv_id").mapInArrow(
        lean(_pieces), "h1 long, h2 long, first long, text string")
    ends = pieces.repartition(parts, *group).sortWithinPartitions(*group, "first").mapInArrow(lean(_hashes), "h1 long, h2 long, ends string")
    return weight.join(ends, group).join(rows.select(F.col("conv_id").alias("least"), "ids", "words"), "least").select("least", "n", "ends", "ids", "words")


class Tree:
    """A ternary search tree. Node 0 is the trie's root; ``same`` leads to the tree of a node's children, ``low`` and ``high`` to
    siblings of smaller and larger numbers. A node's number in the lists is larger than its parent's."""

    def __init__(self):
        self.number, self.low, self.same, self.high = [-1], [0], [0], [0]
        self.parent, self.depth, self.words = [-1], [0], [0]

    def _new(self, number: int, parent: int, words: int) -> int:
        for column, value in ((self.number, number), (self.low, 0), (self.same, 0), (self.high, 0), (self.parent, parent),
                              (self.depth, self.depth[parent] + 1), (self.words, words)):
            column.append(value)
        return len(self.number) - 1

    def insert(self, numbers: list[int], words: list[int]) -> int:
        """The node at which the sequence ends."""
        at = 0
        for x, w in zip(numbers, words):
            side, node, up = self.same, at, at  # the link that leads on
            while (found := side[node]) and self.number[found] != x:
                node = found
                side = self.low if x < self.number[found] else self.high
            if not found:
                found = self._new(x, up, w)
                side[node] = found
            at = found
        return at

    def path(self, node: int) -> set[int]:
        out = {node}
        while node:
            node = self.parent[node]
            out.add(node)
        return out


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of each stretch before its halves."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            todo += [(a, middle), (middle + 1, b)]


def shard_nodes(rows: list[tuple], part: int, shard: int) -> Iterator[pa.RecordBatch]:
    """``NODES`` of one shard: ``rows`` are (least, n, ends, ids, words), different and in order of ids."""
    dictionary = {x: k for k, x in enumerate(sorted({x for r in rows for x in r[3]}))}
    tree, stop = Tree(), [0] * len(rows)
    for k in medians(len(rows)):
        stop[k] = tree.insert([dictionary[x] for x in rows[k][3]], rows[k][4])
    count = len(tree.number)
    n, ends, least, children, leaves, saved = [0] * count, [None] * count, [None] * count, [0] * count, [0] * count, [0] * count
    for node, row in zip(stop, rows):
        least[node], n[node], ends[node] = row[:3]
    for node in range(count - 1, -1, -1):  # children first
        if not children[node]:
            leaves[node] = 1
        saved[node] += (n[node] - 1) * tree.words[node]
        up = tree.parent[node]
        if up >= 0:
            n[up] += n[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    backwards = {k: x for x, k in dictionary.items()}
    name, path_words = [_ROOT] * count, [0] * count
    for node in range(1, count):  # parents first
        up = tree.parent[node]
        name[node] = hashlib.blake2b(name[up] + backwards[tree.number[node]], digest_size=16).digest()
        path_words[node] = path_words[up] + tree.words[node]
    first, last = tree.path(stop[0]), tree.path(stop[-1])
    edge = first | last
    for at in range(0, count, 20_000):
        out = []
        for node in range(at, min(count, at + 20_000)):
            up = tree.parent[node]
            out.append((part, shard, name[node], name[up] if node else None, tree.depth[node], least[node],
                        least[up] if node and up not in edge else None, n[node], children[node], leaves[node], saved[node], ends[node],
                        tree.words[node], path_words[node], node in first, node in last, node == stop[-1]))
        yield _rows(out, _NODES)


def _shards(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, rows, turns = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns)):
                    rows.append(row)
                    turns += 1 + len(row[3])
                    if turns >= size:
                        yield from shard_nodes(rows, part, shard)
                        shard, rows, turns = shard + 1, [], 0
        if rows:
            yield from shard_nodes(rows, part, shard)

    return run


def _merged(edge: DataFrame) -> DataFrame:
    """The nodes of ``edge`` once each. A node is in neighbouring shards, and each counts by itself. Where the last path of one shard and
    the first of the next have nodes in common, each of these was counted once too often as a child, its words once
    too seldom as saved; and the sequence that ends the one is no leaf if it goes on in the next."""
    order = Window.orderBy("part", "shard")  # one short row for each shard
    number = edge.select("part", "shard").distinct().withColumn("pair", F.row_number().over(order))
    numbered = edge.join(number, ["part", "shard"])
    one = numbered.where("last").select("pair", "node", "depth", "words", "path_words", "tail")
    other = numbered.where("first").select((F.col("pair") - 1).alias("pair"), "node")
    common = kept(one.join(other, ["pair", "node"]), "common")
    deepest = common.groupBy("pair").agg(F.max("depth").alias("deep"), F.max("path_words").alias("total"), F.bool_or("tail").alias("goes_on"))
    zero = F.lit(None)
    less = common.join(deepest, "pair").select(
        "node", zero.cast("binary").alias("parent"), zero.cast("long").alias("depth"), zero.cast("long").alias("least"), F.lit(0).cast("long").alias("n_convs"),
        (-(F.col("depth") < F.col("deep")).cast("long")).alias("n_children"), (-F.col("goes_on").cast("long")).alias("n_leaves"),
        (F.col("total") - F.col("path_words") + F.col("words")).alias("saved_tokens"), zero.cast("string").alias("ends"))
    sums = edge.select(*less.columns).unionAll(less).groupBy("node")
    return kept(sums.agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("least").alias("least"),
                         *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends")), "edge")


def prefix_trie(convs: DataFrame, shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie of ``convs``
    (conv_id, turns: an array of (id, words)). ``convs`` has one row for each conversation.

    A conversation without turns ends at the root. Empty table: no rows, no root.
    """
    spark = convs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(sequences(convs), "distinct")
    nodes = kept(rows.repartitionByRange(parts, "ids").sortWithinPartitions("ids").select("least", "n", "ends", "ids", "words").mapInArrow(
        lean(_shards(shard)), NODES), "nodes")
    on_edge = F.col("first") | F.col("last")
    edge = _merged(nodes.where(on_edge))
    above = edge.select(F.col("node").alias("parent"), F.col("least").alias("parent_least"))
    inner = nodes.where(~on_edge)
    columns = ["least", "depth", "parent_least", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    # Children of a node of the edge, such as the root: any number of them.
    below = inner.where("parent_least is null").drop("parent_least")
    facts = kept(below.groupBy("parent").agg(F.count("*").alias("rows")).join(above, "parent"), "parents")
    met = attach(below, facts, "parent", "rows", ["node"])
    out = (inner.where("parent_least is not null").select(*columns)
           .unionAll(met.select(*columns)).unionAll(edge.join(above, "parent", "left").select(*columns)))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                      "saved_tokens", F.coalesce("ends", none).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """The prefix trie of ``conversations`` (conv_id, turn, role, text) that ``rebuilt`` makes.

    Turns come in order of ``turn``, null first; equal ones by their digest. Null role or text is empty. Null conv_id: no
    conversation, left out. Repeated rows are turns of their own. Empty table: no rows. Other columns are not read.
    """
    return prefix_trie(rebuilt(conversations, group, heads))


def crc_sql(text: str) -> str:
    """DuckDB's spelling of the crc32 of a text's UTF-8 bytes, bit by bit."""
    bits = f"flatten(list_transform(range(0, strlen({text})), lambda i: list_transform(range(0, 8), lambda j: (('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT >> j) & 1)))"
    return f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295)"


SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, left(sha256(strlen(role) || ':' || role || text), 32) AS id,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS place FROM turns
), ids AS (
  SELECT conv_id, {crc_sql('conv_id::VARCHAR')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)
), made AS (
  SELECT i.conv_id, 0 AS part, o.place, o.id, o.words FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % 20 WHERE o.place <= h
  UNION ALL
  SELECT i.conv_id, 1, o.place, o.id, o.words FROM ids i JOIN own o ON o.conv_id = i.conv_id WHERE o.place > h
), prefixes AS (
  SELECT conv_id, row_number() OVER run AS depth, words, sha256(string_agg(id, '') OVER run) AS node
  FROM made WINDOW run AS (PARTITION BY conv_id ORDER BY part, place)
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM ids
), linked AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM prefixes
), nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM linked GROUP BY node
), kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY parent
), under AS (
  SELECT up.node, sum((d.n - 1) * d.words) AS saved, count(*) FILTER (NOT EXISTS (SELECT 1 FROM kids WHERE kids.node = d.node)) AS leaves
  FROM nodes d JOIN prefixes up ON up.conv_id = d.conv_id AND up.depth <= d.depth GROUP BY up.node
)
SELECT a.conv_id, a.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, a.ends_sha256
FROM nodes a JOIN under u ON u.node = a.node LEFT JOIN nodes p ON p.node = a.parent LEFT JOIN kids k ON k.node = a.node
"""
