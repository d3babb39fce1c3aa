"""Operator 6: near-duplicate vectors by int8 tile products with error bounds.

Equal vectors of a label are one node with a number of copies, so copies are never compared. The nodes of a
label are dealt into blocks of bounded size, and each pair of blocks is one tile: a task multiplies int8
vectors, and recomputes in double precision only the pairs whose product plus error bound reaches the threshold.
With unit vectors ``u = s q + e`` the product's error is at most ``|e_i| |s_j q_j| + |s_i q_i| |e_j| + |e_i| |e_j|``.

A tile returns no pairs, but a row for each linked node: how many it links to there, and the
smallest node of its component within the tile. Sums and components of these rows are exact for the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.llm.shared import components, forest, kept

#: Nodes in a block.
BLOCK = 2048
_STRIPE = 256


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8: values, scales, norms of the rounded vectors, norms of the errors (rounded up)."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None])
    near = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(near, axis=1) * (1 + 1e-12), np.linalg.norm(u - near, axis=1) * (1 + 1e-9) + 1e-12


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of linked vectors of ``a`` and ``b``, stripe by stripe; each pair once if they are the same block."""
    qa, sa, na, ea = quantised(a)
    qb, sb, nb, eb = quantised(b)
    exact = np.float32 if 127 * 127 * a.shape[1] < 1 << 24 else np.float64  # integers up to there
    qb_t, norm_a, norm_b = qb.astype(exact).T.copy(), np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    for at in range(0, len(a), _STRIPE):
        i = slice(at, at + _STRIPE)
        about = (qa[i].astype(exact) @ qb_t).astype(float) * sa[i, None] * sb
        bound = ea[i, None] * nb + na[i, None] * eb + ea[i, None] * eb + 1e-9
        left, right = np.nonzero(about + bound >= threshold)
        left += at
        if same:
            left, right = left[left < right], right[left < right]
        for k in range(0, len(left), 1 << 16):
            x, y = left[k : k + (1 << 16)], right[k : k + (1 << 16)]
            cosine = np.einsum("ij,ij->i", a[x], b[y]) / (norm_a[x] * norm_b[y])
            yield x[cosine >= threshold], y[cosine >= threshold]


def _tile(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        x, copies, block = np.stack(rows["vector"].to_numpy()).astype(float), rows["copies"].to_numpy(), rows["block"].to_numpy()
        one, other = np.flatnonzero(block == key[2]), np.flatnonzero(block == key[3])
        linked, lefts, rights = np.zeros(len(x), np.int64), [], []
        low = np.arange(len(x))
        for i, j in tile_links(x[one], x[other], threshold, key[2] == key[3]) if len(one) and len(other) else ():
            i, j = one[i], other[j]
            np.add.at(linked, i, copies[j])
            np.add.at(linked, j, copies[i])
            differ = low[i] != low[j]
            lefts, rights = low[i[differ]], low[j[differ]]
            if len(lefts):
                low = forest(len(x), np.concatenate([np.arange(len(x)), lefts]), np.concatenate([low, rights]))
        hit = linked > 0
        nodes = rows["node"].to_numpy()
        return pd.DataFrame({"node": nodes[hit], "links": linked[hit], "low": nodes[low[hit]]})

    return run


def _in_reach(vector: Column) -> Column:
    """Vectors whose squares would overflow or vanish, by a power of two nearer to 1: that rounds nothing that counts."""
    power = F.floor(F.log2(F.array_max(F.transform(vector, F.abs))))
    half = F.pow(F.lit(2.0), -F.floor(power / 2))  # twice, as the whole may be out of reach itself
    return F.when(F.abs(power) > 300, F.transform(vector, lambda v: v * half * half)).otherwise(vector)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """A row for each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and their cosine is at least ``threshold``. ``n_links`` counts the other
    rows linked directly; ``component_id`` is the smallest vec_id that links reach; ``kept`` marks it.

    Null label, null, empty or zero vector, null or non-finite component: links with nothing. Vectors of different
    length never link. Null vec_id: links with nothing, component_id null, not kept. Rows that repeat an id
    are vectors of their own. Empty table: no rows. Other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold in (0, 1] is needed")
    x = F.col("vector")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    good = rows.where(F.coalesce(sound, F.lit(False))).withColumn("vector", _in_reach(x))
    nodes = good.groupBy("label", "vector").agg(F.count("*").alias("copies")).withColumn("size", F.size("vector"))
    nodes = kept(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")  # numbered once, then read
    blocks = nodes.groupBy("label", "size").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = nodes.join(blocks, ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    tiles = dealt.select("node", "label", "size", "vector", "copies", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with"))
    tiles = tiles.withColumns({"one": F.least("block", "with"), "other": F.greatest("block", "with")})
    found = kept(tiles.groupBy("label", "size", "one", "other").applyInPandas(_tile(threshold), "node long, links long, low long"), "tiles")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")), "vectors")
    facts = nodes.select("node", "label", "vector", "copies").join(links, "node", "left").join(roots, "node", "left").select(
        "label", "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    placed = kept(good.join(facts, ["label", "vector"]).select("vec_id", "n_links", "root"), "placed")
    # Written, so that adaptive execution may split a root that holds many rows.
    smallest = kept(placed.groupBy("root").agg(F.min("vec_id").alias("component_id")), "smallest")
    linked = placed.join(smallest, "root").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS c FROM links GROUP BY a), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(c, 0)::BIGINT AS n_links, low.b AS component_id, vec_id = low.b AS kept
FROM embeddings JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
