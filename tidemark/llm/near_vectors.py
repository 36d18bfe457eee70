"""Embedding near-dedup by a forest of random-projection trees.

Equal vectors form one node. Each tree splits the nodes at the median of a random projection, again and
again; nodes within SPILL of the median by rank go to both sides. A tree's splits are fitted on a sample of
about SAMPLE nodes, every node is sent through them, and leaves that still hold over LEAF nodes are
sampled and split again, round after round. A part of which TIGHT of the sampled pairs are links is not
split, whatever its size, since a split would part its links: it is compared whole, which takes at most
1 / TIGHT comparisons for each link that it counts.

Within each leaf all nodes are compared in double precision: small leaves at once, others in tiles of two
blocks of about BLOCK nodes, so that no task holds a whole group. A pair may meet in several leaves. It is
counted in the least-numbered leaf that both its nodes are in, which each tile can tell from its nodes' lists
of leaves; so link counts are sums over tiles, and a tile gives one row a node (its links, and the first node
of its part of the tile), never pairs. The rows are then summed and joined up into components.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing and stand alone;
vectors of different lengths never meet. Repeated vec_ids are rows like others; a null vec_id is kept, and is
a component's id only where it stands alone. Leaves that don't get smaller in ROUNDS rounds are compared
whole. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.components import connected_components
from tidemark.llm.lattice import mix
from tidemark.llm.vectors import keyed, matrix, unit

TREES, LEAF, SAMPLE, SPILL, ROUNDS = 16, 1024, 4096, 0.10, 8
#: Levels a round adds at most; nodes that one task sends through a tree; nodes of a tile's block.
LEVELS, PART, BLOCK = 7, 16_384, 4096
#: Share of links among sampled pairs from which a part is compared whole; sampled nodes it takes to tell, and that are compared.
TIGHT, TELL, PROBE = 0.1, 16, 256
COSINE = 0.9


class Tree:
    """LEVELS of splits at most, as one direction and two thresholds a split; ``whole`` marks parts that are not
    split. Directions follow from the seed and are not pickled."""

    def __init__(self, x: np.ndarray, levels: int, seed: int, cosine: float):
        self.seed, self.dim, n = seed & (2**63 - 1), x.shape[1], (1 << levels) - 1
        self.lo, self.hi, self.whole = np.zeros(n), np.zeros(n), np.zeros(n, dtype=bool)
        held = {0: np.arange(len(x))}
        for s in range(n):
            if s not in held:
                continue
            own = held.pop(s)
            probe = x[own[:PROBE]]
            if len(probe) >= TELL and ((probe @ probe.T >= cosine).sum() - len(probe)) >= TIGHT * len(probe) * (len(probe) - 1):
                self.whole[s] = True
                continue
            p = x[own] @ self.way[s]
            if len(p):
                self.lo[s], self.hi[s] = np.quantile(p, [0.5 - SPILL / 2, 0.5 + SPILL / 2])
            if 2 * s + 1 < n:
                held[2 * s + 1], held[2 * s + 2] = own[p <= self.hi[s]], own[p >= self.lo[s]]

    @functools.cached_property
    def way(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((len(self.lo), self.dim))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "way"}

    def route(self, x: np.ndarray) -> list[tuple[int, bool, np.ndarray]]:
        """(part, whether it stays whole, rows) of the parts that get rows."""
        held, out = {0: np.arange(len(x))}, []
        for s in range(len(self.lo)):
            if s in held:
                own = held.pop(s)
                if self.whole[s]:
                    out.append((s, True, own))
                    continue
                p = x[own] @ self.way[s]
                for child, to in ((2 * s + 1, own[p <= self.hi[s]]), (2 * s + 2, own[p >= self.lo[s]])):
                    if len(to):
                        held[child] = to
        return out + [(s, False, own) for s, own in held.items()]


_LEAF = "key binary, leaf long, whole boolean"


def _child(leaf: int, k: int) -> int:
    return int(mix(np.array([(leaf * 0x9E3779B97F4A7C15 + k + 1) & (2**64 - 1)], dtype=np.uint64)).view(np.int64)[0])


def _levels(n: int) -> int:
    return max(1, min(LEVELS, math.ceil(math.log2(max(2.0, 2.0 * n / LEAF)))))


def _routed(tree: Tree, root: int, keys: pa.Array, x: np.ndarray):
    for k, whole, own in tree.route(x):
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(own)), pa.array(np.full(len(own), _child(root, k))), pa.array(np.full(len(own), whole))], names=["key", "leaf", "whole"])


def _planted(nodes: DataFrame, dim: int, n: int, cosine: float) -> DataFrame:
    """(key, leaf, whole) of the first round: every tree over all nodes of one dimension."""
    pick = nodes.orderBy(F.xxhash64("key")).limit(SAMPLE).select("raw").toArrow()
    sample = unit(matrix(pick.column("raw"), dim))
    trees = {(t + 1) * 1_000_003 + dim: Tree(sample, _levels(n) if n > LEAF else 0, t, cosine) for t in range(TREES if n > LEAF else 1)}
    shared = nodes.sparkSession.sparkContext.broadcast(trees)  # thresholds of TREES * 2 ** LEVELS splits

    def run(batches):
        for b in batches:
            if len(b):
                x = unit(matrix(b.column("raw"), dim))
                for root, tree in shared.value.items():
                    yield from _routed(tree, root, b.column("key"), x)

    return nodes.select("key", "raw").mapInArrow(run, _LEAF)


def _split_again(held: DataFrame, over: DataFrame, nodes: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(key, leaf, whole) of the nodes of the leaves in ``over`` (leaf, m), after another round."""
    rows = held.select("key", "leaf").join(over, "leaf").join(nodes.select("key", "raw"), "key")
    sample = rows.where(F.pmod(F.xxhash64("key", "leaf"), "m") < SAMPLE)

    def grow(t: pa.Table) -> pa.Table:
        leaf = t.column("leaf")[0].as_py()
        tree = Tree(unit(matrix(t.column("raw"), dim)), _levels(t.column("m")[0].as_py()), leaf, cosine)
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    parts = F.ceil(F.col("m") / PART)
    trees = sample.groupBy("leaf").applyInArrow(grow, "leaf long, tree binary").join(over, "leaf")
    trees = trees.select("leaf", "tree", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))

    def route(own: pa.Table, tree: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and tree.num_rows:
            leaf, grown = tree.column("leaf")[0].as_py(), pickle.loads(tree.column("tree")[0].as_py())
            out = list(_routed(grown, leaf, own.column("key").combine_chunks(), unit(matrix(own.column("raw"), dim))))
        return pa.Table.from_batches(out, pa.schema([("key", pa.binary()), ("leaf", pa.int64()), ("whole", pa.bool_())]))

    dealt = rows.select("leaf", F.pmod(F.xxhash64("key"), parts).alias("part"), "key", "raw")
    return dealt.groupBy("leaf", "part").cogroup(trees.groupBy("leaf", "part")).applyInArrow(route, _LEAF)


def _compared(dim: int, cosine: float):
    """(key, degree, root) of the nodes of a tile that have links in it: blocks i and j of a leaf, or all of it."""

    def tile_links(t: pa.Table) -> pa.Table:
        leaf, i, j = (t.column(c)[0].as_py() for c in ("leaf", "i", "j"))
        block, keys, copies = np.asarray(t.column("block")), t.column("key").combine_chunks(), np.asarray(t.column("copies"))
        x = unit(matrix(t.column("raw"), dim))
        lists = t.column("leaves").combine_chunks()
        code, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(t)), np.diff(lists.offsets.to_numpy()))
        names, at, many = np.unique(code, return_inverse=True, return_counts=True)
        told = (names < leaf) & (many > 1)
        seen = np.zeros((len(t), int(told.sum())), dtype=bool)
        some = told[at]
        seen[of[some], (np.cumsum(told) - 1)[at[some]]] = True
        seen = np.packbits(seen, axis=1)
        degree, root, linked = np.zeros(len(t)), np.arange(len(t)), np.zeros(len(t), dtype=bool)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for a in range(0, len(left), 256):
            u, v = np.nonzero(x[left[a : a + 256]] @ x[right].T >= cosine)
            u, v = left[a + u], right[v]
            if i == j:
                u, v = u[u < v], v[u < v]
            if not len(u):
                continue
            linked[u] = linked[v] = True
            new = np.concatenate([~(seen[u[c : c + 65536]] & seen[v[c : c + 65536]]).any(axis=1) for c in range(0, len(u), 65536)])
            degree += np.bincount(u[new], copies[v[new]], len(t)) + np.bincount(v[new], copies[u[new]], len(t))
            while True:  # parts are joined at their roots, by minima and jumps
                apart = root[u] != root[v]
                u, v = u[apart], v[apart]
                if not len(u):
                    break
                least = np.minimum(root[u], root[v])
                np.minimum.at(root, root[u], least)
                np.minimum.at(root, root[v], least)
                while (root[root] != root).any():
                    root = root[root]
        own = np.flatnonzero(linked)
        return pa.table({"key": keys.take(pa.array(own)), "degree": pa.array(degree[own].astype(np.int64)), "root": keys.take(pa.array(root[own]))})

    return tile_links


def _tiles(held: DataFrame, own: DataFrame) -> DataFrame:
    """Each leaf's nodes: once if it is small, else in a tile for each two blocks of it."""
    lists = held.groupBy("key").agg(F.collect_set("leaf").alias("leaves"))
    blocks = held.groupBy("leaf").agg(F.count("*").alias("m")).select("leaf", F.when(F.col("m") <= LEAF, 1).otherwise(F.ceil(F.col("m") / BLOCK)).cast("int").alias("k"))
    placed = held.join(blocks, "leaf").select("key", "leaf", "k", F.pmod(F.xxhash64("key", F.lit(1)), "k").cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
    full = own.join(lists, "key").join(placed, "key").select("key", "copies", "raw", "leaves", "leaf", "block", other)
    return full.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))


def links(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    scratch = Scratch(df.sparkSession, "trees")
    rows = scratch.keep(keyed(df, vec_id, vector), "rows")
    nodes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("raw").alias("raw"))
    nodes = scratch.keep(nodes, "nodes")
    found = []
    for d in sorted(nodes.groupBy("dim").count().collect(), key=lambda r: r["dim"]):
        own = nodes.where(F.col("dim") == d["dim"])
        held = scratch.keep(_planted(own, d["dim"], d["count"], cosine), "leaves")
        for _ in range(ROUNDS):
            over = scratch.keep(held.where("not whole").groupBy("leaf").agg(F.count("*").alias("m")).where(F.col("m") > LEAF), "over")
            if over.isEmpty():
                break
            held = scratch.keep(held.join(over, "leaf", "left_anti").select("key", "leaf", "whole").unionAll(_split_again(held, over, own, d["dim"], cosine)), "leaves")
        found.append(_tiles(held, own).groupBy("leaf", "i", "j").applyInArrow(_compared(d["dim"], cosine), "key binary, degree long, root binary"))
    if found:
        met = scratch.keep(functools.reduce(DataFrame.unionAll, found), "met")
        labels = connected_components(scratch, met, "key", "root")
        degrees = met.groupBy("key").agg(F.sum("degree").alias("degree"))
        known = nodes.select("key", "vec_id", "copies").join(degrees, "key", "left").join(labels.withColumnRenamed("node", "key"), "key", "left")
        known = scratch.keep(known.withColumn("label", F.coalesce("label", "key")), "known")
        least = known.groupBy("label").agg(F.min("vec_id").alias("component_id"))
        told = known.join(least, "label").select("key", (F.coalesce("degree", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"), "component_id")
        out = rows.select("vec_id", "key").join(told, "key", "left")
    else:
        out = rows.select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
