"""Approximate nearest neighbours by shifted space-filling curves.

Equal vectors form one node, which keeps its least k + 1 ids. Each of CURVES orderings projects the unit
vectors by random directions of its own, shifts and quantises them, and orders nodes by Hilbert key; Spark
range-partitions all orderings at once and gives every node its place. A query reads the blocks that its
window of WINDOW places either way touches, in every ordering; each block is compared with its queries as
one matrix product, and each query's best nodes of all blocks are merged and ranked by the exact cosine.

How far a window must reach depends on the data around the query, and the orderings tell: if a query's k best
were met in SEEN orderings on average, few equally near nodes can have been missed by all of them (capture and
recapture; at three of sixteen about one in twenty). The windows of all other queries are widened WIDER times,
again and again, until that holds or a window spans its ordering, which is exact. So clustered data cost narrow
windows, and data without structure, where no index can tell near from far, cost wide ones at the same recall.

Projections are fitted on SAMPLE nodes at most (their spread); all nodes are indexed. Vectors that are null,
empty, zero or hold null or non-finite components take no part, nor do rows whose id is null; vectors of
different lengths never meet. Ties go to the smaller id. Fewer candidates than k give fewer rows. Columns but
the id and the vector are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, global_rank, partitions_for
from tidemark.llm.vectors import keyed, matrix, unit

CURVES, AXES, BITS = 16, 8, 8
#: The first window either way and its growth; the most places of a block; orderings a query's best are met in, on average.
WINDOW, WIDER, BLOCK, SEEN = 512, 4, 4096, 3
SAMPLE = 4096


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer points [n, axes] of ``bits`` bits an axis: rotations undone from the top bit
    down, then a Gray code, then the bits interleaved."""
    x = x.astype(np.uint64).copy()
    one = np.uint64(1)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = np.uint64(q - 1)
        for a in range(x.shape[1]):
            on = (x[:, a] & np.uint64(q)) != 0
            swap = np.where(on, np.uint64(0), (x[:, 0] ^ x[:, a]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, a] ^= swap
    for a in range(1, x.shape[1]):
        x[:, a] ^= x[:, a - 1]
    turn = np.zeros(len(x), dtype=np.uint64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[:, -1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
    x ^= turn[:, None]
    key = np.zeros(len(x), dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for a in range(x.shape[1]):
            key = key << one | (x[:, a] >> np.uint64(b) & one)
    return key


class Curves:
    """Random projections with shifts, scaled by a sample's spread."""

    def __init__(self, sample: np.ndarray, dim: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        axes = min(AXES, dim)
        self.way = [np.linalg.qr(rng.standard_normal((dim, axes)))[0] for _ in range(CURVES)]
        self.mid = [(sample @ w).mean(axis=0) if len(sample) else np.zeros(axes) for w in self.way]
        self.spread = [np.maximum((sample @ w).std(axis=0), 1e-12) if len(sample) else np.ones(axes) for w in self.way]
        self.shift = rng.random((CURVES, axes)) / 2

    def keys(self, x: np.ndarray, c: int) -> np.ndarray:
        """Signed keys in the order of the unsigned ones."""
        at = ((x @ self.way[c] - self.mid[c]) / self.spread[c] / 6 + 0.5) / 1.5 + self.shift[c] / 1.5
        cell = np.clip(at * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
        return (hilbert(cell, BITS) ^ np.uint64(1 << 63)).view(np.int64)


def _met(dim: int, k: int):
    """The k nodes of a block nearest to each of its queries."""

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query": [], "node": [], "score": [], "ids": [], "curve": []}
        if block.num_rows and asked.num_rows:
            keys, ids = np.array(block.column("key").to_pylist(), dtype=object), block.column("ids").to_pylist()
            x = unit(matrix(block.column("raw"), dim))
            least, curve = np.array([i[0] for i in ids]), block.column("curve")[0].as_py()
            q = unit(matrix(asked.column("raw"), dim))
            for a in range(0, len(q), 1024):
                s = q[a : a + 1024] @ x.T
                best = np.lexsort((np.broadcast_to(least, s.shape), -s), axis=1)[:, :k]
                for row, name in enumerate(asked.column("key").slice(a, 1024).to_pylist()):
                    top = best[row]
                    out["query"] += [name] * len(top)
                    out["node"] += keys[top].tolist()
                    out["score"] += s[row, top].tolist()
                    out["ids"] += [ids[t] for t in top]
                    out["curve"] += [curve] * len(top)
        return pa.table(out, schema=pa.schema([("query", pa.binary()), ("node", pa.binary()), ("score", pa.float64()), ("ids", pa.list_(pa.int64())), ("curve", pa.int32())]))

    return run


_MET = "query binary, node binary, score double, ids array<long>, curve int"


def _best(met: DataFrame, k: int) -> DataFrame:
    """(query, node, score, ids, seen: orderings it was met in) of the k best nodes of each query. A query has
    a bounded number of rows here: k of each block of its windows."""
    one = met.groupBy("query", "node").agg(F.max("score").alias("score"), F.first("ids").alias("ids"), F.count_distinct("curve").alias("seen"))
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    return one.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k).drop("_r")


def nearest(df: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest other rows of each row for which ``is_query`` (of vec_id) holds."""
    spark = df.sparkSession
    scratch = Scratch(spark, "curves")
    rows = scratch.keep(keyed(df, vec_id, vector).where("key is not null and vec_id is not null"), "rows")
    first = Window.partitionBy("key").orderBy("vec_id")
    few = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    nodes = few.groupBy("key").agg(F.first("dim").alias("dim"), F.first("raw").alias("raw"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(is_query).select("vec_id", "key")
    nodes = scratch.keep(nodes.join(asked.select("key").distinct().withColumn("asks", F.lit(True)), "key", "left"), "nodes")
    found = [_search(scratch, nodes.where(F.col("dim") == d), d, k + 1) for (d,) in sorted(nodes.select("dim").distinct().collect())]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = functools.reduce(DataFrame.unionAll, found).groupBy(F.col("query").alias("key")).agg(F.collect_list(F.struct("score", "ids")).alias("all"))
    each = F.flatten(F.transform("all", lambda n: F.transform(n["ids"], lambda i: F.struct((-n["score"]).alias("far"), i.alias("id")))))
    mine = asked.withColumnRenamed("vec_id", "query_id").join(best, "key").withColumn("each", each)
    mine = mine.select("query_id", F.slice(F.array_sort(F.filter("each", lambda e: e["id"] != F.col("query_id"))), 1, k).alias("top"))
    out = mine.select("query_id", F.posexplode("top").alias("p", "e"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.far")).alias("score"))


def _placed(scratch: Scratch, nodes: DataFrame, dim: int) -> tuple[DataFrame, int]:
    """((curve, place in it from 0, key, raw, ids, asks) of each node in each ordering; the number of nodes)."""
    pick = nodes.orderBy(F.xxhash64("key")).limit(SAMPLE).select("raw").toArrow()
    shared = nodes.sparkSession.sparkContext.broadcast(Curves(unit(matrix(pick.column("raw"), dim)), dim))

    def place(batches):
        for b in batches:
            if len(b):
                x = unit(matrix(b.column("raw"), dim))
                for c in range(CURVES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), c, dtype=np.int32)), pa.array(shared.value.keys(x, c)), *b.columns], names=["curve", "at", *b.schema.names])

    placed = nodes.select("key", "raw", "ids", "asks").mapInArrow(place, "curve int, at long, key binary, raw binary, ids array<long>, asks boolean")
    ranked, total = global_rank(scratch, placed, ["curve", "at", "key"], partitions_for(nodes.sparkSession))
    n = total // CURVES  # every ordering has all nodes
    return ranked.select("curve", (F.col("pos") - F.col("curve") * n).alias("place"), "key", "raw", "ids", "asks"), n


def _search(scratch: Scratch, nodes: DataFrame, dim: int, k: int) -> DataFrame:
    """(query, node, score, ids, seen): the k best nodes of each node that asks, itself included."""
    placed, n = _placed(scratch, nodes, dim)
    asking, window, out = scratch.keep(placed.where("asks"), "asking"), WINDOW, []
    while True:
        size = min(window, BLOCK)
        reach = F.sequence(F.expr(f"greatest(0L, place - {window}) div {size}"), F.expr(f"least({max(0, n - 1)}L, place + {window}) div {size}"))
        asked = asking.select("curve", F.explode(reach).alias("block"), "key", "raw")
        side = placed.withColumn("block", F.expr(f"place div {size}")).join(asked.select("curve", "block").distinct(), ["curve", "block"], "left_semi")
        met = side.groupBy("curve", "block").cogroup(asked.groupBy("curve", "block")).applyInArrow(_met(dim, k), _MET)
        best = scratch.keep(_best(met, k), "best")
        if window >= n:
            out.append(best)
            break
        # The query's own node is met everywhere and tells nothing.
        others = F.sum(F.when(F.col("query") != F.col("node"), F.col("seen")))
        sure = best.groupBy("query").agg(others.alias("seen"), F.count("*").alias("n")).where((F.col("n") >= k) & (F.col("seen") >= SEEN * (k - 1)))
        out.append(best.join(sure.select("query"), "query", "left_semi"))
        asking = scratch.keep(asking.join(sure.select(F.col("query").alias("key")), "key", "left_anti").select(*placed.columns), "asking")
        if asking.isEmpty():
            break
        window *= WIDER
    return functools.reduce(DataFrame.unionAll, out)
