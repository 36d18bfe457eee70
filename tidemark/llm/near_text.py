"""MinHash near-dedup by an LSH forest.

Texts with equal shingle sets form one node. Each of TREES trees orders the nodes by DEPTH MinHash values of its
own, compared from the first: one range-partitioned sort of all trees. A node's neighbours in an order have the
longest common prefix with it, so depth follows the region: up to DEPTH values where it is crowded, BASE at
least where it is sparse. Nodes that share BASE values with neither neighbour of an order are left out of it.

1. Candidates are the REACH next nodes of an order that have another label: first of FIRST trees, where each
   node is its own label, which joins up groups of copies; then of all trees, with the components so far as
   labels, so that each component meets its nearest neighbours outside it, at whatever depth they are.
2. What shares BASE values and is still not in one component is compared in memory, never as pairs: small
   regions whole, several to a tile of about BLOCK nodes; crowded ones in tiles of two blocks. A tile tells each
   node's best candidate, which is confirmed; then the nodes that still have candidates bring their full sets and
   their components are joined exactly. A task gives at most a row a node.

Links are confirmed on full sets. A candidate is left unconfirmed only if the sizes rule the similarity out or
the VALUES MinHash values agree in under KEEP places: at similarity 0.8 eight standard deviations below, a
chance of 1e-13. At similarity 0.8 a pair shares BASE values in one of the trees with probability
1 - (1 - 0.8^5)^20 = 0.9997; every such pair is compared unless one component holds both by then.

A null, empty or blank text has an empty set and is linked with nothing. Equal doc_ids are told apart by
their sets; components take the least non-null doc_id. Extra columns pass through ``dedup``; of rows alike in
doc_id and text it keeps the one whose columns have the least hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, hidden, partitions_for, shown
from tidemark.llm.components import connected_components
from tidemark.llm.shingles import min_hashes, shingle_sets

TREES, DEPTH, BASE, FIRST, REACH, BLOCK = 20, 8, 5, 4, 2, 1024
VALUES, KEEP = TREES * DEPTH, 88
PERCENT = 80


def _digest(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def _signed(df: DataFrame, k: int) -> DataFrame:
    """(doc_id, at: hash of the text, node: digest of the set or null, n: its size, sig: MinHash values, each as
    four bytes from the highest, so that bytes sort as values do)."""

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column("text"), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = min_hashes([sets[i] for i in full], VALUES).astype(">u4")
            sizes = np.zeros(len(sets) + 1, dtype=np.int32)
            sizes[1:][full] = 4 * VALUES
            cols = [
                b.column("doc_id"),
                b.column("at"),
                pa.array([_digest(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.BinaryArray.from_buffers(pa.binary(), len(sets), [None, pa.py_buffer(np.cumsum(sizes, dtype=np.int32)), pa.py_buffer(sig.tobytes())]),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "at", "node", "n", "sig"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.xxhash64("text").alias("at"), "text").mapInArrow(run, f"doc_id {kind}, at long, node binary, n long, sig binary")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, items) of (text): the full sets."""

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column("text"), k)
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "items"])

    return docs.select("text").mapInArrow(run, "node binary, items array<long>")


def _fits(a, b):
    """The sizes allow the similarity."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _bytes(col: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """[rows, width] of a column of binaries of one width."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _agreeing(batches):
    """The pairs whose MinHash values agree in KEEP places."""
    for b in batches:
        x, y = (_bytes(b.column(c), 4 * VALUES).view(np.uint32) for c in ("siga", "sigb"))
        yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= KEEP))


def _confirmed(scratch: Scratch, df: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Those of the candidates (a, b) whose full sets are similar enough."""
    side = lambda t, c, v: t.select(F.col("node").alias(c), F.col(v).alias(f"{v}{c}"))
    near = pairs.join(side(nodes, "a", "sig"), "a").join(side(nodes, "b", "sig"), "b").select("a", "b", "siga", "sigb")
    near = scratch.keep(near.mapInArrow(_agreeing, "a binary, b binary"), "near")
    items = _items(scratch, df, nodes, near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), k)
    both = F.size(F.array_intersect("itemsa", "itemsb"))
    told = near.join(side(items, "a", "items"), "a").join(side(items, "b", "items"), "b")
    links = scratch.keep(told.where(100 * both >= PERCENT * (F.size("itemsa") + F.size("itemsb") - both)).select("a", "b"), "links")
    scratch.drop(near, items)
    return links


def _items(scratch: Scratch, df: DataFrame, nodes: DataFrame, used: DataFrame, k: int) -> DataFrame:
    """(node, items): the full sets of the nodes in ``used``, once each."""
    ids = nodes.join(used, "node").select(F.col("doc_id").alias("_id")).distinct()
    # Rows that share a doc_id also give sets that nobody asked for.
    items = _sets(df.join(ids, df["doc_id"].eqNullSafe(F.col("_id"))).select("text"), k).where("node is not null")
    return scratch.keep(items.groupBy("node").agg(F.first("items").alias("items")), "items")


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows in runs, in the order of (tree, key, node)."""
    by = ["tree", "key", "node"]
    return rows.repartitionByRange(partitions_for(rows.sparkSession), *by).sortWithinPartitions(*by)


def _alike(t: pa.Table, gap: int) -> np.ndarray:
    """Whether the row ``gap`` places on shares BASE values, for each row that has one."""
    key, tree = _bytes(t.column("key"), 4 * DEPTH)[:, : 4 * BASE], np.asarray(t.column("tree"))
    return (key[gap:] == key[:-gap]).all(axis=1) & (tree[gap:] == tree[:-gap])


def _met(batches):
    """The rows of a sorted run that share BASE values with the one before or after; and the run's first and
    last, whose neighbours may be in another run."""
    held, before = None, True
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [held, b])
        same = _alike(t, 1) if len(t) > 1 else np.zeros(0, dtype=bool)
        meets = np.concatenate([[before], same[:-1]]) | same if len(same) else same
        yield from t.slice(0, len(meets)).filter(pa.array(meets, pa.bool_())).combine_chunks().to_batches()
        held, before = t.slice(len(t) - 1).combine_chunks().to_batches()[0] if len(t) else None, bool(same[-1]) if len(same) else before
    if held is not None:
        yield held


def _beside(batches):
    """(a, b) of each row of a sorted run with the REACH next ones that share BASE values, have another label
    and a size that allows the similarity."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [held, b])
        node, label, n = t.column("node").combine_chunks(), t.column("label").to_pylist(), np.asarray(t.column("n"))
        code = np.unique(np.array([x.hex() for x in label]), return_inverse=True)[1]
        new = 0 if held is None else len(held)
        for gap in range(1, min(REACH, len(t) - 1) + 1):
            least, most = np.minimum(n[gap:], n[:-gap]), np.maximum(n[gap:], n[:-gap])
            at = np.flatnonzero(_alike(t, gap) & (code[gap:] != code[:-gap]) & (100 * least >= PERCENT * most))
            at = at[at + gap >= new]
            yield pa.RecordBatch.from_arrays([node.take(pa.array(at)), node.take(pa.array(at + gap))], names=["a", "b"])
        held = t.slice(max(0, len(t) - REACH)).combine_chunks().to_batches()[0] if len(t) else held


def _orders(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """(tree, key, node, n): all trees' sorted orders of the nodes that have a neighbour there."""
    part = lambda t: F.struct(t.alias("tree"), F.substring("sig", t * (4 * DEPTH) + 1, F.lit(4 * DEPTH)).alias("key"))
    rows = nodes.select("node", "n", F.inline(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), part))).select("tree", "key", "node", "n")
    return scratch.keep(_sorted(rows).mapInArrow(_met, "tree int, key binary, node binary, n long"), "orders")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _candidates(orders: DataFrame, labels: DataFrame | None) -> DataFrame:
    pairs = _sorted(_labelled(orders, labels)).select("tree", "key", "node", "n", "label").mapInArrow(_beside, "a binary, b binary")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _tiles(scratch: Scratch, orders: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(tile, i, j, region, block, node, label) of the regions at BASE that hold more than one component. Small
    regions share a tile, with i and j -1; of crowded ones each two blocks i and j of several components do."""
    region = F.xxhash64("tree", F.substring("key", 1, 4 * BASE)).alias("region")
    rows = scratch.keep(_labelled(orders.select(region, "node"), labels), "rows")
    own = scratch.keep(rows.groupBy("region", "label").agg(F.count("*").alias("c")), "own")
    mixed = own.groupBy("region").agg(F.sum("c").alias("m"), F.count("*").alias("k")).where("k > 1").drop("k")
    held = scratch.keep(rows.join(own.join(mixed, "region"), ["region", "label"]), "held")
    small, crowded = held.where(F.col("m") <= BLOCK), held.where(F.col("m") > BLOCK)
    buckets = max(1, small.count() // BLOCK)
    none = F.lit(-1).cast("long")
    few = small.select(F.pmod(F.xxhash64("region"), F.lit(buckets).cast("long")).alias("tile"), none.alias("i"), none.alias("j"), "region", none.alias("block"), "node", "label")
    alone = F.xxhash64("label", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / BLOCK)))
    block = F.when(F.col("c") > BLOCK, alone).otherwise(F.pmod(F.xxhash64("label"), F.ceil(F.col("m") / BLOCK)))
    placed = scratch.keep(crowded.select("region", block.alias("block"), "node", "label"), "placed")
    span = scratch.keep(placed.groupBy("region", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "span")
    side = lambda c, lo, hi: span.select("region", F.col("block").alias(c), F.col("lo").alias(lo), F.col("hi").alias(hi))
    two = side("i", "lo", "hi").join(side("j", "lo2", "hi2"), "region").where((F.col("i") <= F.col("j")) & (F.least("lo", "lo2") != F.greatest("hi", "hi2")))
    each = two.select("region", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    many = each.join(placed, ["region", "block"]).select(F.col("region").alias("tile"), "i", "j", "region", "block", "node", "label")
    return scratch.keep(few.unionAll(many), "tiles")


_TILE = ["tile", "i", "j"]


def _compared(mode: str):
    """For a tile, (a, b, agree) by mode: ``best`` candidate b of each node a, ``any`` node a that has one,
    or the ``links`` between components that join them up."""

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("region")
        keys, n, block, region = t.column("node").to_pylist(), *(np.asarray(t.column(c)) for c in ("n", "block", "region"))
        sig = _bytes(t.column("sig"), 4 * VALUES).view(np.uint32)
        label = np.unique(np.array([x.hex() for x in t.column("label").to_pylist()]), return_inverse=True)[1]
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        last = np.searchsorted(region, region, side="right")
        right = np.flatnonzero(block == j)
        if mode == "links":
            items = t.column("items").combine_chunks()
            code = np.unique(items.flatten().to_numpy(), return_inverse=True)[1]
            ends = np.cumsum([0] + [len(x) for x in items])
            sets, mark = [code[b:e] for b, e in zip(ends, ends[1:], strict=False)], np.zeros(len(code), dtype=bool)
        best, other, found = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64), []
        for r in np.flatnonzero(block == i):
            at = np.arange(r + 1, last[r]) if i == j else right
            at = at[(label[at] != label[r]) & (100 * np.minimum(n[at], n[r]) >= PERCENT * np.maximum(n[at], n[r]))]
            if not len(at):
                continue
            agree = (sig[at] == sig[r]).sum(axis=1)
            at, agree = at[agree >= KEEP], agree[agree >= KEEP]
            if not len(at):
                continue
            if mode != "links":
                up = agree > best[at]
                best[at[up]], other[at[up]] = agree[up], r
                if agree.max() > best[r]:
                    best[r], other[r] = agree.max(), at[agree.argmax()]
                continue
            mark[sets[r]] = True
            starts = np.cumsum([0] + [len(sets[x]) for x in at[:-1]])
            both = np.add.reduceat(mark[np.concatenate([sets[x] for x in at])].astype(np.int64), starts)
            mark[sets[r]] = False
            for x in at[100 * both >= PERCENT * (n[at] + n[r] - both)]:
                if label[x] != label[r]:
                    found.append((r, x, 0))
                    label[label == label[x]] = label[r]
        if mode != "links":
            found = [(a, other[a], best[a]) for a in np.flatnonzero(best)]
        a, b, agree = zip(*found, strict=True) if found else ((), (), ())
        out = {"a": pa.array([keys[x] for x in a], pa.binary()), "b": pa.array([keys[x] for x in b], pa.binary()), "agree": pa.array(agree, pa.int64())}
        if mode == "any":
            out |= {c: pa.array(np.asarray(t.column(c))[list(a)], pa.int64()) for c in (*_TILE, "region", "block")}
        return pa.table(out)

    return compare


def _joined(scratch: Scratch, df: DataFrame, nodes: DataFrame, orders: DataFrame, links: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """The labels after all pairs that share BASE values and are not in one component are compared."""
    row, known = "a binary, b binary, agree long", nodes.select("node", "n", "sig")
    tiles = _tiles(scratch, orders, labels)
    best = tiles.join(known, "node").groupBy(*_TILE).applyInArrow(_compared("best"), row)
    best = best.groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("b"))
    pairs = scratch.keep(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    if pairs.isEmpty():
        return labels
    links = links.unionAll(_confirmed(scratch, df, nodes, pairs, k))
    labels = scratch.keep(connected_components(scratch, links), "labels")
    scratch.drop(tiles)
    tiles = _tiles(scratch, orders, labels)
    left = tiles.join(known, "node").groupBy(*_TILE).applyInArrow(_compared("any"), f"{row}, tile long, i long, j long, region long, block long")
    left = scratch.keep(left.select(*_TILE, "region", "block", F.col("a").alias("node")), "left")
    items = _items(scratch, df, nodes, left.select("node").distinct(), k)
    full = left.join(tiles, [*_TILE, "region", "block", "node"]).join(known, "node").join(items, "node")
    new = scratch.keep(full.groupBy(*_TILE).applyInArrow(_compared("links"), row).select("a", "b"), "links")
    return labels if new.isEmpty() else scratch.keep(connected_components(scratch, links.unionAll(new)), "labels")


def components(df: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, at, n_shingles, component_id, kept) for each row of df (doc_id, text), with k words a shingle;
    ``at`` is the text's xxhash64."""
    scratch, df = Scratch(df.sparkSession, "forest"), df.select("doc_id", "text")
    signed = scratch.keep(_signed(df, k), "signed")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = scratch.keep(nodes, "nodes")
    orders = _orders(scratch, nodes)
    pairs = scratch.keep(_candidates(orders.where(F.col("tree") < FIRST), None), "pairs")
    links = _confirmed(scratch, df, nodes, pairs, k)
    labels = scratch.keep(connected_components(scratch, links), "labels")
    more = scratch.keep(_candidates(orders, labels).join(pairs, ["a", "b"], "left_anti"), "pairs")
    links = links.unionAll(_confirmed(scratch, df, nodes, more, k))
    labels = _joined(scratch, df, nodes, orders, links, scratch.keep(connected_components(scratch, links), "labels"), k)
    known = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = scratch.keep(known, "known")
    least = known.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = scratch.keep(known.join(least, "label").select("node", "component_id"), "of")
    scratch.drop(*[t for _, t in list(scratch.paths.values()) if t is not signed and t is not of])
    out = signed.select("doc_id", "at", "node", F.col("n").alias("n_shingles")).join(of, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "at", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(df: DataFrame, k: int = 5) -> DataFrame:
    """df less all but one document of each component: the one whose doc_id is the component's; once, if repeated."""
    kept = components(df, k).where("kept").select(F.col("doc_id").alias("_tm_id"), F.col("at").alias("_tm_at")).distinct()
    rows = df.select(F.struct(*hidden(df)).alias("_tm_row"), F.col("doc_id").alias("_tm_doc"), F.xxhash64("text").alias("_tm_text"))
    same = F.col("_tm_id").eqNullSafe(F.col("_tm_doc")) & F.col("_tm_at").eqNullSafe(F.col("_tm_text"))
    out = rows.join(kept, same).groupBy("_tm_id", "_tm_at").agg(F.min_by("_tm_row", F.xxhash64("_tm_row")).alias("_tm_row"))
    return out.select("_tm_row.*").select(*shown(df))
