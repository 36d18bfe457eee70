"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources they belong to). A flow routes each
pattern's token capacity to the quotas of its sources; the k-th use of a pattern's tokens costs more than
the one before, so nothing repeats while fresh tokens are left. Within a pattern, every document takes the
whole uses, and a seeded prefix of the documents takes one more, cut where it comes nearest the flow.

The driver holds one row per pattern and solves the flow there; documents are only aggregated and joined
to it. The texts are read twice: for a narrow table of keys and sizes, and for the result. The seeded order is
never sorted as a whole: sums over 4,096 hash buckets find the bucket the cut falls into, and only that bucket's
keys are ordered. Null sources form a source of their own; a row without any source is a pattern without a quota
and takes nothing; documents without words are not used. Rows alike in the order's key are taken alike. Extra
columns pass through, but for columns of the results' names, which they replace.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, hidden, shown, word_count

#: More plan rows than this are joined by a shuffle instead of a broadcast; the result is the same.
BROADCAST_ROWS = 20_000


def share_out(total: float, weights: list[float], caps: list[float]) -> list[float]:
    """Shares of ``total`` by weight; what is above a cap is reshared by weight until none is above."""
    order = sorted(range(len(caps)), key=lambda i: (caps[i] / weights[i], i))
    left, weight, rate = total, float(sum(weights)), None
    for i in order:
        if left / weight <= caps[i] / weights[i]:
            rate = left / weight
            break
        left, weight = left - caps[i], weight - weights[i]
    return [c if rate is None else min(float(c), w * rate) for c, w in zip(caps, weights, strict=True)]


class Flow:
    """Successive shortest paths on a small graph with integer capacities and costs."""

    def __init__(self):
        self.to, self.cap, self.cost, self.out = [], [], [], defaultdict(list)

    def arc(self, a, b, cap: int, cost: int = 0) -> int:
        for u, v, c, k in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v), self.cap.append(c), self.cost.append(k)
        return len(self.to) - 2

    def run(self, source, sink) -> None:
        while True:
            dist, via, queue, queued = {source: 0}, {}, deque([source]), {source}
            while queue:
                u = queue.popleft()
                queued.discard(u)
                for e in self.out[u]:
                    v, d = self.to[e], dist[u] + self.cost[e]
                    if self.cap[e] > 0 and d < dist.get(v, float("inf")):
                        dist[v], via[v] = d, e
                        if v not in queued:
                            queue.append(v)
                            queued.add(v)
            if sink not in via:
                return
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push

    def flow(self, e: int) -> int:
        return self.cap[e ^ 1]


def route(patterns: dict[tuple, int], quotas: dict, repeats: int) -> dict[tuple, int]:
    """Tokens taken of each pattern (a tuple of sources) with ``patterns`` tokens, so that the quotas are met
    as far as the patterns allow, at the least sum of repetition costs 0, 1, 4, 9, ... a token."""
    net, arcs = Flow(), defaultdict(list)
    for p, size in patterns.items():
        for k in range(repeats):
            arcs[p].append(net.arc("from", ("p", p), size, k * k))
        for s in p:
            net.arc(("p", p), ("s", s), size * repeats)
    for s, quota in quotas.items():
        net.arc(("s", s), "to", int(quota))
    net.run("from", "to")
    return {p: sum(net.flow(e) for e in es) for p, es in arcs.items()}


def mix(df: DataFrame, sources: Column, order_key: Column, weights: tuple = (5, 2, 1), share: float = 1.5, repeats: int = 2, prefix: str = "") -> DataFrame:
    """df with pattern (JSON), size, source_size and target (summed over the row's sources), uses and taken
    (their names after ``prefix``, in place of columns of those names).

    ``sources``: array of source names; ``order_key``: a hexadecimal digest that seeds the order within a
    pattern. Sources weigh ``weights`` in code-point order, repeating, null last.
    """
    spark = df.sparkSession
    sized = df.select(*hidden(df), word_count(F.col("text")).alias("size"), F.array_sort(F.array_distinct(sources)).alias("_set"), order_key.alias("_key"))
    sized = sized.withColumn("pattern", F.to_json(F.struct(F.col("_set").alias("s")))).withColumn("_bucket", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))
    narrow = Scratch(spark, "mix").keep(sized.select("_set", "pattern", "_bucket", "_key", "size"), "sizes")
    sums = narrow.groupBy("pattern", "_bucket").agg(F.first("_set").alias("_set"), F.sum("size").alias("n"))
    rows = sums.groupBy("pattern").agg(F.first("_set").alias("s"), F.sum("n").alias("n")).collect()
    patterns = {tuple(r["s"]): int(r["n"]) for r in rows}
    names = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    held = {s: sum(n for p, n in patterns.items() if s in p) for s in names}
    caps = [float(repeats * held[s]) for s in names]
    goal = dict(zip(names, share_out(share * sum(patterns.values()), [float(weights[i % len(weights)]) for i in range(len(names))], caps), strict=True))
    taken = route(patterns, goal, repeats)
    plan = [
        (r["pattern"], sum(held[s] for s in r["s"]), float(sum(goal[s] for s in r["s"])), taken[tuple(r["s"])] // max(1, r["n"]), taken[tuple(r["s"])] % max(1, r["n"]))
        for r in rows
    ]
    plan = spark.createDataFrame(plan, "pattern string, source_size long, target double, whole long, rest long")
    small = len(rows) <= BROADCAST_ROWS
    plan = F.broadcast(plan) if small else plan
    # The bucket in which the running sum passes the rest, and the last key of it whose place is nearer below.
    by = Window.partitionBy("pattern").orderBy("_bucket")
    cuts = sums.withColumn("upto", F.sum("n").over(by)).join(plan.select("pattern", "rest"), "pattern").where("upto > rest")
    cuts = cuts.groupBy("pattern", "rest").agg(F.min(F.struct("_bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("cut"))
    cuts = cuts.select("pattern", "rest", "cut.*")
    inside = Window.partitionBy("pattern").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = narrow.join(F.broadcast(cuts) if small else cuts, ["pattern", "_bucket"]).groupBy("pattern", "rest", "before", "_key").agg(F.sum("size").alias("size"))
    near = keys.withColumn("upto", F.col("before") + F.sum("size").over(inside)).where("2 * upto - size <= 2 * rest")
    last = near.groupBy("pattern").agg(F.max("_key").alias("last"))
    cuts = cuts.select("pattern", F.col("_bucket").alias("cut")).join(last, "pattern", "left")
    told = sized.join(plan, "pattern").join(F.broadcast(cuts) if small else cuts, "pattern", "left")
    more = (F.col("_bucket") < F.col("cut")) | ((F.col("_bucket") == F.col("cut")) & (F.col("_key") <= F.col("last")))
    uses = F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")
    out = told.withColumn("uses", F.when(F.col("size") > 0, uses).otherwise(0)).withColumn("taken", F.col("uses") * F.col("size"))
    made = ("pattern", "size", "source_size", "target", "uses", "taken")
    return out.select(*shown(df, tuple(prefix + m for m in made)), *[F.col(m).alias(prefix + m) for m in made])


def seeded_key(seed: int = 0) -> Column:
    """A digest of seed, doc_id and text: the order in which documents are taken."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))))
