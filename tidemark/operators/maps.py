"""Correspondence maps coded against an enumeration: what a join of old and new units leaves to say, and its replay.

Coding is relational: a unit is expected to come from the old unit that follows the last one's source among
those that are used at all, so ranks of used units turn the expectation into a lag and a join. The replay
depends on what came before only where an exception stands: a Python group sees a section's exceptions, inserts and
drops; units, sizes and offsets are joins and prefix sums.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALIGNMENTS = (1, 2, 4, 8, 16, 32, 64)


def up(v: Column, a: Column | int) -> Column:
    """v rounded up to a multiple of a."""
    return v + F.pmod(-v, F.lit(a) if isinstance(a, int) else a)


def _ends(units: DataFrame, by: list[str]) -> DataFrame:
    """units (ord, off, size) with _end: where the unit before ends, 0 before the first."""
    before = F.lag(F.col("off") + F.col("size")).over(Window.partitionBy(*by).orderBy("ord"))
    return units.withColumn("_end", F.coalesce(before, F.lit(0).cast("long")))


def best_alignment(units: DataFrame, by: list[str], alignments: tuple = ALIGNMENTS) -> DataFrame:
    """(by.., alignment, hits): the alignment to which most units (ord, off, size) follow the end of the one before;
    the first of the best."""
    hits = [F.sum((F.col("off") == up(F.col("_end"), a)).cast("long")).alias(f"h{a}") for a in alignments]
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"h{a}")).alias("m"), F.lit(i).alias("i"), F.lit(a).cast("long").alias("a")) for i, a in enumerate(alignments)]))
    best = _ends(units, by).groupBy(*by).agg(*hits).withColumn("_b", ranked[0])
    return best.select(*by, F.col("_b.a").alias("alignment"), (-F.col("_b.m")).alias("hits"))


def encode(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """(by.., part, ord, value) of old units (ord from 0, size) and new ones (ord from 0, off, size, src: ordinal of the
    old unit, or null). Parts: ``units``, how many; ``drop``, length of a run of unused old units from ord;
    ``insert``, size of a unit without a source; ``order``, source less the expected one; ``size``, against the
    source's; ``align``; ``fix``, offset less the aligned end of the unit before."""
    used = new.where("src is not null").select(*by, F.col("src").alias("ord")).distinct().withColumn("_u", F.lit(True))
    section = Window.partitionBy(*by).orderBy("ord")
    marked = old.join(used, [*by, "ord"], "left").withColumn("_u", F.coalesce("_u", F.lit(False)))
    rank = F.sum(F.col("_u").cast("long")).over(section.rowsBetween(Window.unboundedPreceding, 0)) - 1
    marked = marked.withColumn("_rank", rank)
    drops = marked.where("not _u").groupBy(*by, "_rank").agg(F.min("ord").alias("ord"), F.count("*").alias("value"))
    kept = marked.where("_u")
    sources = kept.select(*by, F.col("ord").alias("src"), "_rank", F.col("size").alias("_old"))
    matched = new.join(sources, [*by, "src"])
    matched = matched.withColumn("_next", F.coalesce(F.lag("_rank").over(section) + 1, F.lit(0).cast("long")))
    cursor = kept.select(*by, F.col("_rank").alias("_next"), F.col("ord").alias("_cursor"))
    total = old.groupBy(*by).agg(F.count("*").alias("_n"))
    matched = matched.join(cursor, [*by, "_next"], "left").join(total, by).withColumn("_cursor", F.coalesce("_cursor", "_n"))
    placed = _ends(new, by).join(best_alignment(new, by), by)
    fix = F.col("off") - up(F.col("_end"), F.col("alignment"))
    part = lambda df, name, value: df.select(*by, F.lit(name).alias("part"), "ord", value.cast("long").alias("value"))
    zero = F.lit(0).cast("long").alias("ord")
    parts = [
        new.groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.lit("units").alias("part"), zero, F.col("n").alias("value")),
        best_alignment(new, by).select(*by, F.lit("align").alias("part"), zero, F.col("alignment").alias("value")),
        part(drops, "drop", F.col("value")),
        part(new.where("src is null"), "insert", F.col("size")),
        part(matched.where("src <> _cursor"), "order", F.col("src") - F.col("_cursor")),
        part(matched.where("size <> _old"), "size", F.col("size") - F.col("_old")),
        part(placed.where(fix != 0), "fix", fix),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _sources(n: int, kept: np.ndarray, inserted: np.ndarray, order: dict[int, int], total: int) -> np.ndarray:
    """The source of each of n new units, -1 for inserted ones: the rule for one section in memory."""
    src, at = np.full(n, -1), np.setdiff1d(np.arange(n), inserted)
    where = np.searchsorted(at, sorted(order))
    if order and (len(at) == 0 or (at[np.minimum(where, len(at) - 1)] != sorted(order)).any()):
        raise ValueError("an order exception names a unit without a source")
    rank, cuts = 0, [*where.tolist(), len(at)]
    src[at[: cuts[0]]] = kept[: cuts[0]] if cuts[0] <= len(kept) else _fail("more units than sources")
    rank = cuts[0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        want = (kept[rank] if rank < len(kept) else total) + order[int(at[a])]
        rank = int(np.searchsorted(kept, want))
        if rank + b - a > len(kept) or kept[rank] != want:
            raise ValueError("an order exception names a missing old unit")
        src[at[a:b]] = kept[rank : rank + b - a]
        rank += b - a
    return src


def _fail(why: str):
    raise ValueError(why)


def _offsets(size: np.ndarray, a: int, fix: dict[int, int]) -> np.ndarray:
    """Where units of these sizes lie: each at the aligned end of the one before, plus its fix; one section in memory."""
    n, off, end = len(size), np.zeros(len(size), dtype=np.int64), 0
    wide = -(-size // a) * a
    for b, e in zip([0, *sorted(f for f in fix if f)], [*sorted(f for f in fix if f), n], strict=True):
        if b == e:
            continue
        off[b] = -(-end // a) * a + fix.get(b, 0)
        rest = -(-(off[b] + size[b]) // a) * a
        off[b + 1 : e] = rest + np.cumsum(np.concatenate([[0], wide[b + 1 : e - 1]])) if e > b + 1 else 0
        end = int(off[e - 1] + size[e - 1])
    if n and off.min() < 0:
        raise ValueError("the layout underflows")
    return off


_CHAIN = {"units": 0, "drop": 1, "insert": 2, "order": 3, "total": 4}


def _steps(kind: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ord, step) of a section's order exceptions: from there on a unit's source is the kept old unit of rank step plus
    the number of units with a source before it. Rows of the parts in _CHAIN."""

    def part(name: str) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(kind == _CHAIN[name])
        own = own[np.argsort(at[own], kind="stable")]
        return at[own], value[own]

    order, by = part("order")
    inserts, (starts, runs), n, total = part("insert")[0], part("drop"), value[kind == _CHAIN["units"]].sum(), int(value[kind == _CHAIN["total"]].sum())
    place = np.searchsorted(inserts, order)
    if len(order) and (order[-1] >= n or order[0] < 0 or np.isin(order, inserts).any()):
        raise ValueError("an order exception names a unit without a source")
    gone = np.concatenate([[0], np.cumsum(runs)])
    kept, starts, ends, before, gone = total - int(gone[-1]), *(memoryview(np.ascontiguousarray(x, dtype=np.int64)) for x in (starts, starts + runs, starts - gone[:-1], gone))
    steps, step = np.zeros(len(order), dtype=np.int64), 0
    for k, (p, d) in enumerate(zip(memoryview(np.ascontiguousarray(order - place)), memoryview(np.ascontiguousarray(by)), strict=True)):
        rank = step + p
        want = (rank + gone[bisect.bisect_right(before, rank)] if rank < kept else total) + d
        j = bisect.bisect_right(starts, want)
        if not 0 <= want < total or (j and want < ends[j - 1]):
            raise ValueError("an order exception names a missing old unit")
        steps[k] = step = want - gone[j] - p
    return order, steps


def replay(old: DataFrame, coded: DataFrame, by: list[str]) -> DataFrame:
    """(by.., ord, off, size, src) of the new units: the inverse of encode. An aligned end is the sum of the aligned
    (fix plus size) before it, so offsets are one prefix sum."""
    kinds = ", ".join(f"{c} {old.schema[c].dataType.simpleString()}" for c in by)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _CHAIN.items() for x in kv]), F.col("part")).cast("byte")
    chain = coded.where(F.col("part").isin(*_CHAIN)).select(*by, kind.alias("part"), "ord", "value")
    totals = old.groupBy(*by).agg(F.count("*").alias("value")).select(*by, F.lit(_CHAIN["total"]).cast("byte").alias("part"), F.lit(0).cast("long").alias("ord"), "value")

    def section(c: pd.DataFrame) -> pd.DataFrame:
        at, steps = _steps(c["part"].to_numpy(), c["ord"].to_numpy(), c["value"].to_numpy())
        return pd.DataFrame({**{k: np.repeat(c[k].to_numpy()[:1], len(at)) for k in by}, "part": "step", "ord": at, "value": steps})

    steps = chain.unionAll(totals).groupBy(*by).applyInPandas(section, f"{kinds}, part string, ord long, value long")
    units = coded.where("part = 'units' and value > 0").select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("value") - 1)).alias("ord"))
    names = ("insert", "size", "fix", "step")
    wide = coded.where(F.col("part").isin(*names)).unionByName(steps).groupBy(*by, "ord").agg(*[F.max(F.when(F.col("part") == n, F.col("value"))).alias(f"_{n}") for n in names])
    align = coded.where("part = 'align'").select(*by, F.col("value").alias("_a"))
    told = units.join(wide, [*by, "ord"], "left").join(F.broadcast(align), by, "left")
    upto = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    sourced = F.col("_insert").isNull()
    rank = F.sum(sourced.cast("long")).over(upto) - 1 + F.coalesce(F.last("_step", ignorenulls=True).over(upto), zero)
    told = told.withColumn("_rank", F.when(sourced, rank))
    gone = coded.where("part = 'drop'").select(*by, F.explode(F.sequence("ord", F.col("ord") + F.col("value") - 1)).alias("ord"))
    kept = old.select(*by, "ord", "size").join(gone, [*by, "ord"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("ord")).cast("long") - 1
    kept = kept.select(*by, place.alias("_rank"), F.col("ord").alias("src"), F.col("size").cast("long").alias("_was"))
    told = told.join(kept, [*by, "_rank"], "left")
    known = lambda ok, c, why: F.when(ok, c).otherwise(F.raise_error(F.lit(why)).cast("long"))
    size = F.coalesce("_was", zero) + F.coalesce("_insert", zero) + F.coalesce("_size", zero)
    told = told.withColumn("size", known(F.col("_insert").isNotNull() | F.col("src").isNotNull(), size, "more units than sources"))
    fix = F.coalesce("_fix", zero)
    end = up(fix + F.col("size"), F.coalesce("_a", F.lit(16).cast("long")))
    told = told.withColumn("off", F.sum(end).over(upto) - end + fix)
    return told.select(*by, "ord", known(F.col("off") >= 0, F.col("off"), "the layout underflows").alias("off"), known(F.col("size") >= 0, F.col("size"), "a size underflows").alias("size"), "src")
