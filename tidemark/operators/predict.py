"""Predicting the new version from the old one: layouts, relays and remapped references."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import align
from tidemark.operators.lookup import asof, bucket, spread


def section_pairing(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, old_off, new_off, size): sections of one name, over the smaller size; each name once a side."""
    a, b = old.select("name", F.col("off").alias("old_off"), F.col("size").alias("_o")), new.select("name", F.col("off").alias("new_off"), F.col("size").alias("_n"))
    return a.join(b, "name").select("name", "old_off", "new_off", F.least("_o", "_n").alias("size"))


def source_extents(starts: DataFrame, by: list[str]) -> DataFrame:
    """(by.., start, end): each distinct start up to the next; the last ends nowhere (null)."""
    distinct = starts.select(*by, "start").distinct()
    return distinct.withColumn("end", F.lead("start").over(Window.partitionBy(*by).orderBy("start")))


def derive_enumeration(sets: list[DataFrame], by: list[str]) -> DataFrame:
    """(by.., v, idx): the distinct values of all sets, numbered in order from 0."""
    every = sets[0].select(*by, "v")
    for s in sets[1:]:
        every = every.unionAll(s.select(*by, "v"))
    return every.distinct().withColumn("idx", F.row_number().over(Window.partitionBy(*by).orderBy("v")).cast("long") - 1)


def target_index(probes: DataFrame, targets: DataFrame, by: list[str], at: str = "addr") -> DataFrame:
    """probes with idx of the last enumerated target (v, idx) at or before the address; -1 before the first."""
    got = asof(probes, targets.select(*by, F.col("v").alias("pos"), "idx"), by, at, ["idx"])
    return got.withColumn("idx", F.coalesce("idx", F.lit(-1).cast("long")))


def file_offset_remap(refs: DataFrame, old_files: DataFrame, new_files: DataFrame, none: int = 0xFFFFFFFF) -> DataFrame:
    """refs (id, off) with new_off: the offset of the same file name in the new table, at its first occurrence by ord;
    unknown names and ``none`` keep their value. Files are (ord, name, off)."""
    name = old_files.groupBy("off").agg(F.min_by("name", "ord").alias("name"))
    first = new_files.groupBy("name").agg(F.min_by("off", "ord").alias("_new"))
    got = refs.join(name, "off", "left").join(first, "name", "left")
    return got.select("id", "off", F.when(F.col("off") == none, F.col("off")).otherwise(F.coalesce("_new", "off")).alias("new_off"))


def grouped_first_use(uses: DataFrame, by: list[str]) -> DataFrame:
    """(by.., align, content, offset): contents in order of first use within regions of one alignment, which follow
    each other by alignment; each region starts at a multiple of its own."""
    first = uses.groupBy(*by, "align", "content").agg(F.min("ord").alias("_o"), F.first("len").alias("_l"))
    inside = Window.partitionBy(*by, "align").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    placed = first.withColumn("_in", F.sum("_l").over(inside) - F.col("_l"))
    sizes = placed.groupBy(*by, "align").agg(F.sum("_l").alias("_n"))
    # A region's start depends on all before it; there are a few alignments a section.
    listed = sizes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("align", "_n"))).alias("_all"))
    up = lambda v, a: v + F.pmod(-v, a)
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<align:bigint,start:bigint>>").alias("starts"))
    step = lambda acc, r: F.struct((up(acc["end"], r["align"]) + r["_n"]).alias("end"), F.concat(acc["starts"], F.array(F.struct(r["align"].alias("align"), up(acc["end"], r["align"]).alias("start")))).alias("starts"))
    starts = listed.select(*by, F.inline(F.aggregate("_all", zero, step, lambda acc: acc["starts"])))
    return placed.join(starts, [*by, "align"]).select(*by, "align", "content", (F.col("start") + F.col("_in")).alias("offset"))


def fix_blocks(blocks: DataFrame, votes: DataFrame, by: list[str]) -> DataFrame:
    """blocks (ord, delta, matched, ambiguous) with fixed: for a block that no content matched, the shift with over
    half of its vote weight (votes: ord, shift, weight); then, in sections with such a fix, plain unmatched blocks
    take the last matched or fixed shift. Ambiguous blocks stay."""
    each = votes.groupBy(*by, "ord", "shift").agg(F.sum("weight").alias("w"))
    best = each.groupBy(*by, "ord").agg(F.max(F.struct("w", "shift")).alias("b"), F.sum("w").alias("all"))
    won = best.where(2 * F.col("b.w") > F.col("all")).select(*by, "ord", F.col("b.shift").alias("_won"))
    told = blocks.join(won, [*by, "ord"], "left").withColumn("_won", F.when(~F.col("matched"), F.col("_won")))
    section = Window.partitionBy(*by)
    upto = section.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    sure = F.when(F.col("matched"), F.col("delta")).otherwise(F.col("_won"))
    told = told.withColumn("_last", F.last(sure, ignorenulls=True).over(upto)).withColumn("_any", F.count("_won").over(section) > 0)
    plain = F.col("_any") & ~F.col("matched") & ~F.col("ambiguous")
    fixed = F.when(F.col("_won").isNotNull(), F.col("_won")).when(plain, F.coalesce("_last", "delta")).otherwise(F.col("delta"))
    return told.withColumn("fixed", fixed).drop("_won", "_last", "_any")


def lay_image(cells: DataFrame, runs: DataFrame, old: DataFrame, by: list[str], fill: int = 0xCC) -> DataFrame:
    """cells (by.., pos) with got: the old value that the last run (by dst, then src) that covers it copies, else
    ``fill``, or 0 where cells have a column ``code`` that is false. Runs may overlap or nest."""
    side = spread(runs.select(*by, "src", "dst", "n"), "dst", F.col("dst") + F.col("n"))
    asked = cells.select(*by, "pos").distinct().withColumn("_b", bucket("pos"))
    met = asked.join(side, [*by, "_b"]).where((F.col("pos") >= F.col("dst")) & (F.col("pos") < F.col("dst") + F.col("n")))
    source = met.groupBy(*by, "pos").agg(F.max(F.struct("dst", "src")).alias("_r"))
    source = source.select(*by, "pos", (F.col("_r.src") + F.col("pos") - F.col("_r.dst")).alias("_at"))
    values = old.select(*by, F.col("pos").alias("_at"), F.col("value").alias("_v"))
    none = F.when(F.col("code"), F.lit(fill)).otherwise(0) if "code" in cells.columns else F.lit(fill)
    return cells.join(source, [*by, "pos"], "left").join(values, [*by, "_at"], "left").select(*by, "pos", F.coalesce("_v", none).alias("got"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b): rows left on each side when equal rows cancel; both 0 for equal multisets."""
    keys = a.columns
    both = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1))).groupBy(*keys).agg(F.sum("_s").alias("d"))
    side = lambda c: F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0)).cast("long")
    return both.agg(side(F.col("d")).alias("only_a"), side(-F.col("d")).alias("only_b"))


def disjoint_runs(runs: DataFrame, by: str) -> DataFrame:
    """(by, src, dst, n) made disjoint in src; a sweep, so one group is one section."""

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        out = align.remove_overlaps(list(zip(pdf.src, pdf.dst, pdf.n, strict=True)))
        return pd.DataFrame([(pdf[by].iloc[0], *r) for r in out], columns=[by, "src", "dst", "n"])

    return runs.select(by, "src", "dst", "n").groupBy(by).applyInPandas(sweep, f"{by} {runs.schema[by].dataType.simpleString()}, src long, dst long, n long")


#: Rows that one task of ``class_packs`` sorts, by estimate, and values of one pack.
SORTED, PACKED = 1 << 19, 1 << 16
#: Partitions up to which Spark writes a shuffle without sorting; past it a task holds its whole input split.
BYPASS = 200


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of (class, value) in order to (class, n, packed), in order within each class."""
    press, keys, values = zstandard.ZstdCompressor(level=1), [], []
    for batch in batches:
        keys.append(batch.column(0).dictionary_encode())
        values.append(np.array(batch.column(1).to_numpy()))  # an error of null values
    if not keys:
        return
    known = pa.chunked_array(keys).unify_dictionaries().combine_chunks()
    ids = known.indices.fill_null(-1).to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, own = ids[order], np.concatenate(values)[order]
    ends = [*np.flatnonzero(np.diff(ids)).tolist(), len(ids) - 1]
    cuts = [(k, min(k + PACKED, j + 1)) for i, j in itertools.pairwise([-1, *ends]) for k in range(i + 1, j + 1, PACKED)]
    name = known.dictionary.take(pa.array([int(ids[i]) if ids[i] >= 0 else None for i, _ in cuts], pa.int64()))
    packed = [press.compress(own[i:j].tobytes()) for i, j in cuts]
    yield pa.RecordBatch.from_arrays([name, pa.array([j - i for i, j in cuts], pa.int64()), pa.array(packed, pa.binary())], names=["by", "n", "packed"])


def _price(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Packs in order of class and place to (class, n, bytes); one compressor is alive at a time."""
    unpack, names, key, n, size, press = zstandard.ZstdDecompressor(), ["by", "n", "bytes"], None, 0, 0, None
    for batch in batches:
        keys, counts, packs = batch.columns
        done, kind = [], keys.type
        for i in range(len(batch)):
            name = keys[i].as_py()
            if press is None or name != key:
                if press is not None:
                    done.append((key, n, size + len(press.flush())))
                key, n, size, press = name, 0, 0, zstandard.ZstdCompressor(level=level).compressobj()
            n, size = n + counts[i].as_py(), size + len(press.compress(unpack.decompress(packs[i].as_buffer())))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (kind, pa.int64(), pa.int64()), strict=True)], names=names)
    if press is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([n], pa.int64()), pa.array([size + len(press.flush())], pa.int64())], names=names)


def class_packs(rows: DataFrame, by: str, value: str, most: int = SORTED) -> DataFrame:
    """(by, n, packed, place): each class's values in order of ``ord``, then value, in packs in order of place. The sort
    is by ranges of about ``most`` rows over all classes, four times as many in large tables: no task sorts a class's rows."""
    kind, n = rows.schema[by].dataType.simpleString(), rows.count()
    ranges = max(1, min(BYPASS, -(-n // most)), -(-n // (4 * most)))
    # Rows equal in class, ord and value are interchangeable: their place in the input spreads them over ranges.
    spread = (F.monotonically_increasing_id() % 1024).cast("short")
    plain = rows.select(F.col(by).alias("by"), "ord", F.col(value).cast("long").alias("v"), spread.alias("_i"))
    ordered = plain.repartitionByRange(ranges, "by", "ord", "v", "_i").sortWithinPartitions("ord", "v").select("by", "v")
    return ordered.mapInArrow(_pack, f"by {kind}, n long, packed binary").withColumn("place", F.monotonically_increasing_id())


def marginal_price(rows: DataFrame, by: str, value: str, level: int = 3, most: int = SORTED) -> DataFrame:
    """(by, n, bytes): what each class's values cost compressed together (zstd) in order of ``ord``, then value; null
    is a class, a null value is an error. Classes are compressed in parallel, and one class's packs stream through its
    compressor."""
    packs = class_packs(rows, by, value, most)
    streamed = packs.repartition(F.col("by")).sortWithinPartitions("by", "place").drop("place")
    return streamed.mapInArrow(lambda batches: _price(batches, level), f"by {rows.schema[by].dataType.simpleString()}, n long, bytes long").withColumnRenamed("by", by)


def drop_overlaps(bodies: DataFrame, section: str) -> DataFrame:
    """The bodies (section, idx, dst, size) that start at or past the end of the last one kept, by dst, then idx.

    Each choice depends on the one before, so a section is one group; sections share nothing.
    """

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["dst", "idx"], ignore_index=True)
        starts, ends = rows["dst"].to_numpy(), (rows["dst"] + rows["size"]).to_numpy()
        kept, at = [], 0
        while at < len(rows):
            kept.append(at)
            # Starts are sorted: the next one kept is the first at or past this end, and never this one again.
            at = max(at + 1, int(np.searchsorted(starts, ends[at], "left")))
        return rows.iloc[kept]

    return bodies.groupBy(section).applyInPandas(keep, bodies.schema)
