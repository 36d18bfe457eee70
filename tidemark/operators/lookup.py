"""Where did an old position go: interval, as-of and nearest lookups.

Positions belong to a section (``by``). Range conditions become equi-joins on (section, position div BUCKET),
so no section is one task and no join is a nested loop; only the last breakpoint of each bucket crosses
buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a bucket.
BUCKET = 4096


def bucket(c: Column | str) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / BUCKET).cast("long")


def spread(intervals: DataFrame, start: str, end: Column) -> DataFrame:
    """Each interval once for each bucket it touches."""
    return intervals.where(end > F.col(start)).withColumn("_b", F.explode(F.sequence(bucket(start), bucket(end - 1))))


def interval_lookup(probes: DataFrame, maps: DataFrame, by: list[str], at: str = "addr") -> DataFrame:
    """probes with target: through the map (src, src_size, dst, dst_size) that holds the address, if the place in
    it is below dst_size. Maps are disjoint."""
    side = spread(maps.select(*by, "src", "src_size", "dst", "dst_size"), "src", F.col("src") + F.col("src_size"))
    p = probes.withColumn("_b", bucket(at))
    cond = [F.col(f"p.{c}") == F.col(f"m.{c}") for c in [*by, "_b"]] + [F.col(at) >= F.col("src"), F.col(at) < F.col("src") + F.col("src_size")]
    got = p.alias("p").join(side.alias("m"), cond, "left")
    off = F.col(at) - F.col("src")
    return got.select("p.*", F.when(off < F.col("dst_size"), F.col("dst") + off).alias("target")).drop("_b")


def holding(probes: DataFrame, intervals: DataFrame, by: list[str], at: str, take: list[str]) -> DataFrame:
    """probes with the columns ``take`` of the interval [lo, hi) that holds the address; null outside all. Intervals are
    disjoint."""
    side = spread(intervals.select(*by, "lo", "hi", *take), "lo", F.col("hi"))
    p = probes.withColumn("_b", bucket(at))
    cond = [F.col(f"p.{c}") == F.col(f"i.{c}") for c in [*by, "_b"]] + [F.col(f"p.{at}") >= F.col("i.lo"), F.col(f"p.{at}") < F.col("i.hi")]
    return p.alias("p").join(side.alias("i"), cond, "left").select("p.*", *[F.col(f"i.{c}") for c in take]).drop("_b")


def overlaps(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of intervals [a_lo, a_hi) and [b_lo, b_hi) that overlap, each once: in the bucket where the overlap starts."""
    left, right = spread(a, "a_lo", F.col("a_hi")), spread(b, "b_lo", F.col("b_hi"))
    met = left.join(right, [*by, "_b"]).where((F.col("a_lo") < F.col("b_hi")) & (F.col("b_lo") < F.col("a_hi")))
    return met.where(F.col("_b") == bucket(F.greatest("a_lo", "b_lo"))).drop("_b")


def asof(probes: DataFrame, marks: DataFrame, by: list[str], at: str, value: list[str]) -> DataFrame:
    """probes with ``value`` of the last mark (by.., pos, value..) at or before ``at``; null before the first.

    Marks with equal pos: the last by value. The carry into a bucket is the last mark of the buckets before.
    """
    m = marks.select(*by, F.col("pos").alias("_p"), F.struct("pos", *value).alias("_v")).withColumn("_b", bucket("_p"))
    ends = m.groupBy(*by, "_b").agg(F.max("_v").alias("_end"))
    p = probes.withColumn("_p", F.col(at)).withColumn("_b", bucket("_p"))
    used = ends.select(*by, "_b", "_end").unionByName(p.select(*by, "_b").distinct(), allowMissingColumns=True).groupBy(*by, "_b").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = used.select(*by, "_b", F.max("_end").over(before).alias("_carry"))
    keep = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    both = m.withColumn("_k", F.lit(0)).unionByName(p.select(*by, "_p", "_b", F.lit(1).alias("_k"), keep.alias("_row")), allowMissingColumns=True)
    within = Window.partitionBy(*by, "_b").orderBy("_p", "_k", "_v").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("_in", F.last("_v", ignorenulls=True).over(within)).where("_k = 1")
    out = told.join(carry, [*by, "_b"], "left").withColumn("_v", F.coalesce("_in", "_carry"))
    return out.select("_row.*", *[F.col(f"_v.{c}").alias(c) for c in value])


def asof_shift(probes: DataFrame, marks: DataFrame, by: list[str], at: str = "addr") -> DataFrame:
    """probes with mapped: the address plus the shift of the last breakpoint at or before it; itself before the first."""
    got = asof(probes, marks.select(*by, F.col("off").alias("pos"), "delta"), by, at, ["delta"])
    return got.withColumn("mapped", F.col(at) + F.coalesce("delta", F.lit(0).cast("long"))).drop("delta")


def nearest_run_project(probes: DataFrame, runs: DataFrame, by: list[str], at: str = "addr") -> DataFrame:
    """probes with projected: shifted like the run that holds the address, else like the nearer of the runs
    before and after (a tie goes to the one after), clamped to [0, new_len - 1]; null from old_len on.
    probes carry old_len and new_len; runs are (src, dst, n), disjoint in src."""
    row = probes.columns
    back = asof(probes, runs.select(*by, F.col("src").alias("pos"), F.col("dst").alias("_bd"), F.col("n").alias("_bn"), F.col("src").alias("_bs")), by, at, ["_bs", "_bd", "_bn"])
    turned = runs.select(*by, (-F.col("src")).alias("pos"), F.col("src").alias("_fs"), F.col("dst").alias("_fd"))
    both = asof(back.withColumn("_neg", -F.col(at) - 1), turned, by, "_neg", ["_fs", "_fd"])
    a = F.col(at)
    end = F.col("_bs") + F.col("_bn")
    use_back = F.col("_bs").isNotNull() & ((a < end) | F.col("_fs").isNull() | (a - end < F.col("_fs") - a))
    shift = F.when(use_back, F.col("_bd") - F.col("_bs")).otherwise(F.col("_fd") - F.col("_fs"))
    at_new = F.when(a < F.col("old_len"), F.greatest(F.lit(0).cast("long"), F.least(F.col("new_len") - 1, a + shift)))
    return both.select(*row, at_new.alias("projected"))


def lookup_cascade(probes: DataFrame, points: DataFrame, maps: DataFrame, ranges: DataFrame, by: list[str], at: str = "addr") -> DataFrame:
    """probes with target and via: exact points (old, new) first, then maps, then ranges (old, new, size)."""
    hit = probes.join(points.select(*by, F.col("old").alias(at), F.col("new").alias("_point")), [*by, at], "left")
    mapped = interval_lookup(hit, maps, by, at).withColumnRenamed("target", "_map")
    side = ranges.select(*by, F.col("old").alias("src"), F.col("size").alias("src_size"), F.col("new").alias("dst"), F.col("size").alias("dst_size"))
    out = interval_lookup(mapped, side, by, at)
    via = F.when(F.col("_point").isNotNull(), "point").when(F.col("_map").isNotNull(), "map").when(F.col("target").isNotNull(), "range").otherwise("none")
    return out.select(*probes.columns, F.coalesce("_point", "_map", "target").alias("target"), via.alias("via"))


def clip_runs(runs: DataFrame, sections: DataFrame, by: list[str]) -> DataFrame:
    """(by.., name, src, dst, n): runs cut to old and new section bounds at once.
    sections: (by.., name, old_lo, old_hi, new_lo, new_hi)."""
    a = runs.withColumn("a_lo", F.col("src")).withColumn("a_hi", F.col("src") + F.col("n"))
    b = sections.withColumn("b_lo", F.col("old_lo")).withColumn("b_hi", F.col("old_hi"))
    met = overlaps(a, b, by)
    lo = F.greatest(F.col("src"), F.col("old_lo"), F.col("new_lo") - F.col("dst") + F.col("src"))
    hi = F.least(F.col("src") + F.col("n"), F.col("old_hi"), F.col("new_hi") - F.col("dst") + F.col("src"))
    cut = met.withColumn("_lo", lo).withColumn("_hi", hi).where("_hi > _lo")
    return cut.select(*by, "name", F.col("_lo").alias("src"), (F.col("dst") + F.col("_lo") - F.col("src")).alias("dst"), (F.col("_hi") - F.col("_lo")).alias("n"))


def gap_fill_spans(bodies: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """(by.., start, size, kind): disjoint bodies (start, size) and the gaps that complete [0, total) of each section."""
    nxt = Window.partitionBy(*by).orderBy("start")
    ends = bodies.unionByName(sizes.select(*by, F.col("total").alias("start"), F.lit(0).cast("long").alias("size")))
    seen = ends.withColumn("_from", F.coalesce(F.lag(F.col("start") + F.col("size")).over(nxt), F.lit(0).cast("long")))
    gaps = seen.where("start > _from").select(*by, F.col("_from").alias("start"), (F.col("start") - F.col("_from")).alias("size"), F.lit("gap").alias("kind"))
    return bodies.select(*by, "start", "size", F.lit("body").alias("kind")).unionAll(gaps)


def reference_retarget(refs: DataFrame, runs: DataFrame, points: DataFrame, maps: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """refs (ref_id, start, field, width, target) whose instruction start, field and last byte come from one run,
    with new_start and new_target by the lookup cascade; others are not rewritten and are left out."""
    marks = runs.select(*by, F.col("src").alias("pos"), F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("n").alias("_n"))
    out = refs.withColumn("_last", F.col("field") + F.col("width") - 1)
    got = None
    for c in ("start", "field", "_last"):
        out = asof(out, marks, by, c, ["_s", "_d", "_n"])
        inside = (F.col("_s").isNotNull()) & (F.col(c) < F.col("_s") + F.col("_n"))
        out = out.where(inside if got is None else inside & (F.col("_s") == F.col("_was")))
        if got is None:
            out = out.withColumn("_was", F.col("_s")).withColumn("new_start", F.col("start") + F.col("_d") - F.col("_s"))
        got = True
        out = out.drop("_s", "_d", "_n")
    out = out.drop("_last", "_was").withColumnRenamed("target", "old_target")
    return lookup_cascade(out, points, maps, ranges, by, "old_target").withColumnRenamed("target", "new_target")
