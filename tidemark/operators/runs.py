"""Runs, regions, gaps and residuals of ordered columns.

All work within a section (``by``) in the order of ``ord``: sections run in parallel, and each needs one
shuffle and one sort that its windows share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(by: list[str], *order: str | Column):
    return Window.partitionBy(*by).orderBy(*order)


def islands(rows: DataFrame, by: list[str], ord_: str, changed: Column, name: str = "island") -> DataFrame:
    """rows with the number of the run they are in; a row for which ``changed`` is true or null begins one."""
    upto = _over(by, ord_).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_c", F.coalesce(changed, F.lit(True)).cast("long")).withColumn(name, F.sum("_c").over(upto)).drop("_c")


def shift_breakpoints(shifts: DataFrame, by: list[str]) -> DataFrame:
    """(by.., off, delta) where the shift differs from the one before; 0 before the first."""
    before = F.lag("delta", 1, 0).over(_over(by, "off", "delta"))
    return shifts.withColumn("_b", before).where("delta <> _b").select(*by, "off", "delta")


def reliable_blocks(blocks: DataFrame, by: list[str]) -> DataFrame:
    """blocks (ord, delta, matched) with reliable: matched, or between matched blocks of one shift."""
    seen = F.when(F.col("matched"), F.col("delta"))
    back = F.last(seen, ignorenulls=True).over(_over(by, "ord").rowsBetween(Window.unboundedPreceding, -1))
    # Backwards in order: a frame that ends at the section's end is read whole for each row.
    ahead = F.last(seen, ignorenulls=True).over(_over(by, F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn("reliable", F.col("matched") | F.coalesce(back == ahead, F.lit(False)))


def keep_drop_runs(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by.., run, kept, n): alternating run lengths of the boolean ``kept`` in the order of ord."""
    marked = islands(rows, by, "ord", F.col("kept") != F.lag("kept").over(_over(by, "ord")), "run")
    return marked.groupBy(*by, "run").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))


def gap_encode(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows with gap: the value less the one before (0 before the first)."""
    return rows.withColumn("gap", F.col(value) - F.lag(value, 1, 0).over(_over(by, "ord")))


def gap_decode(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The inverse of gap_encode."""
    return rows.withColumn(value, F.sum("gap").over(_over(by, "ord").rowsBetween(Window.unboundedPreceding, 0)))


def rle_encode(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by.., run, start, n, step): runs of equal values as the difference to the run before (0 before the first)."""
    marked = islands(rows, by, "ord", F.col(value) != F.lag(value).over(_over(by, "ord")), "run")
    runs = marked.groupBy(*by, "run").agg(F.min("ord").alias("start"), F.count("*").alias("n"), F.first(value).alias("_v"))
    return runs.withColumn("step", F.col("_v") - F.lag("_v", 1, 0).over(_over(by, "run"))).drop("_v")


def rle_decode(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by.., ord, value) of consecutive ords."""
    told = runs.withColumn(value, F.sum("step").over(_over(by, "run").rowsBetween(Window.unboundedPreceding, 0)))
    return told.select(*by, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("ord"), value)


def merged_regions(diffs: DataFrame, by: list[str], m: int) -> DataFrame:
    """(by.., start, end, n): differing positions (pos) as regions [start, end), merged across fewer than m equal ones."""
    gap = F.col("pos") - F.lag("pos").over(_over(by, "pos")) - 1
    marked = islands(diffs, by, "pos", gap >= m, "_r")
    return marked.groupBy(*by, "_r").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count("*").alias("n")).drop("_r")


def word_regions(cells: DataFrame, by: list[str], merge: int = 32, word: int = 8) -> DataFrame:
    """(by.., start, end): merged regions of differing cells widened to words, the last one at most to the cells' end.
    ``merge`` is twice ``word`` or more, so that widened regions stay apart."""
    if merge < 2 * word:
        raise ValueError("regions merged over so few cells could overlap once widened")
    ends = cells.groupBy(*by).agg((F.max("pos") + 1).alias("_len"))
    found = merged_regions(cells.where("pred <> want").select(*by, "pos"), by, merge).join(ends, by)
    start, end = F.col("start") - F.col("start") % word, F.col("end") + F.pmod(-F.col("end"), F.lit(word))
    return found.select(*by, start.alias("start"), F.least(end, F.col("_len")).alias("end"))


def region_modes(cells: DataFrame, by: list[str], passes: int = 3) -> DataFrame:
    """(by.., start, mode, bits): for each word region of bytes (pos, pred, want) the cheapest of 0 the wanted bytes, 1
    their exclusive ors with the predicted ones, 2 their differences modulo 256. A mode's bytes are priced by the counts
    of the bytes it was chosen for in the pass before (each raised by a half); at first all regions take mode 0.

    Passes run over byte counts of regions, not over cells; a model is at most 3 x 256 rows a section.
    """
    from tidemark.operators.lookup import holding

    spans = word_regions(cells, by).select(*by, F.col("start").alias("lo"), F.col("end").alias("hi"), "start")
    want, pred = F.col("want"), F.col("pred")
    forms = F.array(want, want.bitwiseXOR(pred), F.pmod(want - pred, F.lit(256)))
    counts = holding(cells, spans, by, "pos", ["start"]).where("start is not null").select(*by, "start", F.posexplode(forms).alias("mode", "byte"))
    counts = counts.groupBy(*by, "start", "mode", "byte").agg(F.count("*").alias("n"))
    chosen = counts.select(*by, "start").distinct().withColumn("mode", F.lit(0))
    for _ in range(passes):
        model = counts.join(chosen, [*by, "start", "mode"]).groupBy(*by, "mode", "byte").agg(F.sum("n").alias("_c"))
        total = model.groupBy(*by, "mode").agg(F.sum("_c").alias("_t"))
        some = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        told = counts.join(model, [*by, "mode", "byte"], "left").join(total, [*by, "mode"], "left")
        bits = F.sum(F.col("n") * (F.log2(some("_t") + 128) - F.log2(some("_c") + 0.5)))
        cost = told.groupBy(*by, "start", "mode").agg(F.round(bits, 6).alias("bits"))
        best = cost.groupBy(*by, "start").agg(F.min(F.struct("bits", "mode")).alias("b"))
        chosen = best.select(*by, "start", F.col("b.mode").alias("mode"), F.col("b.bits").alias("bits"))
    return chosen


def boundaries(cells: DataFrame, by: list[str], pad: int = 0xCC, align: int = 8) -> DataFrame:
    """(by.., pos): the first cell (pos, value) and each aligned one that is no padding and follows padding."""
    before = cells.where(F.col("value") == pad).select(*by, (F.col("pos") + 1).alias("pos"), F.lit(True).alias("_after"))
    seen = cells.where((F.col("pos") % align == 0) & (F.col("value") != pad)).join(before, [*by, "pos"], "left").where("_after and pos > 0")
    return cells.where("pos = 0").select(*by, "pos").unionAll(seen.select(*by, "pos"))


def padding_extent(spans: DataFrame, cells: DataFrame, by: list[str], pad: int = 0xCC) -> DataFrame:
    """spans (by.., start, next) with size: up to the next start without the padding before it."""
    from tidemark.operators.lookup import asof

    full = cells.where(F.col("value") != pad).select(*by, "pos", F.col("pos").alias("_last"))
    got = asof(spans.withColumn("_at", F.col("next") - 1), full, by, "_at", ["_last"])
    zero = F.lit(0).cast("long")
    return got.select(*spans.columns, F.greatest(F.coalesce(F.col("_last") + 1 - F.col("start"), zero), zero).alias("size"))


def diff_runs(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by.., start, n, bytes): maximal runs of positions where pred and want differ, with the wanted values in order."""
    wrong = cells.where("pred <> want")
    marked = islands(wrong, by, "pos", F.col("pos") != F.lag("pos").over(_over(by, "pos")) + 1, "_r")
    runs = marked.groupBy(*by, "_r").agg(F.min("pos").alias("start"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "want"))), lambda x: x["want"]).alias("bytes"))
    return runs.drop("_r")


def columnar_encode(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by.., ord, gap, n, bucket, bytes): the diff runs as columns: the gap from the last run's end, the length, its bucket."""
    runs = diff_runs(cells, by)
    order = _over(by, "start")
    gap = F.col("start") - F.coalesce(F.lag(F.col("start") + F.col("n")).over(order), F.lit(0).cast("long"))
    return runs.select(*by, F.row_number().over(order).cast("long").alias("ord"), gap.alias("gap"), "n", (F.least("n", F.lit(5)) - 1).cast("long").alias("bucket"), "bytes")


def columnar_apply(cells: DataFrame, columns: DataFrame, by: list[str]) -> DataFrame:
    """cells (by.., pos, pred) with got: the prediction corrected by the columns. A column whose length is not that
    of its bytes, or a position beyond the cells, is an error."""
    upto = _over(by, "ord").rowsBetween(Window.unboundedPreceding, 0)
    runs = columns.withColumn("start", F.sum(F.col("gap") + F.col("n")).over(upto) - F.col("n"))
    whole = F.when(F.size("bytes") == F.col("n"), F.col("bytes")).otherwise(F.raise_error(F.lit("a run's length is not that of its bytes")))
    fixes = runs.select(*by, "start", F.posexplode(whole).alias("_i", "_v")).select(*by, (F.col("start") + F.col("_i")).alias("pos"), "_v")
    both = cells.select(*by, "pos", "pred").join(fixes, [*by, "pos"], "full_outer")
    beyond = F.raise_error(F.lit("a correction beyond the prediction")).cast("long")
    return both.select(*by, "pos", F.when(F.col("pred").isNull(), beyond).otherwise(F.coalesce("_v", "pred")).alias("got"))


def residual_mode_choice(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by.., literal, difference, exclusive, mode): significant bytes of the wanted values, of their differences to
    the predictions and of their exclusive ors; the cheapest, in this order on a tie."""
    size = lambda c: F.sum(F.ceil(F.length(F.regexp_replace(F.bin(c), "^0$", "")) / 8)).cast("long")
    want, pred = F.col("want"), F.col("pred")
    out = cells.groupBy(*by).agg(size(want).alias("literal"), size(F.abs(want - pred)).alias("difference"), size(want.bitwiseXOR(pred)).alias("exclusive"))
    mode = F.when((F.col("literal") <= F.col("difference")) & (F.col("literal") <= F.col("exclusive")), "literal").when(F.col("difference") <= F.col("exclusive"), "difference")
    return out.withColumn("mode", mode.otherwise("exclusive"))


def first_use_layout(uses: DataFrame, by: list[str]) -> DataFrame:
    """uses (ord, content, len) with offset: contents are laid out once, in the order of first use, after one pad byte."""
    first = uses.groupBy(*by, "content").agg(F.min("ord").alias("_o"), F.first("len").alias("_l"))
    upto = _over(by, "_o").rowsBetween(Window.unboundedPreceding, 0)
    placed = first.withColumn("offset", F.sum("_l").over(upto) - F.col("_l") + 1)
    return uses.join(placed.select(*by, "content", "offset"), [*by, "content"])


def run_histogram(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by.., bucket, runs, cells): counts by length 1, 2, 3, 4, 5 and over."""
    return runs.groupBy(*by, F.least(F.col("n"), F.lit(5)).cast("long").alias("bucket")).agg(F.count("*").alias("runs"), F.sum("n").alias("cells"))


def sorted_unique_index(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by.., loc, ord, rank): the first entry of each location in source order, ranked by location from 0."""
    first = entries.groupBy(*by, "loc").agg(F.min("ord").alias("ord"))
    return first.withColumn("rank", F.row_number().over(_over(by, "loc")).cast("long") - 1)


def bitmap_expand(words: DataFrame, by: list[str]) -> DataFrame:
    """(by.., slot): words (ord, word) where an even word is a slot and sets the base 8 past it, and an odd word's
    bits 1 to 63 mark base, base + 8, ...; each odd word moves the base by 504."""
    upto = _over(by, "ord").rowsBetween(Window.unboundedPreceding, 0)
    even = F.col("word") % 2 == 0
    seen = words.withColumn("_a", F.last(F.when(even, F.col("word")), ignorenulls=True).over(upto))
    seen = seen.withColumn("_g", F.sum(even.cast("long")).over(upto))
    odd = F.sum((~even).cast("long")).over(_over([*by, "_g"], "ord").rowsBetween(Window.unboundedPreceding, 0))
    seen = seen.withColumn("_n", odd)
    base = F.col("_a") + 8 + 504 * (F.col("_n") - 1)
    marks = F.transform(F.filter(F.sequence(F.lit(1), F.lit(63)), lambda i: F.getbit("word", i) == 1), lambda i: base + 8 * (i - 1))
    return seen.where(even | F.col("_a").isNotNull()).select(*by, F.explode(F.when(even, F.array("word")).otherwise(marks)).alias("slot"))


def op_list_encode(units: DataFrame, by: list[str]) -> DataFrame:
    """units (ord, old_ord or null, size, old_size) with op: 2 new, 3 next with equal size, 0 next with another
    size, 1 explicit; and size_delta, against 0 for new ones. Next is one past the last matched old ordinal."""
    before = _over(by, "ord").rowsBetween(Window.unboundedPreceding, -1)
    expect = F.coalesce(F.last("old_ord", ignorenulls=True).over(before) + 1, F.lit(0).cast("long"))
    same = F.col("old_ord") == expect
    op = F.when(F.col("old_ord").isNull(), 2).when(same & (F.col("size") == F.col("old_size")), 3).when(same, 0).otherwise(1)
    return units.withColumn("op", op.cast("long")).withColumn("size_delta", F.col("size") - F.coalesce("old_size", F.lit(0).cast("long")))


def bucket_min_index(bodies: DataFrame, by: list[str], sub: int = 256, bucket: int = 4096) -> DataFrame:
    """(by.., sub_bucket, first, rel): the least body index (idx, start, size) that touches each sub-bucket, and
    that less the least of its bucket."""
    touched = bodies.where("size > 0").select(*by, "idx", F.explode(F.sequence(F.floor(F.col("start") / sub).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / sub).cast("long"))).alias("sub_bucket"))
    least = touched.groupBy(*by, "sub_bucket").agg(F.min("idx").alias("first"))
    base = F.min("first").over(Window.partitionBy(*by, F.floor(F.col("sub_bucket") / (bucket // sub))))
    return least.withColumn("rel", F.col("first") - base)


def sparse_encode(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by.., ord, gap, value): cells (idx, value) as index gaps, the first against 0."""
    order = _over(by, "idx")
    gap = F.col("idx") - F.coalesce(F.lag("idx").over(order), F.lit(0).cast("long"))
    return cells.select(*by, F.row_number().over(order).cast("long").alias("ord"), gap.alias("gap"), "value")


def sparse_decode(column: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """(by.., idx, value). An index at or past the section's size (by.., n), or a gap of 0 after the first, is an error."""
    upto = _over(by, "ord").rowsBetween(Window.unboundedPreceding, 0)
    got = column.withColumn("idx", F.sum("gap").over(upto)).join(sizes.select(*by, "n"), by)
    bad = (F.col("gap") < 0) | ((F.col("gap") == 0) & (F.col("ord") > 1)) | (F.col("idx") >= F.col("n"))
    return got.select(*by, F.when(bad, F.raise_error(F.lit("invalid sparse column")).cast("long")).otherwise(F.col("idx")).alias("idx"), "value")
