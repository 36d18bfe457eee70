"""Relocation tables as columns: split, projected through the lookups, corrected and put together again.

Entries are (ord, slot, info, addend) within a section (``by``). Relative entries give a column of slot gaps and one
of addends; all others, in their order, are the tail, of which those before the first relative entry are the head.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import lookup

#: Fixed value: the relocation type of entries without a symbol, in the low half of info.
RELATIVE = 8
_TYPE = 0xFFFFFFFF


def rela_split(entries: DataFrame, by: list[str]) -> DataFrame:
    """entries with kind (rel, head or tail) and idx: the place among relative entries, or among all others."""
    rel = F.col("info").bitwiseAND(F.lit(_TYPE).cast("long")) == RELATIVE
    first = F.min(F.when(rel, F.col("ord"))).over(Window.partitionBy(*by))
    idx = F.row_number().over(Window.partitionBy(*by, rel).orderBy("ord")).cast("long") - 1
    return entries.select("*", F.when(rel, "rel").when(F.col("ord") > first, "tail").otherwise("head").alias("kind"), idx.alias("idx"))


def _projected(split: DataFrame, points: DataFrame, maps: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """split with slot and addend looked up; 0 and unknown addresses keep their value."""
    asked = split.select(*by, F.explode(F.array("slot", "addend")).alias("addr")).where("addr <> 0").distinct()
    known = lookup.lookup_cascade(asked, points, maps, ranges, by).where("target is not null").select(*by, "addr", "target")
    out = split
    for c in ("slot", "addend"):
        out = out.join(known.select(*by, F.col("addr").alias(c), F.col("target").alias("_t")), [*by, c], "left").withColumn(c, F.coalesce("_t", c)).drop("_t")
    return out


def _gaps(rel: DataFrame, by: list[str]) -> DataFrame:
    """rel with gap: the slot less the one before by idx; 0 for the first."""
    return rel.withColumn("gap", F.coalesce(F.col("slot") - F.lag("slot").over(Window.partitionBy(*by).orderBy("idx")), F.lit(0).cast("long")))


def addend_column(projected: DataFrame, slots: DataFrame, by: list[str]) -> DataFrame:
    """slots (idx, slot) with pred: the addend of the first projected entry of that slot, else that of the same
    place, else 0."""
    first = projected.groupBy(*by, "slot").agg(F.min_by("addend", "idx").alias("_a"))
    place = projected.select(*by, "idx", F.col("addend").alias("_b"))
    out = slots.join(first, [*by, "slot"], "left").join(place, [*by, "idx"], "left")
    return out.withColumn("pred", F.coalesce("_a", "_b", F.lit(0).cast("long"))).drop("_a", "_b")


def predicted_columns(old: DataFrame, new: DataFrame, points: DataFrame, maps: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """(by.., part, idx, pred, want) for each cell of the new table's columns: gap and addend of relative entries,
    slot, info and addend of the tail."""
    was, now = _projected(rela_split(old, by), points, maps, ranges, by), rela_split(new, by)
    none = F.lit(0).cast("long")
    rel, want = was.where("kind = 'rel'"), now.where("kind = 'rel'")
    cell = lambda df, name, pred, want: df.select(*by, F.lit(name).alias("part"), "idx", F.coalesce(pred, none).alias("pred"), want.alias("want"))
    gaps = _gaps(want, by).join(_gaps(rel, by).select(*by, "idx", F.col("gap").alias("_g")), [*by, "idx"], "left")
    addends = addend_column(rel.select(*by, "idx", "slot", "addend"), want.select(*by, "idx", "slot", F.col("addend").alias("_w")), by)
    tail = was.where("kind <> 'rel'").select(*by, "idx", *[F.col(c).alias(f"_{c}") for c in ("slot", "info", "addend")])
    rest = now.where("kind <> 'rel'").join(tail, [*by, "idx"], "left")
    out = cell(gaps, "gap", F.col("_g"), F.col("gap")).unionAll(cell(addends, "addend", F.col("pred"), F.col("_w")))
    for c in ("slot", "info", "addend"):
        out = out.unionAll(cell(rest, f"tail_{c}", F.col(f"_{c}"), F.col(c)))
    return out


def reloc_plan(cells: DataFrame) -> DataFrame:
    """The cells that need a correction."""
    return cells.where("pred <> want")


def assemble_rela(cells: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """(by.., ord, slot, info, addend) from columns (part, idx, value) and anchors (by.., anchor: the first relative slot,
    head: entries before it): head, relative entries, the rest of the tail."""
    wide = lambda parts: [F.max(F.when(F.col("part") == p, F.col("value"))).alias(p) for p in parts]
    rel = cells.where(F.col("part").isin("gap", "addend")).groupBy(*by, "idx").agg(*wide(("gap", "addend"))).join(anchors, by)
    upto = Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rel = rel.select(*by, (F.col("head") + F.col("idx")).alias("ord"), (F.col("anchor") + F.sum("gap").over(upto)).alias("slot"), F.lit(RELATIVE).cast("long").alias("info"), "addend")
    count = rel.groupBy(*by).agg(F.count("*").alias("_n"))
    tail = cells.where(F.col("part").startswith("tail_")).groupBy(*by, "idx").agg(*wide(("tail_slot", "tail_info", "tail_addend")))
    tail = tail.join(anchors, by).join(count, by, "left")
    place = F.when(F.col("idx") < F.col("head"), F.col("idx")).otherwise(F.col("idx") + F.coalesce("_n", F.lit(0).cast("long")))
    return rel.unionAll(tail.select(*by, place.alias("ord"), F.col("tail_slot").alias("slot"), F.col("tail_info").alias("info"), F.col("tail_addend").alias("addend")))
