"""Where an address of the old image goes: through bodies, their pieces and data sections, or by the kind of reference.

Everything is a bucketed interval or as-of lookup of ``lookup``; positions belong to a section (``by``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import lookup


def mask_pointers(words: DataFrame, lo: int, hi: int) -> DataFrame:
    """words with value 0 where it lies in [lo, hi), and is_pointer: which ones did."""
    inside = F.coalesce((F.col("value") >= lo) & (F.col("value") < hi), F.lit(False))
    return words.withColumn("is_pointer", inside).withColumn("value", F.when(F.col("is_pointer"), F.lit(0).cast("long")).otherwise(F.col("value")))


def segment_offset(probes: DataFrame, pieces: DataFrame, by: list[str]) -> DataFrame:
    """probes (by.., body, o, new_size) with mapped: an offset of a resized body in its new one. The piece
    (by.., body, old, new, n) that holds it decides; else the offset stays, if it is inside the new body and no piece
    claims it there; else it moves like the piece before and is clamped to [0, new_size]."""
    key = [*by, "body"]
    was = asof_pieces(probes, pieces, key, "old", ["_o", "_d", "_n"])
    both = asof_pieces(was, pieces, key, "new", ["_co", "_cd", "_cn"])
    o = F.col("o")
    held = o < F.col("_o") + F.col("_n")
    claimed = F.coalesce(o < F.col("_cd") + F.col("_cn"), F.lit(False))
    zero = F.lit(0).cast("long")
    moved = F.least(F.greatest(o + F.coalesce(F.col("_d") - F.col("_o"), zero), zero), F.col("new_size"))
    stays = (o < F.col("new_size")) & ~claimed
    mapped = F.when(held, F.col("_d") + o - F.col("_o")).when(stays, o).otherwise(moved)
    return both.withColumn("mapped", mapped).drop("_o", "_d", "_n", "_co", "_cd", "_cn")


def asof_pieces(probes: DataFrame, pieces: DataFrame, key: list[str], side: str, names: list[str]) -> DataFrame:
    """probes with the last piece that starts at or before o on one side, as (old, new, n) under ``names``."""
    marks = pieces.select(*key, F.col(side).alias("pos"), *[F.col(c).alias(n) for c, n in zip(("old", "new", "n"), names, strict=True)])
    return lookup.asof(probes, marks, key, "o", names)


def address_map(refs: DataFrame, text: DataFrame, bodies: DataFrame, pieces: DataFrame, data: DataFrame, shifts: DataFrame, overrides: DataFrame, by: list[str]) -> DataFrame:
    """refs (by.., addr, self: the entry of the body that refers, or null) with class and target.

    text: (by.., text_lo, text_hi, text_new); bodies: (by.., src, src_size, dst or null, dst_size), disjoint; pieces as in
    ``segment_offset``, body being src; data: (by.., name, lo, hi, to: its new address or null), disjoint; shifts:
    (by.., name, off, delta). Overrides (by.., addr, to) replace a target and leave the class.

    Classes: self, matched, unmatched, none (in text, in no body), data, outside. An address just past a data section
    belongs to it if to no other. Unmatched and outside have no target.
    """
    zero = F.lit(0).cast("long")
    spans = bodies.select(*by, F.col("src").alias("lo"), (F.col("src") + F.col("src_size")).alias("hi"), F.col("src").alias("body"), "dst", F.col("dst_size").alias("new_size"))
    cut = pieces.select(*by, "body").distinct().withColumn("_cut", F.lit(True))
    p = refs.join(text, by, "left").withColumn("_text", F.coalesce((F.col("addr") >= F.col("text_lo")) & (F.col("addr") < F.col("text_hi")), F.lit(False)))
    p = lookup.holding(p, spans, by, "addr", ["body", "dst", "new_size"]).join(cut, [*by, "body"], "left").withColumn("o", F.col("addr") - F.col("body"))
    p = segment_offset(p, pieces, by).withColumn("_o", F.when(F.col("_cut"), F.col("mapped")).otherwise(F.col("o")))
    p = p.withColumn("_past", F.when(F.col("addr") > 0, F.col("addr") - 1))
    named = lambda n: data.select(*by, "lo", "hi", F.col("name").alias(f"{n}name"), F.col("lo").alias(f"{n}lo"), F.col("to").alias(f"{n}to"))
    p = lookup.holding(p, named("_a"), by, "addr", ["_aname", "_alo", "_ato"])
    p = lookup.holding(p, named("_b"), by, "_past", ["_bname", "_blo", "_bto"])
    for c in ("name", "lo", "to"):
        p = p.withColumn(f"_{c}", F.when(F.col("_aname").isNotNull(), F.col(f"_a{c}")).otherwise(F.col(f"_b{c}")))
    p = p.withColumn("_off", F.col("addr") - F.col("_lo"))
    marks = shifts.select(*by, F.col("name").alias("_name"), F.col("off").alias("pos"), F.col("delta").alias("_delta"))
    p = lookup.asof(p, marks, [*by, "_name"], "_off", ["_delta"])
    in_body = F.col("body").isNotNull()
    kind = (
        F.when(F.col("_text") & ~in_body, "none").when(F.col("_text") & F.col("dst").isNull(), "unmatched").when(F.col("_text") & F.col("body").eqNullSafe(F.col("self")), "self")
        .when(F.col("_text"), "matched").when(F.col("_to").isNull(), "outside").otherwise("data")
    )
    base = (
        F.when(F.col("class") == "none", F.col("text_new") + F.col("addr") - F.col("text_lo")).when(F.col("class").isin("self", "matched"), F.col("dst") + F.col("_o"))
        .when(F.col("class") == "data", F.col("_to") + F.col("_off") + F.coalesce("_delta", zero))
    )
    out = p.withColumn("class", kind).withColumn("_base", base).join(overrides.select(*by, "addr", F.col("to").alias("_won")), [*by, "addr"], "left")
    return out.select(*refs.columns, "class", F.coalesce("_won", "_base").alias("target"))


def _landed(probes: DataFrame, spans: DataFrame, runs: DataFrame, by: list[str], at: str) -> DataFrame:
    """probes with _code (whether the address lies in code), _file and _new (its file offsets in both images), and _any
    and _into: the new address there, in any span and in code."""
    old = spans.select(*by, F.col("old_addr").alias("lo"), (F.col("old_addr") + F.col("old_size")).alias("hi"), F.col("old_addr").alias("_oa"), F.col("old_off").alias("_oo"), F.col("code").alias("_code"))
    new = spans.select(*by, F.col("new_off").alias("lo"), (F.col("new_off") + F.col("new_size")).alias("hi"), F.col("new_addr").alias("_na"), F.col("new_off").alias("_no"), F.col("code").alias("_ncode"))
    p = lookup.holding(probes, old, by, at, ["_oa", "_oo", "_code"]).withColumn("_file", F.col("_oo") + F.col(at) - F.col("_oa"))
    p = lookup.nearest_run_project(p, runs, by, "_file").withColumnRenamed("projected", "_new")
    p = lookup.holding(p, new, by, "_new", ["_na", "_no", "_ncode"]).withColumn("_any", F.col("_na") + F.col("_new") - F.col("_no"))
    return p.withColumn("_into", F.when(F.col("_ncode"), F.col("_any"))).drop("_oa", "_oo", "_na", "_no", "_ncode")


def _resolved(probes: DataFrame, spans: DataFrame, runs: DataFrame, points: DataFrame, maps: DataFrame, ranges: DataFrame, by: list[str], at: str) -> DataFrame:
    return lookup.lookup_cascade(_landed(probes, spans, runs, by, at), points, maps, ranges, by, at)


def _first(kinds: list[str], then: str) -> Column:
    return F.coalesce(F.when(F.col("via").isin(*kinds), F.col("target")), F.col(then), F.col("target"))


def reference_targets(probes: DataFrame, spans: DataFrame, runs: DataFrame, points: DataFrame, maps: DataFrame, ranges: DataFrame, by: list[str], at: str = "addr") -> DataFrame:
    """probes with displacement and pointer: the new address as a displacement sees it and as a pointer does.

    Displacements into code go where the bytes went, if that is in code, else through points, maps and ranges; others take
    a point, then the bytes, then the rest. Pointers name a thing: point, map, the bytes, the rest. probes carry old_len
    and new_len of the files; spans: (by.., old_addr, old_size, old_off, new_addr, new_size, new_off, code).
    """
    p = _resolved(probes, spans, runs, points, maps, ranges, by, at)
    displacement = F.when(F.coalesce("_code", F.lit(False)), F.coalesce("_into", "target")).otherwise(_first(["point"], "_any"))
    return p.select(*probes.columns, displacement.alias("displacement"), _first(["point", "map"], "_any").alias("pointer"))


def pointer_slots(slots: DataFrame, spans: DataFrame, runs: DataFrame, points: DataFrame, maps: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """slots (by.., slot, value, old_len, new_len) with new_off, target and status: unplaced where the slot has no
    place in the new file for its eight bytes, unknown where the pointer it holds has no target, else retargeted."""
    p = _landed(slots, spans, runs, by, "slot").withColumn("_fits", (F.col("_file") + 8 <= F.col("old_len")) & (F.col("_new") + 8 <= F.col("new_len")))
    p = p.select(*slots.columns, F.when(F.col("_fits"), F.col("_new")).alias("new_off"))
    p = reference_targets(p, spans, runs, points, maps, ranges, by, "value").drop("displacement")
    status = F.when(F.col("new_off").isNull(), "unplaced").when(F.col("pointer").isNull(), "unknown").otherwise("retargeted")
    told = p.withColumn("status", status)
    return told.select(*slots.columns, "new_off", F.when(F.col("status") == "retargeted", F.col("pointer")).alias("target"), "status")


def predict_records(units: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """units (by.., ord, matched, cu, fields.., len) with each new unit's fields as most often among its section's
    matched ones (the smallest on a tie), cu as in the unit before (0 at first), and offset: records in order, 8-aligned."""
    modes = units.where("matched").groupBy(*by).agg(*[F.mode(f, True).alias(f"_{f}") for f in fields])
    order = Window.partitionBy(*by).orderBy("ord")
    own = F.when(F.col("matched"), F.col("cu"))
    size = F.col("len") + F.pmod(-F.col("len"), F.lit(8))
    p = units.join(modes, by, "left").withColumn("cu", F.coalesce(F.last(own, ignorenulls=True).over(order), F.lit(0).cast("long")))
    p = p.withColumn("offset", F.sum(size).over(order) - size)
    for f in fields:
        p = p.withColumn(f, F.when(F.col("matched"), F.col(f)).otherwise(F.col(f"_{f}")))
    return p.select(*units.columns, "offset")


def unwind_rewrite(frames: DataFrame, places: DataFrame, runs: DataFrame, points: DataFrame, maps: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """frames (by.., id, entry, loc, cie: file offsets; addr: the old address described; size; old_len, new_len) with
    what is rewritten: cie_back, the distance from the entry's second word to its common entry; location, the new
    address relative to the field that holds it; new_size; and known, whether location is.

    Offsets go where the bytes went, within the new section (places: by.., at, n, address). The size follows the map
    that starts at addr only where that map's old size is the stored one and its new size differs; else it stays.
    """
    p = frames
    for c in ("entry", "loc", "cie"):
        p = lookup.nearest_run_project(p, runs, by, c).withColumnRenamed("projected", f"_{c}")
    p = p.join(places.select(*by, F.col("at").alias("_at"), F.col("n").alias("_n"), F.col("address").alias("_address")), by)
    inside = lambda c, k: (F.col(c) >= F.col("_at")) & (F.col(c) + k <= F.col("_at") + F.col("_n"))
    p = lookup.lookup_cascade(p, points, maps, ranges, by).withColumnRenamed("target", "_to")
    own = maps.select(*by, F.col("src").alias("addr"), F.col("src_size").alias("_was"), F.col("dst_size").alias("_is"))
    p = p.join(own, [*by, "addr"], "left")
    placed = F.coalesce(inside("_loc", 4) & F.col("_entry").isNotNull(), F.lit(False))
    field = F.col("_address") + F.col("_loc") - F.col("_at")
    back = F.col("_entry") + 4 - F.col("_cie")
    known = placed & F.col("_to").isNotNull()
    resized = known & inside("_loc", 8) & (F.col("_was") == F.col("size")) & (F.col("_is") != F.col("size"))
    return p.select(
        *frames.columns, F.when(placed & inside("_entry", 8) & (F.col("_cie") >= F.col("_at")) & (back > 0), back).alias("cie_back"), F.when(known, F.col("_to") - field).alias("location"),
        F.when(resized, F.col("_is")).otherwise(F.col("size")).alias("new_size"), known.alias("known"),
    )
