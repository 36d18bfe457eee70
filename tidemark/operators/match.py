"""Pairing the records of two versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def staged_match(old: DataFrame, new: DataFrame, stages: list[tuple[str, str]], ord_: str = "ord") -> DataFrame:
    """(new_id, old_id, stage) of a one-to-one match: in each stage the i-th unmatched new row of a key takes the
    i-th unmatched old row of that key. ``stages``: (name, key column). Unmatched rows are not listed.

    One shuffle a side and stage, on the key; only (id, keys, ord) travel.
    """
    out = None
    for name, key in stages:
        nth = F.row_number().over(Window.partitionBy(key).orderBy(ord_))
        a = old.where(F.col(key).isNotNull()).select(F.col("id").alias("old_id"), F.col(key).alias("_k"), nth.alias("_n"))
        b = new.where(F.col(key).isNotNull()).select(F.col("id").alias("new_id"), F.col(key).alias("_k"), nth.alias("_n"))
        got = a.join(b, ["_k", "_n"]).select("new_id", "old_id", F.lit(name).alias("stage"))
        out = got if out is None else out.unionAll(got)
        old = old.join(got, old["id"] == got["old_id"], "left_anti")
        new = new.join(got, new["id"] == got["new_id"], "left_anti")
    return out


def best_candidate_match(old: DataFrame, new: DataFrame, levels: list[tuple[int, list[str]]]) -> DataFrame:
    """(new_id, old_id, score, copy): for each new row the old row sharing any name with the best score, then the
    least distance of ids, then the first by name and old id. Both sides: id, names (array) and the fields of
    ``levels``: (score, fields), from the best; a pair has the first score whose fields are all equal.

    Pairs are never formed: at the best level that holds any candidate the nearest one is the old id before or after
    among the rows of equal name and fields, so a frequent name costs two sorts of its rows.
    """
    fields = sorted({c for _, cs in levels for c in cs})
    used = {c: [i for i, (_, cs) in enumerate(levels) if c in cs] for c in fields}

    def keyed(side: DataFrame, is_new: bool):
        rows = side.select("id", *fields, F.posexplode("names").alias("_o", "name")).where("name is not null")
        rows = rows.withColumn("_l", F.explode(F.array(*[F.lit(i) for i in range(len(levels))])))
        for c in fields:
            asks = F.col("_l").isin(used[c])
            rows = rows.where(~asks | F.col(c).isNotNull()).withColumn(c, F.when(asks, F.col(c)))
        return rows.select("_l", "name", *fields, "_o", "id", F.lit(is_new).alias("_new"))

    both = keyed(old, False).unionByName(keyed(new, True))
    group = Window.partitionBy("_l", "name", *fields)
    seen = F.last(F.when(~F.col("_new"), F.col("id")), ignorenulls=True)
    upto = lambda order: seen.over(group.orderBy(order, "_new").rowsBetween(Window.unboundedPreceding, 0))
    told = both.withColumn("_back", upto(F.col("id"))).withColumn("_ahead", upto(F.desc("id"))).where("_new")
    found = lambda o: F.when(F.col(o).isNotNull(), F.struct("_l", F.abs(F.col("id") - F.col(o)).alias("near"), "_o", F.col(o).alias("old_id")))
    best = told.groupBy("id").agg(F.min(F.least(found("_back"), found("_ahead"))).alias("b")).where("b is not null")
    score = F.element_at(F.array(*[F.lit(s) for s, _ in levels]), F.col("b._l") + 1)
    return best.select(F.col("id").alias("new_id"), "b.old_id", score.alias("score")).withColumn("copy", F.col("score") >= 2)


def unambiguous_pairs(pairs: DataFrame) -> DataFrame:
    """(o, n) of the old values that always go to one new value."""
    return pairs.groupBy("o").agg(F.min("n").alias("n"), F.max("n").alias("_x")).where("n = _x").drop("_x")


def join_with_positional_fallback(projected: DataFrame, slots: DataFrame, by: list[str]) -> DataFrame:
    """slots (by.., ord, slot) with addend: that of the first projected entry with the slot, else of the projected
    entry at the same place, else 0."""
    keyed = projected.groupBy(*by, "slot").agg(F.min_by("addend", "ord").alias("_by_slot"))
    placed = projected.select(*by, "ord", F.col("addend").alias("_by_place"))
    out = slots.join(keyed, [*by, "slot"], "left").join(placed, [*by, "ord"], "left")
    return out.select(*by, "ord", "slot", F.coalesce("_by_slot", "_by_place", F.lit(0).cast("long")).alias("addend"))


def monotone_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Pairs (by.., ord, j) whose j passes all earlier ones."""
    before = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return pairs.withColumn("_m", F.max("j").over(before)).where(F.col("j") > F.coalesce("_m", F.lit(-1))).drop("_m")


def enumeration_repair(derived: DataFrame, true: DataFrame) -> DataFrame:
    """(v, kind) that turn the derived set into the true one: ``missing`` values to add, ``suppressed`` to take out."""
    each = _sides(derived, true)
    null = F.col("v").isNull()  # equals no value of the other side
    kinds = F.array(F.when((F.col("t") == 1) & ((F.col("d") == 0) | null), "missing"), F.when((F.col("d") == 1) & ((F.col("t") == 0) | null), "suppressed"))
    return each.select("v", F.explode(F.array_compact(kinds)).alias("kind"))


def _sides(derived: DataFrame, true: DataFrame) -> DataFrame:
    """(v, d, t): each value once, with 1 for the sets that hold it: one aggregate in place of joins, which sort both sides."""
    sides = derived.select("v", F.lit(1).alias("d"), F.lit(0).alias("t")).unionAll(true.select("v", F.lit(0).alias("d"), F.lit(1).alias("t")))
    return sides.groupBy("v").agg(F.max("d").alias("d"), F.max("t").alias("t"))


def enumeration_coverage(derived: DataFrame, true: DataFrame) -> DataFrame:
    """(n_true, n_derived, n_both) of two sets."""
    return _sides(derived, true).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in ((F.col("t"), "n_true"), (F.col("d"), "n_derived"), (F.col("d") * F.col("t"), "n_both"))])


def capped_candidates(pairs: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k candidates of each key, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def content_match(old: DataFrame, new: DataFrame, matched: DataFrame, key: list[str]) -> DataFrame:
    """(new_id, old_id) for the new rows not in ``matched`` (new_id): the old row of equal ``key`` (size and content)
    nearest in off, the lowest old id on a tie. Sides: (id, off, key..); old rows may serve many new ones.

    Nearest by one as-of lookup either way, so rows of a frequent key are never paired with one another.
    """
    from tidemark.operators.lookup import asof

    open_ = new.join(matched.select(F.col("new_id").alias("id")), "id", "left_anti").select(F.col("id").alias("new_id"), "off", *key)
    low = (-F.col("id")).alias("_low")
    back = asof(open_, old.select(*key, F.col("off").alias("pos"), low, F.col("off").alias("_at")), key, "off", ["_low", "_at"])
    back = back.withColumn("_back", F.struct((F.col("off") - F.col("_at")).alias("far"), (-F.col("_low")).alias("id"))).withColumn("_neg", -F.col("off")).drop("_low", "_at")
    both = asof(back, old.select(*key, (-F.col("off")).alias("pos"), low, F.col("off").alias("_at")), key, "_neg", ["_low", "_at"])
    ahead = F.struct((F.col("_at") - F.col("off")).alias("far"), (-F.col("_low")).alias("id"))
    known = lambda s, c: F.when(c.isNotNull(), s)
    best = F.least(known(F.col("_back"), F.col("_back.id")), known(ahead, F.col("_low")))
    return both.select("new_id", best["id"].alias("old_id")).where("old_id is not null")
