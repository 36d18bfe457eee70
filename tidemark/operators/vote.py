"""Settling disagreements: majorities, modes and choices. All are partial sums before a shuffle on the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority_vote(votes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., o, n, count, total): for each o the most frequent n, the smallest on a tie."""
    by = [*(by or []), "o"]
    each = votes.groupBy(*by, "n").agg(F.count("*").alias("c"))
    best = each.groupBy(*by).agg(F.max(F.struct("c", (-F.col("n")).alias("m"))).alias("b"), F.sum("c").alias("total"))
    return best.select(*by, (-F.col("b.m")).alias("n"), F.col("b.c").alias("count"), "total")


def vote_overrides(votes: DataFrame, predicted: DataFrame) -> DataFrame:
    """(o, n) where at least two votes and more than half of them disagree with the prediction (o, pred)."""
    won = majority_vote(votes).join(predicted, "o")
    return won.where((F.col("n") != F.col("pred")) & (F.col("count") >= 2) & (2 * F.col("count") > F.col("total"))).select("o", "n")


def modal_template(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row: the most frequent value of each field, the smallest on a tie."""
    return rows.agg(*[F.mode(f, True).alias(f) for f in fields])


def modal_by_key_with_default(rows: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """wanted with value: the mode of its key, else the mode of all."""
    own = rows.groupBy(key).agg(F.mode(value, True).alias("_own"))
    everyone = rows.agg(F.mode(value, True).alias("m")).first()["m"]
    return wanted.join(own, key, "left").withColumn(value, F.coalesce("_own", F.lit(everyone))).drop("_own")


def group_and_clip(symbols: DataFrame, by: list[str]) -> DataFrame:
    """(by.., addr, size, names): symbols (addr, size, name) grouped by address, the largest size cut at the next
    address, names sorted; empty units are dropped."""
    units = symbols.groupBy(*by, "addr").agg(F.max("size").alias("size"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    nxt = F.lead("addr").over(Window.partitionBy(*by).orderBy("addr"))
    return units.withColumn("size", F.least("size", F.coalesce(nxt - F.col("addr"), F.col("size")))).where("size > 0")


def argmin_choice(rows: DataFrame, by: list[str], first: Column, second: Column) -> DataFrame:
    """(by.., first_wrong, second_wrong, chosen): the second only where it is wrong strictly less often."""
    wrong = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0).cast("long")))
    out = rows.groupBy(*by).agg(wrong(first).alias("first_wrong"), wrong(second).alias("second_wrong"))
    return out.withColumn("chosen", F.when(F.col("second_wrong") < F.col("first_wrong"), "second").otherwise("first"))


def remap_by_vote(sites: DataFrame) -> DataFrame:
    """(pred, to, votes, correct): sites (pred, want) grouped by predicted target; wrong sites vote for the target
    they want, right ones to stay; the most votes win, the smallest target on a tie, if more than those to stay."""
    each = sites.groupBy("pred", "want").agg(F.count("*").alias("c"))
    wrong, right = F.col("want") != F.col("pred"), F.col("want") == F.col("pred")
    out = each.groupBy("pred").agg(
        F.max(F.when(wrong, F.struct("c", (-F.col("want")).alias("m")))).alias("b"), F.coalesce(F.max(F.when(right, F.col("c"))), F.lit(0).cast("long")).alias("correct")
    )
    return out.where(F.col("b").isNotNull() & (F.col("b.c") > F.col("correct"))).select("pred", (-F.col("b.m")).alias("to"), F.col("b.c").alias("votes"), "correct")


def modal_shape(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row: the most frequent combination of the fields, the smallest on a tie."""
    return rows.groupBy(*fields).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *fields).limit(1)


def field_residuals(sites: DataFrame, remap: DataFrame, by: list[str]) -> DataFrame:
    """(by.., idx, delta): what the remap (pred, to) leaves wrong of sites (by.., idx, pred, want), in site order."""
    fixed = F.coalesce("to", "pred")
    left = sites.join(remap.select("pred", "to"), "pred", "left").where(fixed != F.col("want"))
    return left.select(*by, "idx", (F.col("want") - fixed).alias("delta"))


def best_variant(candidates: DataFrame, by: list[str]) -> DataFrame:
    """(by.., variant, gain): each span's variant of the greatest gain, the first on a tie, where it gains anything."""
    best = F.max(F.struct("gain", (-F.col("variant")).alias("v"))).alias("b")
    return candidates.where("gain > 0").groupBy(*by).agg(best).select(*by, (-F.col("b.v")).alias("variant"), F.col("b.gain").alias("gain"))
