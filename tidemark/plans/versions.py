"""diff, patch and verify for keyed tables.

A plan is a table of changes: ``delete`` with the key, ``put`` with the whole new row. Patching applies it
with one join on the key; verification compares order-free digests, so nothing is sorted or collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As ``diff``, with _known: whether old has the key."""
    fields = [c for c in new.columns if c not in keys]
    a, b = old.select(*keys, F.struct(*fields).alias("_a")), new.select(*keys, F.struct(*fields).alias("_b"))
    both = a.join(b, keys, "full_outer")
    op = F.when(F.col("_b").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "put")
    return both.withColumn("op", op).where("op is not null").select("op", *keys, *[F.col(f"_b.{c}").alias(c) for c in fields], F.col("_a").isNotNull().alias("_known"))


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(op, new's columns): what turns old into new. Keys are unique on each side."""
    return changes(old, new, keys).drop("_known")


def patch(old: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """old with the plan applied; an unknown op is an error."""
    known = F.when(F.col("op").isin("delete", "put"), F.col("op")).otherwise(F.raise_error(F.lit("unknown op in a plan")))
    plan = plan.withColumn("op", known)
    kept = old.join(plan.select(*keys), keys, "left_anti")
    return kept.unionByName(plan.where("op = 'put'").select(*old.columns))


def digest(df: DataFrame) -> DataFrame:
    """One row (n, digest): equal for tables with equal rows in any order."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    # 28 bits a part: sums of longs, which hold 2 ** 35 rows; five parts are 140 bits.
    parts = [F.coalesce(F.sum(F.conv(F.substring(h, 1 + 7 * i, 7), 16, 10).cast("long")), F.lit(0).cast("long")) for i in range(5)]
    return df.agg(F.count("*").alias("n"), F.concat_ws("-", *parts).alias("digest"))


def verify(got: DataFrame, want: DataFrame) -> bool:
    return got.count() == want.count() and digest(got).first() == digest(want).first()


def reconstruct(old: DataFrame, plan: DataFrame, keys: list[str], want: tuple) -> DataFrame:
    """The patched table, only if its digest (n, digest) is the wanted one."""
    out = patch(old, plan, keys)
    if tuple(digest(out).first()) != tuple(want):
        raise ValueError("the patched table does not have the wanted digest")
    return out
