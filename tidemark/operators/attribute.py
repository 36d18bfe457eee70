"""Where the change went and what it costs: counts, shares, entropies, fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positional_diff_count(old: DataFrame, new: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by.., wrong): places (ord) where the values differ or only one side has one."""
    both = old.select(*by, "ord", F.col(value).alias("_a")).join(new.select(*by, "ord", F.col(value).alias("_b")), [*by, "ord"], "full_outer")
    return both.groupBy(*by).agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("wrong"))


def error_by_segment(diffs: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """(by.., name, wrong): differing positions (pos) by the segment (name, lo, hi) that holds them, by a bucketed equi-join."""
    from tidemark.operators.lookup import overlaps

    a = diffs.select(*by, "pos", F.col("pos").alias("a_lo"), (F.col("pos") + 1).alias("a_hi"))
    b = segments.select(*by, "name", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    return overlaps(a, b, by).groupBy(*by, "name").agg(F.count("*").alias("wrong"))


def top_share(values: DataFrame, by: list[str], value: str, k: int = 3) -> DataFrame:
    """(by.., rank, value, n, total): the k most frequent values with their counts and the count of all."""
    each = values.groupBy(*by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), value)
    told = each.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    return told.where(F.col("rank") <= k)


def entropy_by_group(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by.., n, bits): the order-0 entropy of a group's values, in bits for the whole group."""
    each = values.groupBy(*by, value).agg(F.count("*").alias("c"))
    # sum of -c log2(c / n) = n log2 n - sum of c log2 c: one pass of partial sums.
    out = each.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("_s"))
    return out.select(*by, "n", (F.col("n") * F.log2("n") - F.col("_s")).alias("bits"))


def adaptive_bits(values: DataFrame, by: list[str], value: str, alphabet: int = 256) -> DataFrame:
    """(by.., n, bits): what a group costs under its own counts, each value's raised by a half so that none is free or
    impossible."""
    each = values.groupBy(*by, value).agg(F.count("*").alias("c"))
    out = each.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2(F.col("c") + 0.5)).alias("_s"))
    return out.select(*by, "n", (F.col("n") * F.log2(F.col("n") + alphabet / 2) - F.col("_s")).alias("bits"))


def largest_first(rows: DataFrame, amount: str, ties: list[str], k: int) -> DataFrame:
    """The k rows of the largest amount, with their rank: a top-k report."""
    top = rows.orderBy(F.desc(amount), *ties).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(amount), *ties)).cast("long"))


def yardstick_fit(rows: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """One row (coef_a, coef_b): least squares of y on a and b without intercept, from five sums."""
    s = lambda p, q: F.sum(F.col(p).cast("double") * F.col(q).cast("double"))
    sums = rows.agg(s(a, a).alias("aa"), s(a, b).alias("ab"), s(b, b).alias("bb"), s(a, y).alias("ay"), s(b, y).alias("by"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    return sums.select(((F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / det).alias("coef_a"), ((F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / det).alias("coef_b"))


def churn_summary(cells: DataFrame, by: list[str], gap: int = 8, long_run: int = 16) -> DataFrame:
    """(by.., cells, differing, runs, merged, longest_same, in_long_same): cells (ord, same); runs of differing
    cells, those left when gaps of at most ``gap`` are bridged, the unchanged runs' longest and long total, and the differing runs' median (null without any)."""
    order = Window.partitionBy(*by).orderBy("ord")
    marked = cells.withColumn("_c", (~F.col("same").eqNullSafe(F.lag("same").over(order))).cast("long"))
    marked = marked.withColumn("_r", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*by, "_r").agg(F.first("same").alias("same"), F.count("*").alias("n"))
    edge = Window.partitionBy(*by)
    runs = runs.withColumn("_inner", (F.col("_r") > F.min("_r").over(edge)) & (F.col("_r") < F.max("_r").over(edge)))
    whole = lambda cond, v=None: F.coalesce(F.sum(F.when(cond, F.lit(1) if v is None else F.col(v))), F.lit(0)).cast("long")
    differ = ~F.col("same")
    return runs.groupBy(*by).agg(
        F.sum("n").alias("cells"),
        whole(differ, "n").alias("differing"),
        whole(differ).alias("runs"),
        (whole(differ) - whole(F.col("same") & F.col("_inner") & (F.col("n") <= gap))).alias("merged"),
        F.coalesce(F.max(F.when(F.col("same"), F.col("n"))), F.lit(0).cast("long")).alias("longest_same"),
        whole(F.col("same") & (F.col("n") >= long_run), "n").alias("in_long_same"),
        F.percentile(F.when(differ, F.col("n")), 0.5).alias("median_run"),
    )
