"""What several operators share: scratch tables, input checks, whole-table ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java character class body.
SPACE = r"\x20\x09-\x0D"
#: A word: a run of anything else.
WORD = rf"[^{SPACE}]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; in local mode, where none is set, as in tests, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Written tables that cut lineage: a lost executor costs a re-read, not a re-computation.

    ``keep`` writes and re-reads a frame; ``drop`` removes tables that nothing needs any more. Tables a
    returned frame still reads stay in the shared folder, which its owner clears.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths, self.count = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", {}, 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{name}-{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path, _ = self.paths.pop(id(df), (None, None))
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        jvm.System.gc()  # lets Spark's cleaner remove the shuffle files behind them


def once(expr: Column, name: str) -> Column:
    """The expression in a select, computed once a row: as a generator of one row it is not copied into the
    lambdas that use it."""
    return F.inline(F.array(F.struct(expr.alias(name))))


def slices(batches, rows: int = 1024):
    """Arrow batches cut to so many rows, which bounds what a Python worker holds at once."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def hidden(df: DataFrame) -> list[Column]:
    """df's columns under names that no operator makes: _tm_c0, _tm_c1, ..."""
    return [F.col(f"`{c}`").alias(f"_tm_c{i}") for i, c in enumerate(df.columns)]


def shown(df: DataFrame, made: tuple = ()) -> list[Column]:
    """The inverse of hidden, without the columns that results replace."""
    return [F.col(f"_tm_c{i}").alias(c) for i, c in enumerate(df.columns) if c not in made]


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def word_count(text: Column) -> Column:
    """Words of the text; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def lower_ascii(text: Column) -> Column:
    """A-Z only: other letters keep their case, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def global_rank(scratch: Scratch, df: DataFrame, keys: list[str], partitions: int, name: str = "pos") -> tuple[DataFrame, int]:
    """(df with ``name``: the row's place from 0 in the order of ``keys``; the number of rows).

    Range-partitions and sorts once, writes the sorted runs, counts each run and adds the counts of the
    runs before it: no task sees more than its run, and the driver gets one number for each run. Rows equal
    in all keys are spread by their place in the input; they must be interchangeable to the caller.
    """
    spread = df.withColumn("_tm_spread", F.monotonically_increasing_id())
    runs = spread.repartitionByRange(partitions, *keys, "_tm_spread").sortWithinPartitions(*keys, "_tm_spread").drop("_tm_spread")
    base = F.lit(1 << 33)
    runs = scratch.keep(runs.withColumn("_tm_id", F.monotonically_increasing_id()), "runs")
    runs = runs.withColumn("_tm_run", F.floor(F.col("_tm_id") / base).cast("long"))
    counts = sorted((r["_tm_run"], r["n"]) for r in runs.groupBy("_tm_run").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for run, n in counts:
        starts.append((run, total))
        total += n
    if not starts:
        return runs.withColumn(name, F.lit(0).cast("long")).drop("_tm_id", "_tm_run"), 0
    first = F.broadcast(scratch.spark.createDataFrame(starts, "_tm_run long, _tm_first long"))  # a row a run
    placed = runs.join(first, "_tm_run").withColumn(name, F.col("_tm_id") - F.col("_tm_run") * base + F.col("_tm_first"))
    return placed.drop("_tm_id", "_tm_run", "_tm_first"), total


def partitions_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
