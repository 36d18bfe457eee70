"""Sharding by a Feistel permutation with cycle walking over global row numbers.

A row's number is its place in the table's own order; the permutation maps it to a place in a shuffled
order of the same length, and shard and slot are that place modulo and divided by the shard count. So the
shuffle is reproducible, row counts differ by at most one, and either way between row and (shard, slot)
is computable without the data.

Null texts count as no bytes; empty tables give empty shards; rows equal in every ordering column are
interchangeable, so repeated rows get distinct places in either order. Extra columns pass through, but for
columns named row_no, shard or slot, which the results replace.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, global_rank, partitions_for

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Feistel:
    """A bijection of 0..n-1: a balanced network over the least even-bit domain that holds n, walked along
    its cycle until the value falls below n (under four steps on average, since the domain is below 4n)."""

    def __init__(self, n: int, seed: int = 0):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [int(_mix(np.array([seed * ROUNDS + r + 1], dtype=np.uint64), 0x5851F42D4C957F2D)[0]) for r in range(ROUNDS)]

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & mask
        for k in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        return (left << h) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        out = self._pass(np.asarray(x, dtype=np.uint64), back)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._pass(out[far], back)
        return out.astype(np.int64)

    def forward(self, row) -> np.ndarray:
        return self._walk(row, False)

    def inverse(self, place) -> np.ndarray:
        return self._walk(place, True)


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = int(Feistel(n, seed).forward([row])[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number at (shard, slot)."""
    return int(Feistel(n, seed).inverse([slot * shards + shard])[0])


def shard_rows(df: DataFrame, order_by: list[str], shards: int, seed: int = 0) -> DataFrame:
    """df with row_no, shard and slot. ``order_by`` fixes the row numbers; rows equal in it must be interchangeable.

    One range shuffle of df as given: project the columns that are needed first, join the rest later.
    """
    spark = df.sparkSession
    ranked, n = global_rank(Scratch(spark, "shards"), df, order_by, partitions_for(spark), "_tm_row")
    feistel = Feistel(n, seed)

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(feistel.forward(row.to_numpy()))

    return ranked.withColumn("_tm_place", place("_tm_row")).select(
        *[F.col(f"`{c}`") for c in df.columns if c not in ("row_no", "shard", "slot")],
        F.col("_tm_row").alias("row_no"),
        F.expr(f"cast(_tm_place % {shards} as int)").alias("shard"),
        F.expr(f"_tm_place div {shards}").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """The sharded rows as Parquet, one folder for each shard, in slot order within each file."""
    parts = partitions_for(sharded.sparkSession)
    sharded.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
