"""Chunks of byte columns: fixed and content-defined, novelty between versions, tree hashes."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType


def fixed_chunks(rows: DataFrame, size: int, by: list[str], data: str = "data") -> DataFrame:
    """(by.., chunk_no, n, hash): cuts every ``size`` bytes; nothing of an empty value."""
    cut = rows.where(F.octet_length(data) > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length(data) - 1) / size))))
    piece = F.substring(F.col(data), (F.col("chunk_no") * size + 1).cast("int"), F.lit(size))
    return cut.select(*by, "chunk_no", piece.alias("_p")).select(*by, "chunk_no", F.octet_length("_p").cast("long").alias("n"), F.sha2("_p", 256).alias("hash"))


def chunk_novelty(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row (chunks, novel, novel_bytes): distinct new chunks (hash, n), and those no old chunk equals."""
    each = new.groupBy("hash").agg(F.first("n").alias("n"))
    told = each.join(old.select("hash", F.lit(1).alias("_o")).distinct(), "hash", "left")
    return told.agg(F.count("*").alias("chunks"), F.count_if(F.col("_o").isNull()).alias("novel"), F.coalesce(F.sum(F.when(F.col("_o").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("novel_bytes"))


def chunk_tree_hash(chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by.., tree): the digest of a value's chunk digests in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "hash"))), lambda c: c["hash"])
    return chunks.groupBy(*by).agg(F.sha2(F.array_join(ordered, ""), 256).alias("tree"))


@functools.cache
def _gear() -> np.ndarray:
    """256 random words of a seeded generator, so that cuts can be compared."""
    return np.random.default_rng(0x5EED).integers(0, 2**64, 256, dtype=np.uint64)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the last 64 bytes' words, each shifted by its distance; by doubling the reach."""
    h, reach = _gear()[data], 1
    while reach < 64:
        far = h.copy()
        far[reach:] += h[:-reach] << np.uint64(reach)
        h, reach = far, 2 * reach
    return h


def cut_points(data: bytes, average: int) -> list[int]:
    """Ends of content-defined chunks, where masked bits of the gear hash are zero: two more bits than the average
    asks up to it, two fewer beyond; a quarter and four times it are the bounds."""
    raw = np.frombuffer(data, dtype=np.uint8)
    h, bits, n = gear_hashes(raw), average.bit_length() - 1, len(raw)
    strict, loose = (np.flatnonzero((h & np.uint64(((1 << b) - 1) << 40)) == 0) for b in (bits + 2, bits - 2))
    ends, at = [], 0

    def first(among: np.ndarray, lo: int, hi: int) -> int | None:
        i = np.searchsorted(among, lo)
        return int(among[i]) + 1 if i < len(among) and among[i] < hi else None

    while n - at > average // 4:
        most = min(at + 4 * average, n)
        at = first(strict, at + average // 4, min(at + average, n)) or first(loose, at + average, most) or most
        ends.append(at)
    return ends if at == n else [*ends, n]


def content_chunks(rows: DataFrame, average: int, by: list[str], data: str = "data") -> DataFrame:
    """As fixed_chunks, at content-defined boundaries. Each cut depends on the one before: one row is one
    sequence, rows run in parallel in Arrow batches."""
    cut = F.pandas_udf(lambda s: pd.Series([[] if v is None else cut_points(v, average) for v in s]), "array<int>")
    ends = rows.withColumn("_e", cut(data)).select(*by, data, "_e", F.posexplode("_e").alias("_i", "_end"))
    start = F.coalesce(F.get("_e", F.col("_i") - 1), F.lit(0))
    piece = F.substring(F.col(data), start + 1, F.col("_end") - start)
    return ends.select(*by, F.col("_i").cast("long").alias("chunk_no"), piece.alias("_p")).select(*by, "chunk_no", F.octet_length("_p").cast("long").alias("n"), F.sha2("_p", 256).alias("hash"))


@functools.cache
def _zstd() -> tuple:
    """A compressor and a decompressor, one pair a worker: each holds tables of some megabytes."""
    return zstandard.ZstdCompressor(level=9), zstandard.ZstdDecompressor()


_FORMS = {
    "raw": (bytes, bytes),
    "zstd": (lambda b: _zstd()[0].compress(b), lambda b: _zstd()[1].decompress(b)),
    "zlib": (lambda b: zlib.compress(b, 9), zlib.decompress),
}

#: Bytes of values that are objects in a worker at once; a longer value is alone.
HELD = 1 << 20


def held(values: pa.Array, most: int = HELD) -> Iterator[slice]:
    """Cuts of a binary array into stretches of at most so many bytes, or of one value."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


_FORM = pa.struct([("codec", pa.string()), ("packed", pa.binary())])


@F.arrow_udf(StructType().add("codec", StringType()).add("packed", BinaryType()))
def smallest_form(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each value in the smallest of its raw, zstd and zlib forms, the first of them on a tie; null of null."""
    for values in batches:
        for cut in held(values):
            best = [(None, None) if v is None else min(((n, pack(v)) for n, (pack, _) in _FORMS.items()), key=lambda f: len(f[1])) for v in values[cut].to_pylist()]
            codecs, packed = zip(*best, strict=True)
            yield pa.StructArray.from_arrays([pa.array(codecs, pa.string()), pa.array(packed, pa.binary())], fields=list(_FORM))


@F.arrow_udf(BinaryType())
def restored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The values of ``smallest_form`` again; an unknown codec is an error."""
    for codecs, packed in batches:
        for cut in held(packed):
            yield pa.array([None if c is None else _FORMS[c][1](p) for c, p in zip(codecs[cut].to_pylist(), packed[cut].to_pylist(), strict=True)], pa.binary())
