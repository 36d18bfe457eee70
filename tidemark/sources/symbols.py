"""Symbol and relocation tables as frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FUNC = r"^FUNC (?:m )?([0-9a-fA-F]+) ([0-9a-fA-F]+) ([0-9a-fA-F]+) (.+)$"


def breakpad_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(addr, size, name) of the FUNC records of Breakpad text; a malformed one is an error."""
    lines = spark.read.text(path).where(F.col("value").startswith("FUNC"))
    good = F.when(F.regexp_like("value", F.lit(_FUNC)), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("malformed record: "), "value")))
    part = lambda i: F.regexp_extract("v", _FUNC, i)
    return lines.select(good.alias("v")).select(F.conv(part(1), 16, 10).cast("long").alias("addr"), F.conv(part(2), 16, 10).cast("long").alias("size"), part(4).alias("name"))


def little_endian(data: Column, start: Column, n: int) -> Column:
    """An unsigned little-endian number of n bytes at ``start`` (from 0), as a long; bits beyond 63 wrap."""
    one = lambda k: F.conv(F.hex(F.substring(data, (start + k + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    out = one(0)
    for k in range(1, n):
        out = out.bitwiseOR(F.shiftleft(one(k), 8 * k))
    return out


def rela_entries(tables: DataFrame, by: list[str], data: str = "data") -> DataFrame:
    """(by.., ord, slot, info, addend): the 24-byte records of relocation tables with addends."""
    whole = F.when(F.octet_length(data) % 24 == 0, F.col(data)).otherwise(F.raise_error(F.lit("a relocation table is cut short")))
    rows = tables.where(F.octet_length(data) > 0).withColumn("_d", whole).withColumn("ord", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.octet_length("_d") / 24) - 1)))
    at = F.col("ord") * 24
    return rows.select(*by, "ord", *[little_endian(F.col("_d"), at + 8 * i, 8).alias(n) for i, n in enumerate(("slot", "info", "addend"))])


def elf_sections(files: DataFrame) -> DataFrame:
    """(path, name, type, addr, off, size, nobits) of the sections of 64-bit little-endian ELF files in a
    ``binaryFile`` frame (path, content); a file of another kind is an error."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, raw in zip(pdf.path, pdf.content, strict=True):
                raw = bytes(raw)
                if raw[:6] != b"\x7fELF\x02\x01":
                    raise ValueError(f"{path} is not a 64-bit little-endian ELF file")
                table, = struct.unpack_from("<Q", raw, 40)
                each, n, names = struct.unpack_from("<HHH", raw, 58)
                heads = [struct.unpack_from("<IIQQQQ", raw, table + each * i) for i in range(n)]
                base = heads[names][4] if n else 0
                for name, kind, _, addr, off, size in heads:
                    label = raw[base + name : raw.index(b"\0", base + name)].decode()
                    out.append((path, label, kind, addr, off, size, kind == 8))
            yield pd.DataFrame(out, columns=["path", "name", "type", "addr", "off", "size", "nobits"])

    return files.select("path", "content").mapInPandas(scan, "path string, name string, type int, addr long, off long, size long, nobits boolean")


def elf_functions(files: DataFrame) -> DataFrame:
    """(path, addr, size, name) of the function symbols of ELF files, without other kinds."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, raw in zip(pdf.path, pdf.content, strict=True):
                raw = bytes(raw)
                table, = struct.unpack_from("<Q", raw, 40)
                each, n, _ = struct.unpack_from("<HHH", raw, 58)
                heads = [struct.unpack_from("<IIQQQQII", raw, table + each * i) for i in range(n)]
                for h in heads:
                    if h[1] == 2:
                        text = heads[h[6]][4]
                        for at in range(h[4], h[4] + h[5], 24):
                            name, info, _, _, addr, size = struct.unpack_from("<IBBHQQ", raw, at)
                            if info & 15 == 2:
                                out.append((path, addr, size, raw[text + name : raw.index(b"\0", text + name)].decode()))
            yield pd.DataFrame(out, columns=["path", "addr", "size", "name"])

    return files.select("path", "content").mapInPandas(scan, "path string, addr long, size long, name string")
