import struct

import pytest

from tidemark.sources import symbols

# Literal vectors that results must match.


def test_breakpad(spark, tmp_path):
    (tmp_path / "good.sym").write_text("MODULE Linux x86_64 0 a\nFUNC 1000 20 0 foo(int)\nFUNC m 1040 8 0 bar\n1000 4 1 1\n")
    got = symbols.breakpad_symbols(spark, str(tmp_path / "good.sym"))
    assert sorted(map(tuple, got.collect())) == [(0x1000, 0x20, "foo(int)"), (0x1040, 8, "bar")]
    (tmp_path / "bad.sym").write_text("FUNC 1000\n")
    with pytest.raises(Exception, match="malformed"):
        symbols.breakpad_symbols(spark, str(tmp_path / "bad.sym")).collect()


def test_rela(spark):
    raw = struct.pack("<QQQQQq", 0x1000, 8, 0x9000, 0x1010, 8, -16)
    df = spark.createDataFrame([(0, bytearray(raw)), (1, bytearray())], "section long, data binary")
    assert sorted(map(tuple, symbols.rela_entries(df, ["section"]).collect())) == [(0, 0, 0x1000, 8, 0x9000), (0, 1, 0x1010, 8, -16)]
    with pytest.raises(Exception, match="cut short"):
        symbols.rela_entries(spark.createDataFrame([(0, bytearray(raw[:-1]))], "section long, data binary"), ["section"]).collect()


def test_elf(spark, tmp_path):
    names, strings = b"\0.text\0.symtab\0.strtab\0.shstrtab\0", b"\0main\0data\0"
    syms = b"".join(struct.pack("<IBBHQQ", *s) for s in ((0, 0, 0, 0, 0, 0), (1, 2, 0, 1, 0x401000, 0x30), (6, 1, 0, 1, 0x402000, 8)))
    body = b"\x90" * 64 + syms + strings + names
    at = 64 + len(body)
    head = struct.pack("<16sHHIQQQIHHHHHH", b"\x7fELF\x02\x01\x01", 2, 62, 1, 0, 0, at, 0, 64, 0, 0, 64, 5, 4)
    section = lambda name, kind, addr, off, size, link=0: struct.pack("<IIQQQQIIQQ", name, kind, 0, addr, off, size, link, 0, 1, 0)
    o = 64 + 64
    table = section(0, 0, 0, 0, 0) + section(1, 1, 0x401000, 64, 64) + section(7, 2, 0, o, len(syms), 3) + section(15, 3, 0, o + len(syms), len(strings)) + section(23, 3, 0, o + len(syms) + len(strings), len(names))
    (tmp_path / "a.elf").write_bytes(head + body + table)
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.elf"))
    assert {r["name"] for r in symbols.elf_sections(files).collect()} == {"", ".text", ".symtab", ".strtab", ".shstrtab"}
    assert [tuple(r)[1:] for r in symbols.elf_functions(files).collect()] == [(0x401000, 0x30, "main")]
