"""Keys under which records of two versions are paired, as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_key(name: Column) -> Column:
    """Compiler-numbered suffixes without their numbers: .func3, .deferwrap1, .gowrap2 become .func#, ..."""
    for kind in ("func", "deferwrap", "gowrap"):
        name = F.regexp_replace(name, rf"\.{kind}[0-9]+", f".{kind}#")
    return name


def renumber_key(name: Column) -> Column:
    """The normalised key with each outermost bracket group, whatever nests in it, as [#]. A group that is not closed
    reaches to the end; a closing bracket without an opening one is dropped if the name has any opening one."""
    key = normalize_key(name)
    tokens = F.regexp_extract_all(key, F.lit(r"(\[|\]|[^\[\]]+)"), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(s: Column, t: Column) -> Column:
        outside = s["depth"] == 0
        opened = F.struct((s["depth"] + 1).alias("depth"), F.when(outside, F.concat(s["out"], F.lit("[#]"))).otherwise(s["out"]).alias("out"))
        closed = F.struct(F.greatest(s["depth"] - 1, F.lit(0)).alias("depth"), s["out"].alias("out"))
        other = F.struct(s["depth"].alias("depth"), F.when(outside, F.concat(s["out"], t)).otherwise(s["out"]).alias("out"))
        return F.when(t == "[", opened).when(t == "]", closed).otherwise(other)

    return F.when(F.contains(key, F.lit("[")), F.aggregate(tokens, start, step)["out"]).otherwise(key)


def name_key(name: Column) -> Column:
    """The last name component outside brackets, without trailing digits; ``P|`` marks a pointer receiver and
    a method-value suffix is a key of its own."""
    bare = F.regexp_replace(name, r"\[.*\]", "")
    last = F.regexp_replace(F.regexp_extract(bare, r"([^.]*)$", 1), r"[0-9]+$", "")
    return F.when(name.endswith("-fm"), "fm").when(F.regexp_like(bare, F.lit(r"\(\*[^()]*\)\.[^.]*$")), F.concat(F.lit("P|"), last)).otherwise(last)


def canonical_name(name: Column) -> Column:
    """Rust v0 names with the crate disambiguators emptied; other names as they are."""
    return F.when(name.startswith("_R"), F.regexp_replace(name, r"Cs[0-9A-Za-z]*_(?=[0-9])", "Cs_")).otherwise(name)


def masked_hash(text: Column) -> Column:
    """A digest that ignores the digits of a text: equal for contents that differ in volatile numbers only."""
    return F.md5(F.regexp_replace(text, "[0-9]+", "#"))


def is_code_window(name: Column) -> Column:
    return F.array_contains(F.split(name, r"\."), "text")


def align_up(v: Column, a: int | Column) -> Column:
    return v + F.pmod(-v, a if isinstance(a, Column) else F.lit(a))


def run_bucket(n: Column) -> Column:
    """0 to 4 for run lengths 1 to 5 and over."""
    return F.least(n, F.lit(5)) - 1


def magnitude(n: Column) -> Column:
    """Class 0 for 0, else one more than the floor of log2 of the size."""
    return F.length(F.regexp_replace(F.bin(F.abs(n)), "^0$", "")).cast("int")


def worth_of(price: Column, n: Column, rate: Column) -> Column:
    """What ``n`` bytes may cost at a price and a rate, in whole units; nothing at no price."""
    return F.when(price <= 0, F.lit(0).cast("long")).otherwise(F.call_function("div", F.least(price, F.lit(1 << 24)).cast("long") * n, rate))


def zigzag(v: Column) -> Column:
    """Signed numbers as unsigned ones of like size: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1).cast("long")))


def coder_pays(coded: Column, incumbent: Column, least: int = 2048) -> Column:
    """Whether a slow coder's size is worth its time: it saves more than ``least`` bytes and more than a tenth."""
    return coded + F.greatest(F.lit(least).cast("long"), F.call_function("div", incumbent, F.lit(10))) < incumbent
