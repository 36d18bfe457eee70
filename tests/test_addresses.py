"""Address classes, pieces, nearest contents, bracket groups and sparse columns against rules written out plainly, over random inputs."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import addresses, match, runs

S = ["s"]


@pytest.mark.parametrize("seed", range(3))
def test_offsets_through_pieces(spark, seed):
    rng = random.Random(seed)
    pieces, probes, want = [], [], set()
    for body in range(6):
        own, o, n = [], rng.randrange(3), rng.randrange(5)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(1, 6)
            own.append((o, n, k))
            o, n = o + k + rng.randrange(4), n + k + rng.randrange(4)
        pieces += [(0, body, *p) for p in own]
        size = rng.randrange(5, 40)
        for at in range(45):
            probes.append((0, body, at, size))
            held = [p for p in own if p[0] <= at < p[0] + p[2]]
            before = [p for p in own if p[0] + p[2] <= at]
            if held:
                to = held[0][1] + at - held[0][0]
            elif at < size and not any(p[1] <= at < p[1] + p[2] for p in own):
                to = at
            else:
                to = min(max(at + (before[-1][1] - before[-1][0] if before else 0), 0), size)
            want.add((body, at, to))
    got = addresses.segment_offset(spark.createDataFrame(probes, "s long, body long, o long, new_size long"), spark.createDataFrame(pieces, "s long, body long, old long, new long, n long"), S)
    assert {(r.body, r.o, r.mapped) for r in got.collect()} == want


def test_a_section_holds_the_address_past_its_end_unless_another_does(spark):
    f = spark.createDataFrame
    refs = f([(0, a) for a in (99, 100, 149, 150, 200, 250, 251, 0)], "s long, addr long").withColumn("self", F.lit(None).cast("long"))
    text = f([(0, 100, 150, 500)], "s long, text_lo long, text_hi long, text_new long")
    bodies = f([(0, 100, 10, 700, 10)], "s long, src long, src_size long, dst long, dst_size long")
    none = f([], "s long, body long, old long, new long, n long")
    data = f([(0, "a", 150, 200, 1000), (0, "b", 200, 250, 2000)], "s long, name string, lo long, hi long, to long")
    shifts, over = f([(0, "b", 10, 5)], "s long, name string, off long, delta long"), f([(0, 149, 9)], "s long, addr long, to long")
    got = {r.addr: (r["class"], r.target) for r in addresses.address_map(refs, text, bodies, none, data, shifts, over, S).collect()}
    assert got == {99: ("outside", None), 100: ("matched", 700), 149: ("none", 9), 150: ("data", 1000), 200: ("data", 2000), 250: ("data", 2055), 251: ("outside", None), 0: ("outside", None)}


@pytest.mark.parametrize("seed", range(3))
def test_nearest_equal_content(spark, seed):
    rng = random.Random(seed)
    old = [(i, rng.randrange(9000), rng.randrange(4)) for i in range(120)]
    new = [(i, rng.randrange(9000), rng.randrange(5)) for i in range(120)]
    want = {}
    for i, off, k in new:
        near = [(abs(o - off), j) for j, o, q in old if q == k]
        if i % 10 and near:
            want[i] = min(near)[1]
    frame = lambda rows: spark.createDataFrame(rows, "id long, off long, k long")
    done = spark.createDataFrame([(i,) for i in range(0, 120, 10)], "new_id long")
    assert {r.new_id: r.old_id for r in match.content_match(frame(old), frame(new), done, ["k"]).collect()} == want


def test_bracket_groups(spark):
    names = {"a.F[x[y]z].func12": "a.F[#].func#", "p[q": "p[#]", "p]q": "p]q", "a]b[c]d": "ab[#]d", "[a][b]": "[#][#]", "": "", "plain.func3": "plain.func#"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", keys.renumber_key(F.col("n")).alias("k")).collect()
    assert {r.n: r.k for r in got} == names


def test_zigzag(spark):
    vs = [0, -1, 1, -2, 2, 2**62, -(2**63), 2**63 - 1]
    got = spark.createDataFrame([(v,) for v in vs], "v long").select("v", keys.zigzag(F.col("v")).alias("u"), keys.unzigzag(keys.zigzag(F.col("v"))).alias("b")).collect()
    assert [r.b for r in got] == vs and [r.u for r in got[:5]] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("gaps", [[3, 0], [4, 9]])
def test_invalid_sparse_columns(spark, gaps):
    column = spark.createDataFrame([(0, i + 1, g, 7) for i, g in enumerate(gaps)], "s long, ord long, gap long, value long")
    with pytest.raises(PySparkException, match="invalid sparse column"):
        runs.sparse_decode(column, spark.createDataFrame([(0, 10)], "s long, n long"), S).collect()
