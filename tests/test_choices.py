"""Choices of modes, forms and strategies, boundaries and overlaps against rules written out plainly, over random inputs."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunks, predict, runs
from tidemark.plans import strategies

S = ["s"]


def regions(pred, want):
    out = []
    for i in [i for i in range(len(want)) if pred[i] != want[i]]:
        if out and i - out[-1][1] < 32 + 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [(a // 8 * 8, min(b // 8 * 8 + 8, len(want))) for a, b in out]


def modes(pred, want):
    spans = regions(pred, want)
    form = lambda m, a, b: [(w, w ^ p, (w - p) % 256)[m] for p, w in zip(pred[a:b], want[a:b], strict=True)]
    chosen = {a: (None, 0) for a, _ in spans}
    for _ in range(3):
        model = [Counter() for _ in range(3)]
        for a, b in spans:
            model[chosen[a][1]].update(form(chosen[a][1], a, b))
        bits = lambda m, v: math.log2(sum(model[m].values()) + 128) - math.log2(model[m][v] + 0.5)  # noqa: B023, E731
        chosen = {a: min((round(sum(bits(m, v) for v in form(m, a, b)), 6), m) for m in range(3)) for a, b in spans}
    return chosen


@pytest.mark.parametrize("seed", range(3))
def test_modes_of_regions(spark, seed):
    rng = random.Random(seed)
    pred = [rng.randrange(256) for _ in range(8000)]
    want = [5] * 1500 + pred[1500:]  # the wanted bytes themselves are cheapest here
    for _ in range(40):
        at, kind = rng.randrange(1600, 7990), rng.randrange(3)
        for i in range(at, min(at + rng.randrange(1, 40), 8000)):
            want[i] = (rng.randrange(3), pred[i] ^ 16, (pred[i] + 1) % 256)[kind]
    cells = spark.createDataFrame([(0, i, p, w) for i, (p, w) in enumerate(zip(pred, want, strict=True))], "s long, pos long, pred long, want long")
    assert {(r.start, r.end) for r in runs.word_regions(cells, S).collect()} == set(regions(pred, want))
    told, got = modes(pred, want), {r.start: (r.bits, r.mode) for r in runs.region_modes(cells, S).collect()}
    assert {a: m for a, (_, m) in got.items()} == {a: m for a, (_, m) in told.items()}
    assert all(abs(got[a][0] - told[a][0]) < 1e-4 for a in told) and len({m for _, m in got.values()}) > 1


def test_equal_cells_have_no_region(spark):
    cells = spark.createDataFrame([(0, i, 7, 7) for i in range(9)], "s long, pos long, pred long, want long")
    assert runs.region_modes(cells, S).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        runs.word_regions(cells, S, 6, 8)


@pytest.mark.parametrize("seed", range(3))
def test_boundaries_and_extents(spark, seed):
    rng = random.Random(seed)
    code = [0xCC if rng.random() < 0.5 else rng.randrange(200) for _ in range(400)]
    cells = spark.createDataFrame([(0, i, v) for i, v in enumerate(code)], "s long, pos long, value long")
    want = {0} | {i for i in range(8, 400, 8) if code[i] != 0xCC and code[i - 1] == 0xCC}
    assert sorted(r.pos for r in runs.boundaries(cells, S).collect()) == sorted(want)
    spans = [(0, a, rng.randrange(a, 401)) for a in range(0, 400, 7)]
    size = {(a, b): len(bytes(code[a:b]).rstrip(b"\xcc")) for _, a, b in spans}
    assert {(r.start, r.next): r.size for r in runs.padding_extent(spark.createDataFrame(spans, "s long, start long, next long"), cells, S).collect()} == size


@pytest.mark.parametrize("seed", range(3))
def test_bodies_kept(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(2), i, rng.randrange(300), rng.randrange(30)) for i in range(120)]
    want, end = set(), {0: 0, 1: 0}
    for s, i, d, n in sorted(rows, key=lambda r: (r[2], r[1])):
        if d >= end[s]:
            want.add(i)
            end[s] = d + n
    assert {r.idx for r in predict.drop_overlaps(spark.createDataFrame(rows, "s long, idx long, dst long, size long"), "s").collect()} == want


def test_smallest_forms(spark):
    values = [None, b"", b"a", b"ab" * 5000, os.urandom(300), bytes(range(256)) * 40]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, v binary").withColumn("f", chunks.smallest_form("v"))
    got = sorted(rows.select("id", "f.codec", F.octet_length("f.packed").alias("n"), chunks.restored("f.codec", "f.packed").alias("v")).collect())
    assert [None if r.v is None else bytes(r.v) for r in got] == values
    assert [r.codec for r in got[:3]] == [None, "raw", "raw"] and got[4].codec == "raw" and got[3].n < 100


def test_strategies(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    more = old.unionAll(spark.createDataFrame([(3, None)], old.schema))
    other = spark.createDataFrame([(1, "x"), (3, "b")], old.schema)
    registry = strategies.Registry()
    for new, taken in ((old, 1), (more, 2), (other, 0), (old.limit(0), 0)):
        patch = strategies.encode(old, new, ["id"], registry)
        assert patch.strategy == taken
        assert sorted(strategies.apply(old, patch, registry).collect(), key=str) == sorted(new.collect(), key=str)
    assert strategies.encode(old, old, ["id"], registry, {"appended"}).strategy == 2
    assert strategies.encode(old, old, ["id"], registry, set()).strategy == 0
    with pytest.raises(ValueError, match="columns"):
        strategies.encode(old, old.withColumn("w", F.lit(1)), ["id"], registry)
    with pytest.raises(ValueError, match="twice"):
        registry.add(strategies.Same())
    with pytest.raises(ValueError, match="digest"):
        strategies.apply(other, strategies.encode(old, old, ["id"], registry), registry)
    with pytest.raises(ValueError, match="no strategy"):
        strategies.apply(old, strategies.encode(old, old, ["id"], registry), strategies.Registry(strategies.Changes()))


def test_few_bytes_are_held_at_once(spark):
    import pyarrow as pa

    values = [b"a" * n for n in (5, 0, 3, 40, 1, 9, 2)] + [None]
    cuts = list(chunks.held(pa.array(values, pa.binary()), 10))
    assert [values[c] for c in cuts] == [values[:3], values[3:4], values[4:6], values[6:]]
    rows = [(i, os.urandom(5) * (i % 400 * 100)) for i in range(900)]
    back = spark.createDataFrame(rows, "id long, v binary").repartition(2).withColumn("f", chunks.smallest_form("v"))
    assert back.where(chunks.restored("f.codec", "f.packed") == F.col("v")).count() == len(rows)
