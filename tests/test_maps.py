"""Maps, relocations, content-defined cuts and image layout against rules written out plainly, over random inputs."""

import random

import numpy as np
import pytest

from tidemark.operators import align, chunks, maps, predict, reloc

S = ["s"]


def up(v, a):
    return -(-v // a) * a


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def random_units(rng, n_old, n_new):
    old = [(0, i, rng.randrange(1, 90)) for i in range(n_old)]
    new, end, at = [], 0, 0
    for i in range(n_new):
        size = rng.randrange(1, 90)
        off = up(end, 16) + (rng.choice([0, 4, 24]) if rng.random() < 0.1 else 0)
        src = None if rng.random() < 0.15 or not n_old else min(n_old - 1, at) if rng.random() < 0.8 else rng.randrange(n_old)
        at = at if src is None else src + 1 + (rng.random() < 0.2)
        if src is not None and rng.random() < 0.6:
            size = old[src][2]
        new.append((0, i, off, size, src))
        end = off + size
    return old, new


def coded(old, new):
    """The coding, unit by unit."""
    kept = sorted({u[4] for u in new if u[4] is not None})
    after = lambda o: next((k for k in kept if k > o), len(old))
    out, cursor, end = {("units", 0, len(new))}, after(-1), 0
    best = max((1, 2, 4, 8, 16, 32, 64), key=lambda a: (sum(u[2] == up(p[2] + p[3] if p else 0, a) for p, u in zip([None, *new], new, strict=False)), -a))
    out.add(("align", 0, best))
    gone = [i for i in range(len(old)) if i not in kept]
    for i in gone:
        if i - 1 not in gone:
            out.add(("drop", i, next(k for k in range(1, len(old) + 2) if i + k not in gone)))
    for _, i, off, size, src in new:
        if src is None:
            out.add(("insert", i, size))
        else:
            out |= {("order", i, src - cursor)} if src != cursor else set()
            out |= {("size", i, size - old[src][2])} if size != old[src][2] else set()
            cursor = after(src)
        out |= {("fix", i, off - up(end, best))} if off != up(end, best) else set()
        end = off + size
    return out


@pytest.mark.parametrize("seed", range(4))
def test_maps_are_coded_by_the_rule_and_replayed(spark, seed):
    rng = random.Random(seed)
    old, new = random_units(rng, rng.randrange(1, 60), rng.randrange(1, 80))
    o, n = frame(spark, old, "s long, ord long, size long"), frame(spark, new, "s long, ord long, off long, size long, src long")
    got = maps.encode(o, n, S)
    assert {(r.part, r.ord, r.value) for r in got.collect()} == coded(old, new)
    assert sorted(map(tuple, maps.replay(o, got, S).select("s", "ord", "off", "size", "src").collect())) == sorted(new)


def test_a_map_that_names_a_missing_unit_is_an_error():
    with pytest.raises(ValueError):
        maps._sources(2, np.array([0, 1]), np.array([], dtype=np.int64), {1: 7}, 2)
    with pytest.raises(ValueError):
        maps._offsets(np.array([3, 3]), 4, {1: -40})


def test_alignment_is_the_first_of_the_best(spark):
    units = frame(spark, [(0, 0, 0, 5), (0, 1, 8, 8), (0, 2, 16, 3), (0, 3, 24, 1), (1, 0, 0, 4), (1, 1, 4, 4)], "s long, ord long, off long, size long")
    assert sorted(map(tuple, maps.best_alignment(units, S).collect())) == [(0, 8, 4), (1, 1, 2)]


def plain_cuts(data, average):
    """Cut by cut, with the hash summed anew at each byte."""
    gear, n, full = [int(x) for x in chunks._gear()], len(data), (1 << 64) - 1
    bits = average.bit_length() - 1
    strict, loose = (((1 << b) - 1) << 40 for b in (bits + 2, bits - 2))
    h = [sum(gear[data[i - k]] << k for k in range(min(64, i + 1))) & full for i in range(n)]
    ends, p = [], 0
    while p < n:
        if n - p <= average // 4:
            ends.append(n)
            break
        hit = next((i + 1 for i in range(p + average // 4, min(p + average, n)) if not h[i] & strict), None)
        hit = hit or next((i + 1 for i in range(p + average, min(p + 4 * average, n)) if not h[i] & loose), None)
        p = hit or min(p + 4 * average, n)
        ends.append(p)
    return ends


@pytest.mark.parametrize("size", [0, 1, 15, 16, 17, 500, 4000])
def test_cuts_are_those_of_the_rule(size):
    rng = random.Random(size)
    for average in (16, 64):
        data = bytes(rng.randrange(256) for _ in range(size))
        assert chunks.cut_points(data, average) == plain_cuts(data, average)


def test_the_last_run_that_covers_a_cell_is_copied(spark):
    cells = frame(spark, [(0, i, i < 14) for i in range(16)], "s long, pos long, code boolean")
    runs = frame(spark, [(0, 0, 0, 12), (0, 30, 3, 2)], "s long, src long, dst long, n long")
    old = frame(spark, [(0, i, 100 + i) for i in range(40)], "s long, pos long, value int")
    got = [r.got for r in predict.lay_image(cells, runs, old, S).orderBy("pos").collect()]
    assert got == [100, 101, 102, 130, 131, 105, 106, 107, 108, 109, 110, 111, 0xCC, 0xCC, 0, 0]


def test_relocations_split_and_come_back(spark):
    rows = [(0, 0, 8, 6, 1), (0, 1, 16, 8, 5), (0, 2, 24, 8, 0), (0, 3, 4, 1 << 32 | 7, 9), (0, 4, 40, 8, 7), (1, 0, 8, 1, 2)]
    entries = frame(spark, rows, "s long, ord long, slot long, info long, addend long")
    kinds = {(r.s, r.ord): (r.kind, r.idx) for r in reloc.rela_split(entries, S).collect()}
    assert kinds == {(0, 0): ("head", 0), (0, 1): ("rel", 0), (0, 2): ("rel", 1), (0, 3): ("tail", 1), (0, 4): ("rel", 2), (1, 0): ("head", 0)}
    none = lambda c: frame(spark, [], c)
    cells = reloc.predicted_columns(entries, entries, none("s long, old long, new long"), none("s long, src long, src_size long, dst long, dst_size long"), none("s long, old long, new long, size long"), S)
    assert reloc.reloc_plan(cells).count() == 0
    anchors = frame(spark, [(0, 16, 1), (1, None, 1)], "s long, anchor long, head long")
    got = sorted(map(tuple, reloc.assemble_rela(cells.withColumnRenamed("want", "value"), anchors, S).collect()))
    assert got == [(0, 0, 8, 6, 1), (0, 1, 16, 8, 5), (0, 2, 24, 8, 0), (0, 3, 40, 8, 7), (0, 4, 4, 1 << 32 | 7, 9), (1, 0, 8, 1, 2)]


def test_disjoint_runs_keep_every_source(spark):
    """Disjoint, from the runs given, and every source that any run covers is still covered."""
    rng = random.Random(3)
    runs = [(0, rng.randrange(400), 1000 * i, rng.randrange(1, 40)) for i in range(60)]
    got = [tuple(r)[1:] for r in predict.disjoint_runs(frame(spark, runs, "s long, src long, dst long, n long"), "s").orderBy("src").collect()]
    assert all(a[0] + a[2] <= b[0] for a, b in zip(got, got[1:], strict=False))
    given = {(s + k, d + k) for _, s, d, n in runs for k in range(n)}
    kept = {(s + k, d + k) for s, d, n in got for k in range(n)}
    assert kept <= given and {s for s, _ in kept} == {s for s, _ in given}


def test_prices_are_those_of_each_class_alone(spark):
    import zstandard

    rows = [(i, "ab"[i % 2], i * i % 251) for i in range(500)]
    got = {r.c: (r.n, r.bytes) for r in predict.marginal_price(frame(spark, rows, "ord long, c string, v long"), "c", "v").collect()}
    for c in "ab":
        own = np.array([v for _, k, v in rows if k == c], dtype=np.int64)
        press = zstandard.ZstdCompressor(level=3).compressobj()
        assert got[c] == (len(own), len(press.compress(own.tobytes()) + press.flush()))


def alone(values):
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compressobj()
    return len(values), len(press.compress(np.array(values, dtype=np.int64).tobytes()) + press.flush())


def test_prices_do_not_depend_on_arrival(spark):
    """Rows of one ord go by value, rows without a class are a class, and ranges of some rows price as one."""
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice(["a", "b", "b", "b", None]), rng.randrange(1 << 40)) for _ in range(3000)]
    want = {c: alone([v for o, v in sorted((o or 0, v) for o, k, v in rows if k == c)]) for c in ("a", "b", None)}
    for given, most in ((rows, 1 << 19), (rows[::-1], 256)):
        got = predict.marginal_price(frame(spark, given, "ord long, c string, v long"), "c", "v", most=most)
        assert got.columns == ["c", "n", "bytes"] and {r.c: (r.n, r.bytes) for r in got.collect()} == want
    assert predict.marginal_price(frame(spark, [], "ord long, c string, v long"), "c", "v").count() == 0
    with pytest.raises(Exception, match="null"):
        predict.marginal_price(frame(spark, [(0, "a", None)], "ord long, c string, v long"), "c", "v").collect()


def test_no_task_sorts_a_class(spark):
    """Ranges of one class's rows stay small, and those of rows equal in everything too."""
    rows = [(i, "a", i % 7) for i in range(2000)] + [(5, "b", 5)] * 2000
    packs = predict.class_packs(frame(spark, rows, "ord long, c string, v long").repartition(3), "c", "v", most=200).collect()
    held = {}
    for p in packs:
        held[p.place >> 33] = held.get(p.place >> 33, 0) + p.n
    assert sum(held.values()) == 4000 and max(held.values()) <= 600
    given = frame(spark, rows, "ord long, c string, v long")
    assert [predict.class_packs(given, "c", "v", most).rdd.getNumPartitions() for most in (4000, 40, 10, 1)] == [1, 100, 200, 1000]
    got = predict.marginal_price(given, "c", "v", most=200).collect()
    assert {r.c: (r.n, r.bytes) for r in got} == {"a": alone([i % 7 for i in range(2000)]), "b": alone([5] * 2000)}


def test_a_copy_is_paired_whole(spark):
    """Every row of a side that is a copy of the other has its pair; a thinned copy with repeated keys has some."""
    rng = random.Random(4)
    old = [rng.randrange(40) for _ in range(200)]
    new = [k for k in old if rng.random() < 0.9]
    rows = [(0, "old", i, k) for i, k in enumerate(old)] + [(0, "new", i, k) for i, k in enumerate(new)]
    got = align.anchored_diff(frame(spark, rows, "section long, side string, ord long, key long"), "section")
    same = align.anchored_diff(frame(spark, [(0, s, i, k) for s in ("old", "new") for i, k in enumerate(range(50))], "section long, side string, ord long, key long"), "section")
    assert got.count() and same.count() == 50 and set(got.columns) == set(same.columns)


@pytest.mark.parametrize("seed", range(2))
def test_replay_hands_python_only_what_breaks_the_order(spark, seed):
    """Results are those of the rule for one section in memory; sizes and fixes, of most units, stay out of the chain."""
    rng = random.Random(100 + seed)
    old, new = random_units(rng, 300, 400)
    o, n = frame(spark, old, "s long, ord long, size long"), frame(spark, new, "s long, ord long, off long, size long, src long")
    part = {}
    for r in maps.encode(o, n, S).collect():
        part.setdefault(r.part, {})[r.ord] = r.value
    kept = sorted({u[4] for u in new if u[4] is not None})
    want = maps._sources(len(new), np.array(kept), np.array(sorted(part["insert"])), part["order"], len(old))
    assert [-1 if u[4] is None else u[4] for u in new] == want.tolist()
    rows = [(maps._CHAIN[p], k, v) for p in ("units", "drop", "insert", "order") for k, v in part.get(p, {}).items()] + [(maps._CHAIN["total"], 0, len(old))]
    at, steps = maps._steps(*(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)))
    assert at.tolist() == sorted(part["order"])
    for k, step in zip(at.tolist(), steps.tolist(), strict=True):
        assert kept[step + sum(u[4] is not None for u in new[:k])] == new[k][4]
    with pytest.raises(ValueError, match="missing"):
        maps._steps(np.array([0, 3, 4]), np.array([0, 1, 0]), np.array([2, 9, 2]))
    plan = maps.replay(o, maps.encode(o, n, S), S)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" not in plan


def test_a_replayed_map_checks_itself(spark):
    old = frame(spark, [(0, i, 8) for i in range(4)], "s long, ord long, size long")
    for rows, why in (([("units", 0, 5)], "sources"), ([("units", 0, 2), ("size", 1, -9)], "size underflows"), ([("units", 0, 2), ("fix", 1, -40)], "layout underflows")):
        coded = frame(spark, [(0, *r) for r in rows], "s long, part string, ord long, value long")
        with pytest.raises(Exception, match=why):
            maps.replay(old, coded, S).collect()
