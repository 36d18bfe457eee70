"""Literal vectors, invariants and round trips of the alignment operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import align, chunks, lookup, match, runs, vote
from tidemark.plans import versions

# Literal vectors that results must match.
S = ["section"]


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def values(spark, expr, names):
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", expr(F.col("name")).alias("k"))
    return dict(rows(df))


def test_name_keys(spark):
    want = {"a/b.T.M-fm": "fm", "a/b.(*T).String": "P|String", "a/b.T.String": "String", "a/b.checkValid.deferwrap1": "deferwrap", "a/b.Bucket[uint64].FractionBelow": "FractionBelow", "plain": "plain"}
    assert values(spark, keys.name_key, want) == want
    want = {"x.func12": "x.func#", "x.func1.gowrap2": "x.func#.gowrap#", "x.deferwrap3": "x.deferwrap#", "func7": "func7"}
    assert values(spark, keys.normalize_key, want) == want


def test_canonical_names(spark):
    want = {"_RNvCs3IwsiA6RWiX_8smallvec10deallocate": "_RNvCs_8smallvec10deallocate", "main.f": "main.f", "_RNvC4Cszz3foo": "_RNvC4Cszz3foo", "_RNvCs_8smallvec10deallocate": "_RNvCs_8smallvec10deallocate"}
    assert values(spark, keys.canonical_name, want) == want


def test_majority_vote(spark):
    v = [(1, 10)] * 3 + [(1, 11), (2, 20)] + [(3, 30)] * 2 + [(3, 31)] * 2
    assert rows(vote.majority_vote(spark.createDataFrame(v, "o long, n long"))) == [(1, 10, 3, 4), (2, 20, 1, 1), (3, 30, 2, 4)]
    assert rows(vote.majority_vote(spark.createDataFrame([], "o long, n long"))) == []


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([(9,)] * 2 + [(4,)] * 2 + [(7,)], "v long")
    assert rows(vote.modal_template(df, ["v"])) == [(4,)]


def test_asof_shift(spark):
    marks = spark.createDataFrame([(0, 0, 0), (0, 4096, 16), (0, 1048576, -8)], "section long, off long, delta long")
    probes = spark.createDataFrame([(0, 5000), (0, 1048584), (0, 3), (1, 77)], "section long, addr long")
    assert rows(lookup.asof_shift(probes, marks, S), "section", "addr", "mapped") == [(0, 1048584, 1048576), (0, 3, 3), (0, 5000, 5016), (1, 77, 77)]


def test_lookup_cascade(spark):
    maps = spark.createDataFrame([(0, 0, 16, 0, 16), (0, 32, 6, 48, 9)], "section long, src long, src_size long, dst long, dst_size long")
    points = spark.createDataFrame([(0, 0x1020, 0x2030), (0, 0x1040, 0x2060)], "section long, old long, new long")
    ranges = spark.createDataFrame([(0, 0x3000, 0x4000, 0x100)], "section long, old long, new long, size long")
    probes = spark.createDataFrame([(0, a) for a in (5, 33, 40, 0x1020, 0x3080, 0x3100)], "section long, addr long")
    got = {r.addr: (r.target, r.via) for r in lookup.lookup_cascade(probes, points, maps, ranges, S).collect()}
    assert got == {5: (5, "map"), 33: (49, "map"), 40: (None, "none"), 0x1020: (0x2030, "point"), 0x3080: (0x4080, "range"), 0x3100: (None, "none")}


def test_lookups_agree_with_brute_force(spark):
    rng = random.Random(3)
    at, src = 0, []
    for _ in range(300):
        at += rng.randrange(1, 3000)
        n = rng.randrange(1, 2000)
        src.append((0, at, rng.randrange(10**6), n))
        at += n
    probes = [(0, rng.randrange(at + 500), at - 100, 900_000) for _ in range(500)]
    got = lookup.nearest_run_project(spark.createDataFrame(probes, "section long, addr long, old_len long, new_len long").distinct(), spark.createDataFrame(src, "section long, src long, dst long, n long"), S)
    for r in got.collect():
        before = [x for x in src if x[1] <= r.addr]
        after = [x for x in src if x[1] > r.addr]
        b, f = before[-1] if before else None, after[0] if after else None
        take = b if b and (r.addr < b[1] + b[3] or not f or r.addr - b[1] - b[3] < f[1] - r.addr) else f
        want = max(0, min(r.new_len - 1, r.addr + take[2] - take[1])) if r.addr < r.old_len else None
        assert r.projected == want


def test_positional_fallback(spark):
    proj = spark.createDataFrame([(0, 0, 0x1000, 0x8000), (0, 1, 0x1030, 0x8010), (0, 2, 0x1020, 0x8020)], "section long, ord long, slot long, addend long")
    slots = spark.createDataFrame([(0, 0, 0x1000), (0, 1, 0x1020), (0, 2, 0x1028), (0, 3, 0x1030), (0, 4, 0x1038)], "section long, ord long, slot long")
    assert rows(match.join_with_positional_fallback(proj, slots, S), "slot", "addend") == [(0x1000, 0x8000), (0x1020, 0x8020), (0x1028, 0x8020), (0x1030, 0x8010), (0x1038, 0)]


def test_staged_match_is_fifo(spark):
    old = spark.createDataFrame([(1, 1, "a", "x"), (2, 2, "a", "y"), (3, 3, "b", "z")], "id long, ord long, k1 string, k2 string")
    new = spark.createDataFrame([(11, 1, "a", "q"), (12, 2, "c", "z"), (13, 3, "a", "y"), (14, 4, "a", "z")], "id long, ord long, k1 string, k2 string")
    assert rows(match.staged_match(old, new, [("exact", "k1"), ("content", "k2")])) == [(11, 1, "exact"), (12, 3, "content"), (13, 2, "exact")]


def test_anchored_pairs():
    assert align.anchored_pairs([1, 2, 3, 4, 5, 3, 6], [1, 9, 2, 4, 5, 3, 6]) == [0, 2, -1, 3, 4, 5, 6]


def test_rle_vector(spark):
    v = [0, 0, 0, 16, 16, -8, -8, -8, 2**30, 0]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "section long, ord long, v long")
    coded = runs.rle_encode(df, S, "v")
    assert coded.count() == 5
    assert rows(runs.rle_decode(coded, S, "v"), "ord", "v") == sorted(enumerate(v), key=repr)


def test_columnar_residual_round_trip_and_truncation(spark):
    want = [i % 256 for i in range(4096)]
    for at in range(0, 4096, 61):
        for k in range(at, min(4096, at + 1 + at % 7)):
            want[k] ^= 0x80
    want[-1] ^= 1
    cells = spark.createDataFrame([(0, i, i % 256, w) for i, w in enumerate(want)], "section long, pos long, pred long, want long")
    coded = runs.columnar_encode(cells, S)
    assert rows(runs.columnar_apply(cells, coded, S), "pos", "got") == sorted(enumerate(want), key=repr)
    with pytest.raises(Exception, match="length"):
        runs.columnar_apply(cells, coded.withColumn("bytes", F.slice("bytes", 1, 1)), S).collect()
    with pytest.raises(Exception, match="beyond"):
        runs.columnar_apply(cells.where("pos < 4000"), coded, S).collect()


def test_monotone_filter(spark):
    df = spark.createDataFrame([(0, i, j) for i, j in enumerate([3, 1, 4, 4, 2, 9])], "section long, ord long, j long")
    assert rows(match.monotone_pairs(df, S), "j") == [(3,), (4,), (9,)]


def test_block_shifts():
    old = [bytes([i] * 16) for i in range(40)]
    assert {d for d, *_ in align.block_shifts(old, old)} == {0}
    moved = old[:10] + old[14:] + old[10:14]
    got = align.block_shifts(old, moved)
    assert all(d == 26 * 16 for d, *_ in got[10:14]) and all(d == -64 for d, *_ in got[14:])
    lone = [bytes([200 + i % 50] * 16) for i in range(40)]
    lone[30] = old[5]
    assert {d for d, *_ in align.block_shifts(old, lone)} == {0}


def test_fuzzy_runs():
    rng = random.Random(5)
    base = rng.randbytes(4096)
    assert align.fuzzy_runs(base, base) == [(0, 0, 4096)]
    inserted = base[:2000] + rng.randbytes(128) + base[2000:]
    got = align.fuzzy_runs(base, inserted)
    assert got[-1][1] - got[-1][0] == 128 and len(got) <= 4
    assert all(a[1] + a[2] <= b[1] for a, b in zip(got, got[1:]))
    edited = bytearray(base)
    for i in range(40, 4000, 100):
        edited[i] ^= 1
    assert len(align.fuzzy_runs(base, bytes(edited))) == 1
    assert sum(n for *_, n in align.fuzzy_runs(base, rng.randbytes(4096))) <= 64
    assert align.fuzzy_runs(b"", base) == [] and align.fuzzy_runs(base, b"") == []


def test_seed_runs_take_every_document(spark, tmp_path):
    from tidemark.plans import queries

    text = "".join(random.Random(3).choices("abcdefghij ", k=9000))
    rows = [(0, text, 9000), (1, "new " + text, 9004), (2, text[:3000], None), (3, text[:3000], 3000)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["seed_runs"](spark, str(tmp_path)).collect()
    assert sorted((r.pair, r.src, r.dst, r.n) for r in got) == [(0, 0, 4, 9000), (2, 0, 0, 3000)]


def test_remove_overlaps():
    got = align.remove_overlaps([(0, 100, 10), (5, 300, 20), (8, 400, 4), (40, 0, 0)])
    assert all(a[0] + a[2] <= b[0] for a, b in zip(got, got[1:])) and all(n > 0 for *_, n in got)


def test_bitmap_expand(spark):
    words = spark.createDataFrame([(0, 0, 0x1000), (0, 1, 0b1011), (0, 2, 0b11), (0, 3, 0x9000)], "section long, ord long, word long")
    want = {0x1000, 0x1008, 0x1008 + 16, 0x1008 + 504, 0x9000}
    assert {r.slot for r in runs.bitmap_expand(words, S).collect()} == want


def test_content_chunks_cover_their_input(spark):
    rng = random.Random(1)
    data = rng.randbytes(20_000)
    ends = chunks.cut_points(data, 1024)
    assert ends[-1] == len(data) and all(0 < b - a <= 4096 for a, b in zip([0, *ends], ends))
    shifted = chunks.cut_points(rng.randbytes(100) + data, 1024)
    assert len({e - 100 for e in shifted} & set(ends)) > len(ends) // 2
    assert chunks.cut_points(b"", 1024) == []


def test_diff_patch(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (4, None)], "id long, v string")
    plan = versions.diff(old, new, ["id"])
    assert rows(plan) == [("delete", 1, None), ("put", 2, "b"), ("put", 4, None)]
    assert versions.verify(versions.patch(old, plan, ["id"]), new) and not versions.verify(old, new)
    assert versions.diff(new, new, ["id"]).isEmpty()
    with pytest.raises(ValueError):
        versions.reconstruct(new, plan, ["id"], (3, "no such digest"))


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    cells = spark.createDataFrame([(i % 3, i, rng.randrange(2) == 0) for i in range(400)], "section long, ord long, kept boolean")
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(rows(runs.keep_drop_runs(cells, S)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_best_candidates_are_those_of_all_pairs(spark):
    """Without a join of the two sides on a name: one that all rows share makes no pairs."""
    rng = random.Random(6)
    some = lambda *v: rng.choice([*v, None])
    rows = [(i, some("a", "b", "c"), some("a", "x"), some("t", "u"), some(1, 2, 3)) for i in rng.sample(range(900), 240)]
    levels = [(3, ["p", "b", "z"]), (2, ["t", "z"]), (1, ["z"]), (0, [])]
    df = spark.createDataFrame(rows, "id long, p string, b string, t string, z int").withColumn("names", F.array("p", "b"))
    out = match.best_candidate_match(df.where("id % 2 = 0"), df.where("id % 2 = 1"), levels)
    want, at = {}, {"p": 1, "b": 2, "t": 3, "z": 4}
    for n in rows:
        for o in rows:
            if n[0] % 2 and not o[0] % 2:
                for k in (1, 2):
                    if n[k] is not None and n[k] in o[1:3]:
                        score = next(s for s, cs in levels if all(n[at[c]] is not None and n[at[c]] == o[at[c]] for c in cs))
                        want[n[0]] = min(want.get(n[0], (1,)), (-score, abs(n[0] - o[0]), k, o[0]))
    assert {r.new_id: (r.old_id, r.score, r.copy) for r in out.collect()} == {n: (w[3], -w[0], w[0] <= -2) for n, w in want.items()}
    assert "Join" not in out._jdf.queryExecution().sparkPlan().toString()


def test_reliable_blocks_look_ahead_in_linear_time(spark):
    rng = random.Random(7)
    rows = [(s, i, rng.randrange(3), rng.random() < 0.4) for s in range(3) for i in range(150)]
    out = runs.reliable_blocks(spark.createDataFrame(rows, "section long, ord long, delta long, matched boolean"), S)
    for s, i, _, matched, reliable in out.collect():
        back = [r[2] for r in rows if r[0] == s and r[1] < i and r[3]]
        ahead = [r[2] for r in rows if r[0] == s and r[1] > i and r[3]]
        assert reliable == (matched or bool(back and ahead and back[-1] == ahead[0]))
    assert "unboundedfollowing" not in out._jdf.queryExecution().sparkPlan().toString().lower()


def plain_shifts(old, new, many):
    """Block by block."""
    shift, out = 0, []
    for i, b in enumerate(old):
        got = [j for j, n in enumerate(new) if n == b]
        near = min(got, key=lambda j: (abs(j - i - shift), j), default=None)
        if len(got) >= many:
            out.append([shift, False, True])
        elif 0 <= i + shift < len(new) and new[i + shift] == b:
            out.append([shift, True, False])
        elif near is not None and i + 1 < len(old) and new[near + 1 : near + 2] == [old[i + 1]]:
            shift = near - i
            out.append([shift, True, False])
        else:
            out.append([shift, False, False])
    i = before = 0
    while i < len(out):
        j = next((j for j in range(i, len(out)) if out[j][0] != out[i][0]), len(out))
        if sum(o[1] for o in out[i:j]) < 2 and out[i][0] != before:
            out[i:j] = [[before, False, o[2]] for o in out[i:j]]
        before, i = out[i][0], j
    for i, o in enumerate(out):
        if o[2]:
            o[0] = next((p[0] for p in out[i:] if p[1]), o[0])
    return [tuple(o) for o in out]


@pytest.mark.parametrize("seed", range(3))
def test_block_shifts_of_sections_in_arrays(spark, seed):
    rng = random.Random(seed)
    base = {s: [rng.randrange((6, 40, 400)[s]) for _ in range(160)] for s in range(3)}
    sides = {s: (b, [v for v in b[rng.randrange(9) :] if rng.random() < 0.93] + b[:5]) for s, b in base.items()}
    rows = [(s, side, i, bytes([v // 256, v % 256])) for s, two in sides.items() for side, vs in zip(("old", "new"), two, strict=True) for i, v in enumerate(vs)]
    rows += [(7, "old", 0, b"x"), (8, "new", 0, b"x")]
    df = spark.createDataFrame(rows, "section long, side string, block long, bytes binary")
    out = align.block_shift_islands(df, "section", width=1, many=20)
    got = {(r.section, r.block): (r.delta, r.matched, r.ambiguous) for r in out.collect()}
    want = {(s, i): t for s, (o, n) in sides.items() for i, t in enumerate(plain_shifts(o, n, 20))}
    assert got == want | {(7, 0): (0, False, False)}
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_enumerations_are_compared_without_joins(spark):
    derived, true = (spark.createDataFrame([(v,) for v in vs], "v long") for vs in ((1, 2, 2, None), (2, 3, 3, None)))
    out = match.enumeration_repair(derived, true)
    assert rows(out, "v", "kind") == sorted([(1, "suppressed"), (3, "missing"), (None, "missing"), (None, "suppressed")], key=repr)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def plain_runs(src, dst, least, drop, recent):
    """Place by place, byte by byte."""
    k, at, delta, out = max(8, min(16, least)), 0, 0, []
    while at + k <= len(dst):
        best = (0, 0, 0, 0)
        for s in [at - delta, *[i for i in range(len(src) - k + 1) if src[i : i + k] == dst[at : at + k]][-recent:]]:
            score = top = n = 0
            for m in range(min(len(src) - s, len(dst) - at) if 0 <= s < len(src) else 0):
                score += 2 if src[s + m] == dst[at + m] else -3
                if score > top:
                    top, n = score, m + 1
                elif score < top - drop:
                    break
            if n >= least:
                best = max(best, (top, -abs(at - delta - s), s, n))
        if not best[0]:
            at += 1
            continue
        s, n = best[2:]
        if out and out[-1][1] + out[-1][2] == at and out[-1][0] + out[-1][2] == s:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((s, at, n))
        delta, at = at - s, at + n
    return out


def test_fuzzy_runs_pass_over_what_holds_none(monkeypatch):
    rng = random.Random(8)
    tried = 0
    for turn in range(60):
        letters = bytes(range(97, 97 + rng.choice([1, 2, 4, 26])))
        src = bytes(rng.choices(letters, k=rng.randrange(500)))
        cut = [src[a : a + rng.randrange(90)] for a in (rng.randrange(len(src) + 1) for _ in range(6))]
        dst = bytearray(b"".join(c + bytes(rng.choices(letters, k=rng.randrange(20))) for c in cut))
        for _ in range(len(dst) // 12):
            dst[rng.randrange(len(dst))] = rng.choice(letters)
        rules = (rng.choice([4, 8, 12, 16, 30, 70]), rng.choice([2, 8, 32]), rng.choice([1, 3, 32]))
        got = align.fuzzy_runs(src, bytes(dst), *rules)
        assert got == plain_runs(src, bytes(dst), *rules)
        if turn % 2:  # mixes that collide change nothing
            with monkeypatch.context() as m:
                m.setattr(align, "_seeds", lambda data, k, f=align._seeds: f(data, k) % 7)
                assert align.fuzzy_runs(src, bytes(dst), *rules) == got
        tried += len(got)
    assert tried > 100
    far = align._may_run(np.frombuffer(rng.randbytes(50_000), dtype=np.uint8), np.frombuffer(rng.randbytes(50_000), dtype=np.uint8), 0, 0, 49_000, 16, 32)
    assert len(far) < 50


def test_touched_rows_are_known_without_another_join(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (4, None)], "id long, v string")
    seen = versions.changes(old, new, ["id"])
    assert rows(seen) == [("delete", 1, None, True), ("put", 2, "b", True), ("put", 4, None, False)]
    assert seen.where("_known")._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
