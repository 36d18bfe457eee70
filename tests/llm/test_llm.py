"""Each operator against brute force, a round trip or held-out rows, and on odd inputs."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, components, curves, language, lattice, licenses, lines, mixing, near_text, near_vectors, pieces, queries, sharding, shingles, urls, vocab

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "a b c d e f"), (7, "a b c d e f"), (8, "12 34 !!"), (9, LONG), (None, "a b c d e f"), (None, None), (10, "x▁y  z\n日本語 é\u0301")]
CLASH = "doc_id long, text string"


@pytest.fixture(scope="module")
def voc():
    return vocab.load()


def odd(spark):
    """Rows of every odd kind, with columns named like those operators make."""
    extra = {c: F.lit(1) for c in ("h", "start", "size", "n", "node", "label", "a", "b", "at", "pos", "w", "hs", "keep", "cut", "rk", "first", "shard", "slot", "lang_pred", "score", "pieces", "lossless", "n_lines", "licenses", "host", "taken", "chunk", "row", "a.b", "_block", "_t", "rule", "template", "_bad", "g", "own", "spans", "pattern", "uses", "_tm_x")}
    return spark.createDataFrame(ODD, CLASH).withColumns(extra)


def none(spark):
    return spark.createDataFrame([], CLASH)


def docs(spark, *cols):
    return spark.read.parquet(f"{SF}/documents.parquet").select(*cols)


# 1: sharding


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_bijection(n):
    f = sharding.Feistel(n, 5)
    p = f.forward(np.arange(n))
    assert sorted(p.tolist()) == list(range(n)) and (f.inverse(p) == np.arange(n)).all()


def test_shards(spark):
    got = queries.op1_sharding(spark, SF).toPandas()
    text = {r.doc_id: r.text for r in docs(spark, "doc_id", "text").collect()}
    per = got.groupby("shard").slot.apply(list)
    assert set(per.index) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in per)
    assert max(map(len, per)) - min(map(len, per)) <= 1
    order = got.sort_values("doc_id").reset_index()
    for i, r in order.iterrows():
        assert sharding.locate(i, len(order), 8) == (r.shard, r.slot) and sharding.row_at(r.shard, r.slot, len(order), 8) == i
        assert r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())


def test_shards_of_odd_rows(spark, tmp_path):
    got = sharding.shard_rows(odd(spark), ["doc_id", "text"], 3)
    assert sorted((r.shard, r.slot) for r in got.collect()) == sorted((i % 3, i // 3) for i in range(len(ODD)))
    sharding.write_shards(got, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(ODD)
    assert sharding.shard_rows(none(spark), ["doc_id"], 3).count() == 0


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = []
    for n in (1, 5):
        ranked, total = common.global_rank(common.Scratch(spark, "t"), df.repartition(3), ["k"], n)
        got.append(sorted(map(tuple, ranked.collect())))
        assert total == 1000
    assert got[0] == got[1] == [(i, i) for i in range(1000)]


# 2: near-duplicates of texts


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.translate({i: 32 for i in range(9, 14)}).split(" ") if w]


def brute_components(rows, k):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    both = Counter((i, j) for own in by.values() if len(own) > 1 for x, i in enumerate(own) for j in own[x + 1 :])
    for (i, j), n in both.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_text_is_brute_force(spark, k):
    rng = random.Random(k)
    base = [[rng.choice("abcdefghijklmnop") * rng.randrange(1, 5) + str(rng.randrange(300)) for _ in range(rng.randrange(20, 120))] for _ in range(25)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(100, 300):  # copies, near copies and borderline ones
        w = list(base[rng.randrange(25)])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        rows.append((i, " ".join(w).upper() if i % 3 else "\n".join(w)))
    rows += ODD
    got = near_text.components(spark.createDataFrame(rows, CLASH).repartition(5), k)
    same = lambda x: sorted(x, key=repr)
    assert same((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == same(brute_components(rows, k))


@pytest.mark.parametrize("block", [1024, 16])
def test_crowded_regions_lose_no_member(spark, monkeypatch, block):
    """Regions of many copies, of chains whose ends are far apart, and of many small groups with much text in common."""
    monkeypatch.setattr(near_text, "BLOCK", block)
    rng = random.Random(8)
    base, rows = [f"word{i}" for i in range(200)], []
    for i in range(120):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(200)] = f"x{i}-{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    steps = [f"step{i}" for i in range(700)]
    rows += [(1000 + i, " ".join(steps[8 * i : 8 * i + 200])) for i in range(60)]
    for g in range(50):  # groups of three, linked within, not across
        own = [f"g{g}-{i}" if i % 25 == 0 else f"both{i}" for i in range(200)]
        rows += [(2000 + 10 * g + c, " ".join(own + [f"c{g}-{c}"])) for c in range(3)]
    rng.shuffle(rows)
    want = brute_components(rows, 4)
    assert len({c for d, _, c in want if 1000 <= d < 2000}) == 1 and len({c for d, _, c in want if d >= 2000}) == 50
    got = near_text.components(spark.createDataFrame(rows, CLASH), 4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(want)


def test_sorted_runs_meet_their_neighbours_across_batches():
    """Neighbours with a common prefix stay, whatever the batches; others go, but for a run's ends."""
    import pyarrow as pa

    key = lambda *v: np.array([*v, *range(50, 50 + near_text.DEPTH - len(v))], dtype=">u4").tobytes()
    deep = [1] * near_text.BASE
    rows = [(0, key(0), b"a", 9), (0, key(*deep), b"b", 9), (0, key(*deep, 2), b"c", 9), (0, key(*deep, 3), b"d", 5), (0, key(9), b"e", 9), (1, key(9), b"f", 9), (1, key(10), b"g", 9)]
    t = pa.table(dict(zip(("tree", "key", "node", "n"), zip(*rows, strict=True), strict=True)))
    t = t.append_column("label", t.column("node"))
    for size in (1, 2, 3, 7):
        met = pa.Table.from_batches(near_text._met(iter(t.drop(["label"]).to_batches(size))), t.drop(["label"]).schema)
        assert met.column("node").to_pylist() == [b"a", b"b", b"c", b"d", b"g"]
        beside = [tuple(p.values()) for x in near_text._beside(iter(t.to_batches(size))) for p in x.to_pylist()]
        assert beside == [(b"b", b"c")]


@pytest.mark.parametrize("block", [1024, 64])
def test_crowded_regions_lose_no_spoke(spark, monkeypatch, block):
    """Copies that are linked with one original only, and a crowd of texts too far from one another to link."""
    monkeypatch.setattr(near_text, "BLOCK", block)
    rng = random.Random(9)
    base, far, rows = [f"word{i}" for i in range(200)], [f"far{i}" for i in range(200)], []
    rows.append((1000, " ".join(base)))
    for i in range(300):
        w, z = list(base), list(far)
        for x in rng.sample(range(4, 196, 8), 5):
            w[x] = f"x{i}-{x}"
        rows.append((i, " ".join(w)))
        for x in rng.sample(range(4, 196, 8), 6 if i < 100 else 0):
            z[x] = f"z{i}-{x}"
        if i < 100:
            rows.append((2000 + i, " ".join(z)))
    want = brute_components(rows, 4)
    assert len({c for d, _, c in want if d <= 1000}) == 1 and len({c for d, _, c in want if d >= 2000}) > 1
    got = near_text.components(spark.createDataFrame(rows, CLASH), 4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(want)


def test_near_text_dedup_keeps_one_of_each(spark):
    kept = near_text.dedup(odd(spark), 5)
    assert kept.columns == odd(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 6, 8, 9, 10, None])
    assert near_text.components(none(spark)).count() == near_text.dedup(none(spark)).count() == 0


def test_shingle_hashes_do_not_depend_on_blocks(monkeypatch):
    import pyarrow as pa

    texts = pa.array([t for _, t in ODD])
    whole = shingles.shingle_sets(texts, 4)
    monkeypatch.setattr(shingles, "BLOCK", 3)
    assert all((a == b).all() for a, b in zip(whole, shingles.shingle_sets(texts, 4), strict=True))
    assert (whole[6] == whole[7]).all() and len(whole[0]) == len(whole[1]) == len(whole[2]) == 0


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 300), (500, 501), (501, 500), (500, 501)]
    rng.shuffle(links)
    got = components.connected_components(common.Scratch(spark, "cc"), spark.createDataFrame(links, "a long, b long"))
    want = {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(80)}, 500: 500, 501: 500}
    assert dict(map(tuple, got.collect())) == want
    assert components.connected_components(common.Scratch(spark, "cc"), spark.createDataFrame([], "a long, b long")).count() == 0


# 3: language


def test_language_is_right_on_held_out_rows(spark):
    got = queries.op3_language_id(spark, SF).join(docs(spark, "doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) and (got.lang == got.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()


def test_language_forward_sum_is_the_sum_over_segmentations(voc):
    m = language.fit(voc, {"en": {"the": 5, "then": 2}, "de": {"der": 4, "den": 1}})
    def total(word, g):
        if not word:
            return 1.0
        return sum(m.p[voc.ids[word[:n]], g] * total(word[n:], g) for n in range(1, len(word) + 1) if word[:n] in voc.ids)
    got = m.score(["▁then", "▁der"])
    assert np.allclose(got, [[np.log(total(w, g)) for g in range(2)] for w in ("▁then", "▁der")])
    assert np.allclose(m.slow("▁then"), got[0])
    assert np.isfinite(m.score(["▁" + "日" * 300, "x" * 5000])).all()


def test_language_of_odd_rows(spark, voc):
    model = language.learn(spark.createDataFrame([("the cat", "en"), ("der hund", "de"), (None, "fr"), ("x", None)], "text string, lang string"), voc)
    assert model.langs == ["de", "en"]
    got = language.identify(odd(spark), model).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 8)} == {"und"}
    assert {r.lang_pred for r in language.identify(odd(spark), language.learn(none(spark).withColumn("lang", F.lit("x")), voc)).collect()} == {"und"}
    assert language.identify(none(spark), model).count() == 0


# 4: pieces


def test_pieces_round_trip_and_repeat(spark, voc):
    got = pieces.encode(odd(spark), voc).collect()
    assert len(got) == len(ODD) and all(r.lossless for r in got if r.n_pieces is not None)
    assert {(r.doc_id, r.n_pieces) for r in got if r.n_pieces is None} == {(1, None), (None, None)}
    again = pieces.encode(odd(spark).repartition(5), voc).collect()
    key = lambda r: (repr(r.doc_id), repr(r.text_crc32))
    assert [r.pieces for r in sorted(got, key=key)] == [r.pieces for r in sorted(again, key=key)]
    text = docs(spark, "doc_id", "text").orderBy("doc_id").limit(3)
    seeds = [sorted(r.ids_crc32 for r in pieces.encode(text, voc, seed=s).collect()) for s in (0, 0, 1)]
    assert seeds[0] == seeds[1] != seeds[2]
    assert pieces.encode(none(spark), voc).count() == 0


def test_pieces_are_drawn_with_the_lattice_weights(voc):
    s = pieces.Sampler(voc)
    n = 20_000
    got = Counter(tuple(ids.tolist()) for ids in s.encode([" then"] * n, pieces.row_keys(list(range(n)), 0)))
    def all_(word):
        return [()] if not word else [(voc.ids[word[:k]], *rest) for k in range(1, len(word) + 1) if word[:k] in voc.ids for rest in all_(word[k:])]
    weight = {seg: float(np.prod([(i + 1.0) ** -pieces.POWER for i in seg])) for seg in all_("▁then")}
    assert set(got) <= set(weight)
    for seg, w in weight.items():
        share = w / sum(weight.values())
        assert abs(got[seg] / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-4


def test_pieces_of_texts_beyond_a_doubles_range(voc):
    s = pieces.Sampler(voc)
    texts = ["a" * 30_000, "日本" * 4000, "\u0378" * 3000, "!?" * 9000]
    for t, ids in zip(texts, s.encode(texts, pieces.row_keys(texts, 0)), strict=True):
        assert s.decode(ids.tolist()) == t


# 5 and 8: vectors


def vectors(rng, n=700, dim=16):
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[100:130] = x[0]  # copies
    x[130:200] = x[1] + 0.05 * rng.standard_normal((70, dim))
    x[200:260] = x[2] + 0.18 * rng.standard_normal((60, dim))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    nan = [float("nan")] + [1.0] * (dim - 1)
    return rows + [(1000, None), (1050, [0.0] * dim), (1100, nan), (1150, [None] + [1.0] * (dim - 1)), (1200, []), (1250, [1.0, 2.0, 3.0]), (1300, [1.0, 2.0, 3.5])]


def good(rows):
    return {i: np.array(v, dtype=float) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}


def cosine(a, b):
    return float(a @ b / np.sqrt((a @ a) * (b @ b))) if len(a) == len(b) else -9.0


def test_nearest_is_nearly_brute_force(spark):
    rows = vectors(np.random.default_rng(1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = curves.nearest(df, F.col("vec_id") % 50 == 0, 5).toPandas()
    own, hits, total = good(rows), 0, 0
    for q in [i for i in own if i % 50 == 0]:
        want = sorted(((-cosine(own[q], own[i]), i) for i in own if i != q and len(own[i]) == len(own[q])))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(want) + 1)) and q not in set(mine.vec_id)
        assert all(abs(s - cosine(own[q], own[i])) < 1e-12 for s, i in zip(mine.score, mine.vec_id, strict=True))
        hits, total = hits + len({round(-s, 9) for s, _ in want} & {round(s, 9) for s in mine.score}), total + len({round(-s, 9) for s, _ in want})
    assert hits >= 0.9 * total
    copy = got[got.query_id == 100].sort_values("rank")
    assert list(copy.vec_id) == [0, 101, 102, 103, 104]  # ties go to smaller ids
    assert set(got.query_id) == {i for i in own if i % 50 == 0}
    assert curves.nearest(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_recall_where_windows_are_small(spark, monkeypatch):
    monkeypatch.setattr(curves, "BLOCK", 32)
    monkeypatch.setattr(curves, "WINDOW", 16)
    rows = vectors(np.random.default_rng(4), 900)
    got = curves.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, 5).toPandas()
    own, hits, total = good(rows), 0, 0
    for q in [i for i in own if i % 50 == 0 and len(own[i]) == 16]:
        want = {i for _, i in sorted(((-cosine(own[q], own[i]), i) for i in own if i != q and len(own[i]) == 16))[:5]}
        hits, total = hits + len(want & set(got[got.query_id == q].vec_id)), total + 5
    assert hits >= 0.9 * total


def test_hilbert_neighbours_touch():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    key = curves.hilbert(grid, 4)
    assert sorted(key.tolist()) == list(range(256))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("leaf", [1024, 120])
def test_vector_links_are_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(near_vectors, "LEAF", leaf)
    rows = vectors(np.random.default_rng(3))
    got = {r.vec_id: r for r in near_vectors.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    own = good(rows)
    links = {i: {j for j in own if j != i and cosine(own[i], own[j]) >= 0.9} for i in own}
    for i, _ in rows:
        assert got[i].kept == (got[i].component_id == i)
        assert got[i].n_links <= len(links.get(i, ()))
    met = sum(r.n_links for r in got.values()) / sum(map(len, links.values()))
    assert met == 1 if leaf == 1024 else met > 0.9
    seen = {}
    for i in own:
        todo = [i] if i not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = i
                todo += links[x]
    wrong = sum(got[i].component_id != seen.get(i, i) for i, _ in rows)
    assert wrong == 0 if leaf == 1024 else wrong <= 3
    assert near_vectors.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_wide_clusters_lose_few_links(spark):
    """A cluster far wider than a leaf, most of whose pairs are links, amid other vectors."""
    rng = np.random.default_rng(5)
    middle = rng.standard_normal(64)
    x = np.concatenate([middle / np.linalg.norm(middle) + 0.03 * rng.standard_normal((5000, 64)), rng.standard_normal((3000, 64)) / 8]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumn("key", F.lit(1)).withColumn("a.b", F.lit(2))
    got = {r.vec_id: r for r in near_vectors.links(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    degree = np.concatenate([(u[a : a + 1000] @ u.T >= 0.9).sum(axis=1) - 1 for a in range(0, 8000, 1000)])
    mine = np.array([got[i].n_links for i in range(8000)])
    assert (mine <= degree).all() and degree[:5000].mean() > 1024 and mine.sum() >= 0.97 * degree.sum()
    assert {got[i].component_id for i in range(5000) if degree[i]} == {0}


def test_vectors_of_odd_rows(spark):
    """Null ids, repeated ids and columns with clashing names."""
    rows = [(None, [1.0, 2.0]), (None, None), (50, [1.0, 2.0]), (50, [2.0, 1.0]), (7, [1.0, 2.5]), (8, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("key", "node", "raw", "dim", "leaf", "label")}).withColumn("a.b", F.lit(1))
    links = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.links(df).collect()), key=repr)
    assert links == sorted([(None, 2, 7, False), (None, 0, None, True), (50, 2, 7, False), (50, 0, 50, True), (7, 2, 7, True), (8, 0, 8, True)], key=repr)
    near = [(r.query_id, r["rank"], r.vec_id) for r in curves.nearest(df, F.col("vec_id") % 50 == 0, 5).collect()]
    assert {v for q, _, v in near} <= {7, 8, 50} and all(q == 50 for q, _, _ in near)


# 6: urls


def test_urls(spark):
    cases = {
        None: ("", ""), "no scheme": ("", ""), "http://A.Com": ("a.com", ""), "x://h?q=/a": ("h", ""), "https://Ä.com/Ab?c#d": ("Ä.com", "/Ab"), "a://b://c/d": ("b:", "//c/d"), "://h/x#y": ("h", "/x"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    host, path = urls.host_and_path(F.col("url"))
    assert {r.url: (r.h, r.p) for r in df.select("url", host.alias("h"), path.alias("p")).collect()} == cases
    rules = queries.URL_RULES
    want = {"http://a.com/en/1": ("com/en/", "block"), "http://www.example.com/en/77": ("example.com/en/7", "allow"), "http://notexample.com/en/7": ("com/en/", "block"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://x.org/fr/": (None, "allow")}
    pages = spark.createDataFrame([(u, None) for u in want], "url string, bad boolean")
    assert {r.url: (r.rule, r.verdict) for r in urls.judge(pages, rules).collect()} == want
    assert urls.judge(pages.where("false"), rules).count() == 0


def test_urls_of_odd_rows(spark):
    names = ("host", "path", "rule", "template", "verdict", "t", "g", "p", "n", "lab", "_block", "_t", "_bad", "a.b")
    long = "http://h.com/" + "/".join(f"s{i}" for i in range(60)) + "/" + "x" * 100_000
    rows = [(u, None) for u in (None, "", "http://h.com/a", "http://h.com/a", long, "://", "http:///x")]
    df = spark.createDataFrame(rows, "url string, bad boolean").withColumns({c: F.lit(7) for c in names})
    got = urls.judge(df, queries.URL_RULES)
    assert sorted(got.columns) == sorted(df.columns) and len(got.collect()) == len(rows)
    assert {r["a.b"] for r in got.collect()} == {7} and {r.verdict for r in got.collect()} == {"allow"}


def test_deep_branches_are_told_apart(spark):
    """Branches that differ at the ninth segment, below a host of many templates."""
    head = "http://h.com/" + "/".join("abcdefgh")
    rows = [(f"{head}/{'ads' if i % 2 else 'news'}/x/{i}", bool(i % 2)) for i in range(400)]
    rows += [(f"http://h.com/w{chr(97 + i % 26)}{'v' * (i // 26)}/p", None) for i in range(3000)]
    got = urls.judge(spark.createDataFrame(rows, "url string, bad boolean"), []).collect()
    assert all((r.verdict == "block") == ("/ads/" in r.url) for r in got) and len(got) == len(rows)


def test_a_bad_branch_is_rejected_alone(spark):
    rows = [(f"http://h.com/{'bad' if i % 2 else 'good'}/{i}", bool(i % 2) if i < 200 else None) for i in range(400)] + [("http://other.com/bad/1", None), (None, None)]
    got = urls.judge(spark.createDataFrame(rows, "url string, bad boolean"), []).collect()
    assert all(r.verdict == ("block" if (r.url or "").startswith("http://h.com/bad") else "allow") for r in got) and len(got) == len(rows)


# 7: mixing


def test_share_out():
    assert mixing.share_out(150, [5, 2, 1], [1000, 1000, 1000]) == [150 * 5 / 8, 150 * 2 / 8, 150 / 8]
    assert mixing.share_out(150, [5, 2, 1], [20, 1000, 1000]) == [20, 130 * 2 / 3, 130 / 3]
    assert mixing.share_out(1e9, [5, 2], [3, 4]) == [3, 4]


def test_routing_repeats_only_when_nothing_fresh_is_left():
    got = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 150, "b": 60}, 2)
    assert sum(got.values()) == 210 and got[("a", "b")] == 100  # all fresh tokens first
    got = mixing.route({("a",): 10, ("a", "b"): 40}, {"a": 20, "b": 60}, 2)
    assert got == {("a",): 20, ("a", "b"): 60} or sum(got.values()) == 80


def test_mix_meets_its_targets(spark):
    got = queries.op7_mixing(spark, SF).join(docs(spark, "doc_id", "source"), "doc_id").toPandas()
    assert (got.taken <= 2 * got["size"]).all() and (got.target <= 2 * got.source_size).all()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    assert sorted(map(tuple, queries.op7_mixing(spark, SF).collect())) == sorted(map(tuple, got[["doc_id", "size", "source_size", "target", "taken"]].itertuples(index=False)))


def test_mix_of_odd_rows(spark):
    df = odd(spark).withColumn("source", F.when(F.col("doc_id") > 5, "s").when(F.col("doc_id") > 3, ""))
    got = mixing.mix(df, F.array("source"), mixing.seeded_key()).collect()
    assert len(got) == len(ODD) and all(r.taken <= 2 * r["size"] for r in got) and {r.h for r in got} == {1}
    assert mixing.mix(df.where("false"), F.array("source"), mixing.seeded_key()).count() == 0


def test_mix_of_overlapping_sources(spark):
    """Documents of one or two sources: targets are met as far as words allow, and nobody is used more than twice."""
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), [["a"], ["b"], ["a", "b"], ["c", "a"], ["c", None]][i % 5]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, s array<string>")
    got = mixing.mix(df, F.col("s"), mixing.seeded_key()).toPandas()
    again = mixing.mix(df.repartition(7), F.col("s"), mixing.seeded_key()).toPandas()
    assert dict(zip(got.doc_id, got.uses, strict=True)) == dict(zip(again.doc_id, again.uses, strict=True))
    assert (got.taken == got.uses * got["size"]).all() and (got.uses <= 2).all() and (got.uses[got["size"] == 0] == 0).all()
    whole = got["size"].sum()
    assert abs(got.taken.sum() - 1.5 * whole) <= 5 * 40
    full = mixing.mix(df, F.col("s"), mixing.seeded_key(), share=2.0).toPandas()
    assert (full.uses <= 2).all() and (full.uses[full["size"] == 0] == 0).all() and 1.9 * whole <= full.taken.sum() <= 2 * whole


# 9: lines


def test_short_passages_go_whole(spark):
    """Every repeated passage of 50 words and two lines or more, whatever its length and what stands around it."""
    rng = random.Random(16)
    line = lambda n: " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    for i in range(120):
        sizes = [60, 5] if i % 4 == 0 else [3, 20, 30] if i % 4 == 1 else [1, 55] if i % 4 == 2 else [rng.randrange(1, 30) for _ in range(12)] + [40]
        passage = [line(n) for n in sizes]
        for copy in range(2):
            around = [[line(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6))] for _ in range(2)]
            rows.append((2 * i + copy, "\n".join(around[0] + passage + around[1])))
            want[2 * i + copy] = "\n".join(around[0] + passage * (not copy) + around[1])
    rows.append((900, "\n".join([line(9)] * 60)))  # one line again and again: its first 50 words stay
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, CLASH).repartition(3)).collect()}
    assert {d: got[d] for d in want} == want
    assert got[900] and set(got[900].split("\n")) == set(rows[-1][1].split("\n")) and len(got[900].split("\n")) < 30


def test_lines_and_licences_of_a_very_long_text(spark):
    """200,000 lines and 600,000 words end in time that grows as the text does."""
    t = licenses.TEMPLATES["bsd"]
    long = "\n".join(f"line {i} {i * 7919 % 1000003}" for i in range(200_000))
    df = spark.createDataFrame([(1, long), (2, "intro\n" + long + "\n" + t), (3, "short")], CLASH)
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert got[1].n_removed == 0 and got[1].text == long and got[2].n_removed == 200_000 and got[2].text == "intro\n" + t
    found = {r.doc_id: list(r.licenses) for r in licenses.annotate(df).collect()}
    assert found == {1: [], 2: ["bsd"], 3: []}


def test_repeated_passages_go_from_all_but_the_first(spark):
    rng = random.Random(6)
    line = lambda: " ".join(f"t{rng.randrange(10**6)}" for _ in range(12))
    shared = [line() for _ in range(12)]
    rows = [(i, "\n".join([line() for _ in range(5)] + (shared if i % 3 == 0 else []) + [line() for _ in range(4)])) for i in range(30)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, CLASH)).collect()}
    for i, t in rows:
        left = got[i].text.split("\n")
        if i % 3 or i == 0:
            assert got[i].text == t and got[i].n_removed == 0
        else:
            own = t.split("\n")
            assert got[i].n_removed == len(own) - len(left) >= 8 and set(own) - set(left) <= set(shared)


def test_lines_of_odd_rows(spark):
    got = lines.dedup_lines(odd(spark))
    assert got.columns == [*[c for c in odd(spark).columns if c != "n_lines"], "n_lines", "n_removed"]
    key = lambda x: sorted(x, key=repr)
    assert key((r.doc_id, r.text) for r in got.collect()) == key(ODD)
    assert lines.dedup_lines(none(spark)).count() == 0


# 10: licences


def test_licences(spark):
    t = licenses.TEMPLATES
    noise = " ".join(f"n{i}" for i in range(300))
    changed = t["mit-notice"].replace("merge,", "merge").replace("free of charge", "at no charge")
    rows = [(1, noise + " " + t["apache-2.0-header"] + " " + noise), (2, f"{noise} released UNDER the MIT License. {noise}"), (3, noise), (4, changed), (5, "Licensed under CC BY-NC 4.0."), (6, "Licensed under something else entirely, version 2.0")]
    got = {r.doc_id: list(r.licenses) for r in licenses.annotate(spark.createDataFrame(rows, CLASH)).collect()}
    assert got == {1: ["apache-2.0-header", "apache-2.0-line"], 2: ["mit-line"], 3: [], 4: ["mit-notice"], 5: ["cc-by-nc-4.0"], 6: []}
    assert licenses.annotate(odd(spark)).count() == len(ODD) and sorted(licenses.annotate(odd(spark)).columns) == sorted(odd(spark).columns)
    many = {f"t{i}": " ".join(f"l{i}w{k}" for k in range(6 + i % 30)) for i in range(2500)}  # more than a pass
    found = licenses.annotate(spark.createDataFrame([(1, noise + " " + many["t7"]), (2, many["t2400"] + " x " + many["t1200"])], CLASH), many).collect()
    assert {r.doc_id: list(r.licenses) for r in found} == {1: ["t7"], 2: ["t1200", "t2400"]}
    assert licenses.annotate(none(spark)).count() == licenses.annotate(none(spark), {}).count() == 0


# Queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    cell = lambda v: "~" if pd.isna(v) else format(float(v), ".10g") if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    rows = lambda d: sorted(tuple(map(cell, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_pipeline_stages(spark, voc):
    import corpus_pipeline as p

    start = spark.read.parquet(f"{SF}/documents.parquet")
    lost = spark.createDataFrame([(9001, "12 !!", None, None, 5), (9002, None, "en", "src0", 0)], start.schema)
    kept, seen = start.unionByName(lost), []
    for _, stage in p.STAGES[:-1]:
        before, kept = kept, common.Scratch(spark, "p").keep(stage(spark, kept, SF), "stage")
        assert kept.columns == start.columns
        seen.append((before.toPandas(), kept.toPandas()))
    (a, b), (_, c), (c2, d), (_, e) = seen
    assert set(a.doc_id) - set(b.doc_id) == {9001, 9002}
    assert len(c) <= len(b) and (c.text.str.len() == c.n_chars).all()
    groups = {x for _, _, x in brute_components(list(zip(c2.doc_id.tolist(), c2.text.tolist(), strict=True)), 5)}
    assert sorted(d.doc_id) == sorted(groups)
    words_in, words_out = d.text.map(lambda t: len(words(t))).sum(), e.text.map(lambda t: len(words(t))).sum()
    assert abs(words_out - 1.5 * words_in) < 0.1 * words_in and e.groupby("doc_id").size().max() <= 2
    last = p.STAGES[-1][1](spark, kept, SF).toPandas()
    assert len(last) == len(e) and last.lossless.all()
    s, text = pieces.Sampler(voc), dict(zip(e.doc_id, e.text, strict=True))
    assert all(s.decode(list(r.pieces)) == text[r.doc_id] for r in last.itertuples())


def test_pipeline_runs_on_odd_tables(spark, tmp_path):
    """run() over null, empty, repeated and very long texts, columns with clashing names, and no rows at all."""
    import corpus_pipeline as p

    start = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ("size", "uses", "taken", "lang_pred", "score", "n_removed", "pieces", "lossless", "kept", "a.b")
    strange = [(9001, "12 !!", None, None, 5), (9002, None, "en", None, 0), (9003, "", None, "x", 0), (None, "some words of a text " * 9, "en", None, 189), (9005, LONG, None, "x", len(LONG)), (9005, LONG, None, "x", len(LONG))]
    rows = start.unionByName(spark.createDataFrame(strange, start.schema)).withColumns({c: F.lit(1) for c in names})
    rows.write.parquet(f"{tmp_path}/all/documents.parquet")
    rows.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    got = p.run(spark, f"{tmp_path}/all").toPandas()
    assert len(got) and got.lossless.all() and not set(got.doc_id) & {9001, 9002, 9003} and got.groupby("doc_id").size().max() <= 2
    assert p.run(spark, f"{tmp_path}/none").count() == 0
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/all/documents.parquet"), SF).columns == rows.columns


def test_arcs_are_those_of_the_vocabulary(voc):
    word = "▁unbelievable日"
    _, start, end, k = lattice.Lattices(voc).arcs([word, "▁a"])
    own = {(s, e, p) for s, e, p in zip(start.tolist(), end.tolist(), k.tolist(), strict=True) if e <= len(word)}
    want = {(i, j, voc.ids[word[i:j]]) for i in range(len(word)) for j in range(i + 1, len(word) + 1) if word[i:j] in voc.ids}
    assert want <= own and all(p < 0 for *_, p in own - want)
