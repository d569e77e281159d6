"""Joins, searches and sharding against brute force."""

import random
import zlib

import numpy as np
import pytest
from conftest import SF

from folio.llm import embed_dedup, hnsw, kd_shards, ngram_join
from folio.llm.common import connected_components


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_classes(rows, k, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, k))
    links = []
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                links.append((a, b))
    return components(ids, links)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows = []
    for family in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 40, 90, 200]))]
        for _ in range(rng.choice([1, 2, 12, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = word()
            if family % 3 == 0:
                at = rng.randrange(len(copy))
                copy[at:at] = passage
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,percent,small", [(0, 4, 85, False), (1, 5, 80, True), (2, 1, 60, True)])
def test_jaccard_classes(spark, monkeypatch, seed, k, percent, small):
    if small:  # many blocks and pairs of blocks
        monkeypatch.setattr(ngram_join, "KEY_BLOCK", 5)
        monkeypatch.setattr(ngram_join, "TEXT_BLOCK", 2500)
    rows = corpus(seed)
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, percent).collect()
    want = brute_classes(rows, k, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) < len(rows)
    assert all(r["n_shingles"] == len(shingles(t, k)) for r, (_, t) in zip(sorted(got), sorted(rows), strict=True))


def test_jaccard_odd(odd, empty):
    got = {}
    for r in ngram_join.jaccard_classes(odd, 4, 85).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert [len(got[i]) for i in (1, 2)] == [1, 2] and {c for i in (1, 2) for _, c in got[i]} == {1}
    assert got[3] == [(0, 3)] and got[4] == [(0, 4)] and got[5] == [(0, 5)] and got[None][0][1] is None
    assert got[10] == [(1, 10)] and got[11] == [(1, 10)] and got[8] == [(1, 8)] and got[9] == [(1, 9)]
    assert ngram_join.jaccard_classes(empty).count() == 0
    kept = ngram_join.one_of_each(odd, 4, 85)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10]


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 300, dtype=np.uint64) * np.uint64(4)
    sets = [np.unique(np.concatenate([rng.choice(base, n, replace=False), rng.integers(0, 1 << 63, 20, dtype=np.uint64)])) for n in rng.integers(1, 280, 120)]
    sizes = np.array([len(s) for s in sets])
    maps = [ngram_join.signature(s).tobytes() for s in sets]
    for side in (np.zeros(120, int), rng.integers(1, 3, 120)):
        found = set()
        for i, j, _ in ngram_join.candidate_pairs(maps, sizes, side, 80):
            found |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        for a in range(120):
            for b in range(a + 1, 120):
                common = len(np.intersect1d(sets[a], sets[b]))
                across = side[a] == 0 or side[a] != side[b]
                if across and 100 * common >= 80 * (sizes[a] + sizes[b] - common):
                    assert (a, b) in found


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {x for e in edges for x in e if e[0] != e[1]}
    assert got == components(ids, [e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed, n=400, size=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(40, size))
    v = (centers[rng.integers(0, 40, n)] + rng.normal(size=(n, size)) * rng.choice([0, 0.05, 0.2, 0.5], n)[:, None]).astype(np.float32)
    return [(i, [float(x) for x in row], int(rng.integers(0, 3))) for i, row in enumerate(v)]


ODD_VECTORS = [
    (1000, None, 1), (1001, [0.0] * 16, 1), (1002, [1.0] * 15 + [None], 1), (1003, [float("nan")] * 16, 1), (1004, [float("inf")] + [1.0] * 15, 1),
    (1005, [], 1), (1006, [1.0] * 16, None), (1007, [1.0] * 16, 1), (1007, [1.0] * 16, 1), (1008, [2.0] * 16, 1), (None, [1.0] * 16, 1), (1009, [1.0] * 3, 1),
]
KIND = "vec_id long, embedding array<float>, label int"


def brute_links(rows, threshold=0.93):
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (v @ v.T >= threshold) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("block", [1024, 7])
def test_embedding_links(spark, block):
    rows = vectors(1)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, KIND), recall=1 - 1e-9, block=block).collect()}
    near = brute_links(rows)
    assert near.sum() > 500
    assert [got[i]["n_links"] for i in range(len(rows))] == near.sum(axis=1).tolist()
    want = components(range(len(rows)), np.argwhere(near).tolist())
    assert {i: r["component_id"] for i, r in got.items()} == want and all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_embedding_recall_and_plan(spark):
    rows = vectors(2, 1500)
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, KIND)).collect()}
    near = brute_links(rows)
    found = np.array([got[i] for i in range(len(rows))])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.999 * near.sum()
    assert embed_dedup.plan_tables(10)[0] == 6 and embed_dedup.plan_tables(10**9)[1] > embed_dedup.plan_tables(10**6)[1]


def test_embedding_odd(spark):
    table = spark.createDataFrame(ODD_VECTORS, KIND)
    got = {}
    for r in embed_dedup.near_duplicates(table.selectExpr("*", "1 AS weight", "2 AS rep")).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert all(got[i] == [(0, i, True)] for i in (*range(1000, 1007), 1009)) and got[None] == [(0, None, True)]
    assert got[1007] == [(2, 1007, True)] * 2 and got[1008] == [(2, 1007, False)]
    assert embed_dedup.near_duplicates(table.limit(0)).count() == 0


def test_search(spark):
    rows = vectors(3, 3000)
    got = {}
    for r in hnsw.search(spark.createDataFrame(rows, KIND), shard_rows=900).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q in range(0, 3000, 50):
        found = sorted(got[q])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and q not in [f[1] for f in found]
        assert all(abs(s - u[q] @ u[i]) < 1e-12 for _, i, s in found)
        assert found == [(k + 1, i, s) for k, (i, s) in enumerate(sorted(((i, s) for _, i, s in found), key=lambda x: (-x[1], x[0])))]
        sims = u @ u[q]
        sims[q] = -9
        hits += sum(s >= np.sort(sims)[-5] - 1e-12 for _, _, s in found)
    assert hits >= 0.95 * 5 * 60


def test_recall_of_a_shard_of_production_size():
    rng = np.random.default_rng(8)
    points = rng.normal(size=(hnsw.SHARD_ROWS, 64)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1)[:, None]
    found = hnsw.Index(points).search(points[:200], 6)
    sims = points[:200] @ points.T
    truth = np.argsort(-sims, axis=1)[:, :6]
    hits = sum(len(set(found[i]) & set(truth[i])) for i in range(200)) - 200  # each finds itself
    assert hits >= 0.9 * 5 * 200


@pytest.mark.parametrize("seed", [4, 5])
def test_search_by_cells(spark, seed):
    rows = vectors(seed, 2500)
    table = spark.createDataFrame(rows, KIND).selectExpr("vec_id", "CAST(embedding AS array<double>) AS embedding").repartition(3)
    more = spark.createDataFrame([(9000 + i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.search(table.union(more), shard_rows=60).collect():  # 42 shards
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q in range(0, 2500, 50):
        sims = u @ u[q]
        sims[q] = -9
        hits += sum(sims[i] >= np.sort(sims)[-5] - 1e-12 for i in got[q])
    assert hits >= 0.93 * 5 * 50 and all(i >= 9000 for i in got[9000]) and len(got[9000]) == 5


def test_double_vectors_keep_their_precision(spark):
    near = [(50, [1.0, 1e-9, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1e200, 1e191, 0.0]), (3, [0.0, 1.0, 1e300])]
    table = spark.createDataFrame(near, "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in hnsw.search(table).orderBy("rank").collect()]
    assert set(got) == {1, 2, 3} and got[-1] == 3
    same = table.selectExpr("*", "1 AS label")
    links = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(same, recall=1 - 1e-9).collect()}
    assert links == {50: 2, 1: 2, 2: 2, 3: 0}


def test_search_odd(spark):
    table = spark.createDataFrame([*ODD_VECTORS, (50, [1.0] * 16, 0), (2000, [1.0] + [0.0] * 15, 0)], KIND)
    got = [tuple(r) for r in hnsw.search(table.selectExpr("*", "1 AS rank", "2 AS h1")).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got if g[0] == 50] == [(50, 1, 1006), (50, 2, 1007), (50, 3, 1007), (50, 4, 1008), (50, 5, 2000)]
    assert {g[0] for g in got} == {50, 2000} and hnsw.search(table.limit(0)).count() == 0


def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = kd_shards.shards_of(docs, shards=7).collect()
    text = {d["doc_id"]: d["text"] for d in docs.collect()}
    sizes = {}
    for r in rows:
        data = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        sizes.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert sorted(sizes) == list(range(7)) and len(rows) == len(text)
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in sizes.values())
    totals = [sum(s for _, s in v) for v in sizes.values()]
    largest = max(len(t.encode()) for t in text.values()) + 16
    assert max(totals) - min(totals) <= 3 * largest


def test_equal_texts_share_a_shard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = kd_shards.shards_of(docs, shards=12).collect()
    leaf = sum(r["size"] for r in rows) / 12
    where, weight, total = {}, {}, {}
    for r in rows:
        key = r["text_crc32"], r["size"]
        where.setdefault(key, set()).add(r["shard"])
        weight[key] = weight.get(key, 0) + r["size"]
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
    assert sum(len(w) > 1 for k, w in where.items() if weight[k] <= kd_shards.WHOLE * leaf) == 0
    assert max(total.values()) < 1.1 * leaf and min(total.values()) > 0.9 * leaf


@pytest.mark.parametrize("cut", [False, True])
def test_shards_are_leaves_of_a_serial_tree(spark, cut):
    """The rows of shards 0 to k - 1 weigh what a serial tree over sorted keys gives its first k leaves."""
    rng = random.Random(3)
    texts = ["copy " * 40] * (2500 if cut else 8) + [" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["shard"] for r in kd_shards.shards_of(docs, shards=8).collect()}
    sizes = [len(t) + 16 for t in texts]
    keys = {r["doc_id"]: [r[f"k{k}"] for k in range(4)] for r in kd_shards.metadata(docs).collect()}
    shift = kd_shards.TEXT_BITS + kd_shards.ROW_BITS + kd_shards.COORDINATE_BITS - kd_shards.COARSE

    def split(rows, shards, first):
        if shards == 1:
            assert {got[i] for i in rows} == {first}
            return
        wide = [max(keys[i][k] >> shift for i in rows) - min(keys[i][k] >> shift for i in rows) for k in range(4)]
        k = wide.index(max(wide))
        low = [i for i in rows if got[i] < first + shards // 2]
        high = [i for i in rows if got[i] >= first + shards // 2]
        loose = lambda side: [keys[i][k] for i in side if texts[i] != texts[0]]  # noqa: E731  the hot group may be moved whole
        if loose(low) and loose(high):
            assert max(loose(low)) <= min(loose(high))
        assert abs(sum(sizes[i] for i in low) / sum(sizes[i] for i in rows) - 0.5) < 0.03
        split(low, shards // 2, first)
        split(high, shards - shards // 2, first + shards // 2)

    split(list(got), 8, 0)


def test_shards_odd(spark, odd, empty):
    rows = kd_shards.shards_of(odd, shards=3).collect()
    assert len(rows) == 13 and sum(r["size"] for r in rows) == sum(len((d["text"] or "").encode()) + 16 for d in odd.collect())
    assert kd_shards.shards_of(empty).count() == 0
    same = spark.range(4000).selectExpr("1L AS doc_id", "'copy' AS text")  # one hot group, nothing to tell rows apart but none needed
    assert kd_shards.shards_of(same, shards=4).count() == 4000
    copies = spark.range(4000).selectExpr("id AS doc_id", "'copy' AS text")
    counts = [r["count"] for r in kd_shards.shards_of(copies, shards=4).groupBy("shard").count().collect()]
    assert len(counts) == 4 and max(counts) - min(counts) <= 8
