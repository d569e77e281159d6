"""Language id and quality: held-out accuracy, and defined results for odd rows."""

import zlib

import numpy as np

from folio.llm import langid, quality

DATA = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r for r in langid.held_out_languages(docs).collect()}
    held = [d for d in docs.collect() if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert {i for i, r in rows.items() if r["held_out"]} == {d["doc_id"] for d in held}
    assert np.mean([rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_is_the_nearest_prototype():
    """Cosines by a plain version: every n-gram's vector multiplied and added one by one."""
    p = langid.Profiler(dimensions=64, seed=5)
    texts = ["Ab cde, abé!", "x", "", "12", "été ab ab", None]
    got, has = p.vectors(texts)
    for t, h, ok in zip(texts, got, has, strict=True):
        letters = "".join(c if c.isalpha() else " " for c in (t or "").lower())
        s = " " + " ".join(letters.split()) + " " if letters.strip() else " "
        want = np.zeros(64)
        for i in range(len(s) - 2):
            v = np.ones(64)
            for place, c in enumerate(s[i : i + 3]):
                code = 0 if c == " " else ord(c)
                v *= np.roll(np.random.default_rng([5, code]).integers(0, 2, 64, np.int8) * 2 - 1, 2 - place)
            want += v
        assert ok == any(c.isalpha() for c in t or "") and (not ok or np.allclose(h, want))


def test_language_odd(odd, empty):
    rows = langid.held_out_languages(odd).collect()
    assert len(rows) == 13
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], r)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5, 6)) and by[None]["held_out"] is False
    assert langid.held_out_languages(empty).count() == 0
    kept = langid.identified(odd, langid.fit(odd))
    # 9 is forty thousand times one letter, which no language has
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 7, 8, 10, 11, None}


def test_long_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").select("doc_id", "text", "lang")
    rng = np.random.default_rng(4)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    foreign = [draw("абвгдежзийклмнопрстуфхцчшщ   ", 2_000), draw([chr(c) for c in range(0x4E00, 0x9FA5)], 500), "x" * 30_000, draw("0123456789abcdef", 5_000)]
    short = ["Avec.", "Ωραία μέρα", "x"]
    rows = [(-1 - i, t, None) for i, t in enumerate(foreign + short)]
    both = docs.union(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = langid.fit(both)
    kept = {r["doc_id"] for r in langid.identified(both, model).collect()}
    assert {i for i in kept if i < 0} == {-5, -6, -7}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert kept - {-5, -6, -7} == {i for i, t in texts.items() if any(c.isalpha() for c in t)}
    # cosines by the plain definition
    vectors, _ = langid.profiler(model.dimensions, model.gram, model.seed).vectors(foreign)
    cosine = [max(float(np.dot(v, p)) / np.linalg.norm(v) for p in model.prototypes) for v in vectors]
    assert max(cosine) < langid.FLOOR
    assert langid.identified(both, langid.fit(both.where("lang is null"))).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in quality.held_out_quality(docs, labels).collect()}
    held = [x for x in labels.collect() if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    assert len(rows) == docs.count() and all(rows[x["doc_id"]]["held_out"] for x in held)
    assert np.mean([rows[x["doc_id"]]["predicted"] == x["quality"] for x in held]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (6, 0), (6, 0), (None, 1), (7, None), (8, 1)], "doc_id long, quality int")
    rows = quality.held_out_quality(odd, labels).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.held_out_quality(odd, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.held_out_quality(empty, labels).count() == 0
    assert quality.good_documents(odd, labels).columns == odd.columns


def test_isotonic_never_falls():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 9, 200).astype(float)
    hits = np.minimum(n, rng.integers(0, 9, 200))
    knots, levels = quality.isotonic(np.arange(200.0), hits, n)
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all() and levels.min() >= 0 and levels.max() <= 1


def test_statistics_of_one_text_do_not_depend_on_its_neighbours():
    texts = ["A b c.\nA b c.", None, "", "x" * 50, "ÀÉ ù | 12 !!", " \n "]
    together = quality.statistics(texts)
    assert np.allclose(together, np.concatenate([quality.statistics([t]) for t in texts])) and not together[1].any()


def test_language_vectors_of_long_and_varied_texts(monkeypatch):
    """Pieces and groups of n-grams add up to the same vectors, and memory stays bounded over a large script."""
    import resource

    rng = np.random.default_rng(4)
    texts = ["".join(chr(c) for c in rng.choice([*range(97, 123), 32, 46, 233], n)) for n in (3, 50, 4000, 9000)] + ["...", None, "ab", "a"]
    want, has = langid.Profiler(dimensions=64).vectors(texts)
    monkeypatch.setattr(langid, "LONG", 700)
    monkeypatch.setattr(langid, "GROUP", 90)
    monkeypatch.setattr(langid, "GRAM_CACHE", 200)
    monkeypatch.setattr(langid, "LETTER_CACHE", 40)
    got, same = langid.Profiler(dimensions=64).vectors(texts)
    assert np.allclose(got, want) and (has == same).all()
    monkeypatch.undo()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    codes = rng.integers(0x4E00, 0x9FA5, 60_000)
    h, _ = langid.Profiler().vectors(["".join(map(chr, codes))])
    assert h.any() and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_language_prototypes_are_sums_of_unit_vectors(spark):
    rows = [("ab cd", "x"), ("abc", "x"), ("zz yy zz", "y"), (None, "y"), ("12", "y"), ("other", None)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3), dimensions=128)
    h, _ = langid.Profiler(dimensions=128).vectors([t for t, _ in rows])
    for lang, got in zip(model.languages, model.prototypes, strict=True):
        mine = [i for i, (t, x) in enumerate(rows) if x == lang and t and t != "12"]
        want = sum(h[i] / np.linalg.norm(h[i]) for i in mine)
        assert np.allclose(got, want / np.linalg.norm(want), atol=1e-5)
    names, score = model.predict(["ab", "zz", None])
    cosines = [max(range(2), key=lambda k, v=v: v @ model.prototypes[k]) for v in langid.Profiler(dimensions=128).vectors(["ab", "zz"])[0]]
    assert names == [*(model.languages[c] for c in cosines), "und"] and score[2] == 0


def plain_quality(texts, labels, features=quality.FEATURES):
    """Scores of all texts by closed forms: one matrix, one solve, isotonic levels by the min-max formula over bins."""
    stats = quality.statistics(texts)
    at = [i for i, y in enumerate(labels) if y is not None]
    x, y = stats[at], np.array([labels[i] for i in at], float)
    scale = x.std(axis=0)
    rng = np.random.default_rng(quality.SEED)
    w = rng.normal(size=(x.shape[1], features)) / quality.WIDTH
    phase = rng.uniform(0, 2 * np.pi, features)
    z = lambda s: np.hstack([np.cos(np.clip((s - x.mean(axis=0)) / np.where(scale > 1e-9, scale, 1), -6, 6) @ w + phase) * np.sqrt(2 / features), np.ones((len(s), 1))])
    penalty = np.full(features + 1, quality.RIDGE * len(y) / features)
    penalty[-1] = 0
    beta = np.linalg.solve(z(x).T @ z(x) + np.diag(penalty), z(x).T @ y)
    bins = np.clip(np.floor((z(x) @ beta + 0.5) / 2 * quality.BINS), 0, quality.BINS - 1)
    values = np.unique(bins)
    hits, n = (np.array([f(bins == v) for v in values], float) for f in (lambda m: y[m].sum(), np.sum))
    mean = lambda j, k: hits[j : k + 1].sum() / n[j : k + 1].sum()
    level = [max(min(mean(j, k) for k in range(i, len(values))) for j in range(i + 1)) for i in range(len(values))]
    middle = (values + 0.5) / quality.BINS * 2 - 0.5
    knots = [(np.average(middle[[i for i in range(len(level)) if level[i] == v]], weights=n[[i for i in range(len(level)) if level[i] == v]]), v) for v in sorted(set(level))]
    return np.clip(np.interp(z(stats) @ beta, *zip(*knots, strict=True)), 0, 1)


def test_quality_scores_equal_closed_forms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    learn = [labels.get(d["doc_id"]) if zlib.crc32(str(d["doc_id"]).encode()) % 5 else None for d in docs]
    want = plain_quality([d["text"] for d in docs], learn)
    got = quality.held_out_quality(spark.createDataFrame(docs).repartition(3), spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    score = {r["doc_id"]: r["score"] for r in got.collect()}
    assert np.allclose([score[d["doc_id"]] for d in docs], want, atol=1e-6)


def test_statistics_of_a_small_text():
    row = dict(zip(quality.STATISTICS, quality.statistics(["Ab cd cd\nAB! 12"])[0], strict=True))
    assert np.isclose(row["log_chars"], np.log(16)) and np.isclose(row["log_words"], np.log(6))
    assert np.isclose(row["mean_word"], 11 / 5) and np.isclose(row["distinct_words"], 4 / 5) and np.isclose(row["top_word"], 2 / 5)
    assert np.isclose(row["lower"], 5 / 15) and np.isclose(row["upper"], 3 / 15) and np.isclose(row["digits"], 2 / 15) and np.isclose(row["upper_words"], 1 / 5)
    assert np.isclose(row["bare_words"], 1 / 5) and np.isclose(row["bang_words"], 1 / 5) and row["stop_lines"] == 0
