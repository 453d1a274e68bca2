"""Language identification, quality, mixing and vector search."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenrel.llm import _common as c
from lumenrel.llm import _features, gam_quality, langid, mixing, posting_lists

ENGLISH = "the quick brown fox and the lazy dog were there with all of their friends by the river in the morning light".split()
GERMAN = "der schnelle braune fuchs und der faule hund waren dort mit allen ihren freunden am fluss im morgenlicht über nacht".split()
ODD = [(900, None), (901, ""), (902, "123 !!"), (903, "ß"), (904, "the " * 20_000), (None, "the river")]


@pytest.fixture(scope="module")
def lang_docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(w, rng.integers(3, 40))), l) for i in range(200) for w, l in [((ENGLISH, "en"), (GERMAN, "de"))[i % 2]]]
    return spark.createDataFrame(rows + [(i, t, None) for i, t in ODD] + rows[:3], "doc_id long, text string, lang string").repartition(3)


def test_language(spark, lang_docs):
    got = langid.identify(lang_docs, c.remainder("doc_id", 3) == 1).collect()
    assert len(got) == 200 + len(ODD) + 3
    truth = {r.doc_id: r.lang for r in lang_docs.collect()}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0 and by[903].lang_pred != "und" and by[904].lang_pred == "en"
    again = {r.doc_id: r.score for r in langid.identify(lang_docs.repartition(5), c.remainder("doc_id", 3) == 1).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(empty, F.lit(False)).count() == 0
    unlearnt = langid.identify(lang_docs.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()
    assert {r.lang_pred for r in unlearnt} == {"und"}


def test_grams_are_those_of_each_text_alone():
    texts = ["Hello wörld", "", "a", "123", "x y  z"]
    bucket, offsets, lettered = langid.grams(texts)
    assert lettered.tolist() == [True, False, True, False, True]
    for i, t in enumerate(texts):
        own, _, _ = langid.grams([t])
        assert sorted(bucket[offsets[i] : offsets[i + 1]].tolist()) == sorted(own.tolist())


def test_elastic_net_makes_weights_sparse():
    rng = np.random.default_rng(1)
    rows = [(np.arange(6), rng.normal(size=6) + np.array([2.0 * y, 0, 0, 0, 0, 0]), y) for y in rng.integers(0, 2, 300).tolist()]
    w = langid.ftrl(rows, 6, 2, 2, 0.1, 1.0, 5.0, 0.1)
    assert (w[1:6] == 0).any() and w[0, 1] > 0 > w[0, 0]


@pytest.fixture(scope="module")
def quality(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        words = rng.choice(ENGLISH, rng.integers(20, 80))
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows + [(i, t) for i, t in ODD], "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame(labels + [(1, None), (2, 7)], "doc_id long, y int")


def test_quality(spark, quality):
    docs, labels = quality
    got = gam_quality.classify(docs, labels, c.remainder("doc_id", 5) == 0, rounds=30).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {r.doc_id: r.y for r in labels.where("y in (0, 1)").collect()}
    assert np.mean([truth[r.doc_id] == r.predicted for r in got if r.held_out and r.doc_id in truth]) > 0.95
    none = gam_quality.classify(docs, labels.where("false"), F.lit(False)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    assert gam_quality.classify(docs.where("false"), labels, F.lit(False)).count() == 0


def test_model_is_a_sum_of_tables():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair of features tells
    m = gam_quality.train(x, y, rounds=40, n_pairs=2)
    assert (0, 1) in m.pairs and np.mean((m.score(x) > 0.5) == y) > 0.9
    at = m.bins(x)
    total = m.intercept + sum(t[a] for t, a in zip(m.tables, at, strict=True)) + sum(g[at[a], at[b]] for (a, b), g in zip(m.pairs, m.grids, strict=True))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-total)))


def test_features_do_not_depend_on_neighbours():
    texts = [b"", b"One two two two two two.\nOne two\nOne two\n", b"ABC!! DEF!!", "été 12 ##".encode(), b"   ", b"x"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    together = _features.features(data, offsets)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], _features.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]), t
    named = dict(zip(_features.NAMES, together[1], strict=True))
    assert named["dup_lines"] == pytest.approx(1 / 3) and named["distinct"] == pytest.approx(3 / 10)


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    got = mixing.targets([10, 1000, 10], [1, 2, 3])
    assert got[2] == 30 and sum(got) == pytest.approx(1020) or got == pytest.approx([30, 960, 30])
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []


def test_mixing_when_nothing_fits(spark):
    """One long document a source: no rest can be filled."""
    rows = [(1, "w " * 500, "a"), (2, "w " * 300, "b"), (3, "w " * 700, "c")]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: (r.source_size, r.target, r.copies * r.size <= 3 * r.size) for r in got} == {1: (500, 250.0, True), 2: (300, 500.0, True), 3: (700, 750.0, True)}
    assert {r.doc_id: r.copies for r in got} == {1: 0, 2: 2, 3: 1}


def test_splitting_tree():
    tree = mixing.SplittingTree([50, 7, 0, 120], 8, 3)
    quotas = np.array([tree.quota(s) for s in range(8)])
    assert quotas.sum(0).tolist() == [50, 7, 0, 120] and set(quotas.sum(1).tolist()) <= {22, 23}
    again = mixing.SplittingTree([50, 7, 0, 120], 8, 3)
    for source, n in enumerate([50, 7, 0, 120]):
        dealt = [again.shard(source, k) for k in range(n)]
        assert dealt == sorted(dealt) and np.bincount(dealt, minlength=8).tolist() == quotas[:, source].tolist()


@pytest.fixture(scope="module")
def mix_docs(spark):
    rng = np.random.default_rng(6)
    names = ["a", "b", "b", "b", "B", None, "zero"]
    rows = [(i, "w " * int(rng.integers(0, 60)) if names[i % 7] != "zero" else " ", names[i % 7], i, "k") for i in range(1400)]
    return spark.createDataFrame([*rows, *rows[:3], (None, "x y", "a", 0, "k"), (2000, None, "a", 0, "k"), (2001, "big " * 3000, "b", 0, "k")], "doc_id long, text string, source string, n_chars long, key string").repartition(4)


def test_mixing(spark, mix_docs):
    got = mixing.plan(mix_docs).collect()
    assert len(got) == mix_docs.count()
    sizes = {}
    for r in mix_docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))]), strict=True))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3 == 3 and len(r.shards) == r.copies
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(20, 0.01 * want[s]), s
    key = lambda rows: sorted((r.doc_id or -1, r.copies, r.shards) for r in rows)
    assert key(mixing.plan(mix_docs.repartition(7)).collect()) == key(got)
    rows = mixing.mixed(mix_docs)
    assert rows.columns == mix_docs.columns
    count = rows.groupBy("doc_id").count().collect()
    ids = {}
    for r in got:
        ids[r.doc_id] = ids.get(r.doc_id, 0) + r.copies
    assert {r.doc_id: r["count"] for r in count} == {i: n for i, n in ids.items() if n}
    assert mixing.plan(mix_docs.where("false")).count() == 0 and mixing.mixed(mix_docs.where("false")).count() == 0


def test_search(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    x[:400] = x[0]  # a large group of copies
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [float("inf")] + [1.0] * 15), (5004, [None] + [1.0] * 15), (5005, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + bad + rows[:2], "vec_id long, embedding array<float>").withColumn("list", F.lit("x")).withColumn("part", F.lit(1)).repartition(3)
    got = posting_lists.search(df, F.col("vec_id") % 20 == 0).collect()
    x = np.array([v for _, v in rows])
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 3000, 20))
    hits = []
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        scores = x @ x[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(3000), -(x * x[q]).sum(1) + np.where(np.arange(3000) == q, np.inf, 0)))[:20]
        hits.append(len({r.vec_id for r in found} & set(best.tolist())) / 20)
        assert [r["rank"] for r in found] == list(range(1, 21)) and all(abs(r.score - scores[r.vec_id]) < 1e-9 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
    assert np.mean(hits) > 0.95
    few = posting_lists.search(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]
    assert posting_lists.search(df.where("false"), F.lit(True)).count() == 0


def test_lists_of_many_centers_in_bounded_memory():
    """Lists of many rows among many centers: the same as from all distances at once, a few of which are held at a time; copies go on in small batches."""
    rng = np.random.default_rng(8)
    x, centers = rng.normal(size=(6000, 8)), rng.normal(size=(4096, 9))
    index = posting_lists.Index(centers, float(np.sqrt((x**2).sum(1).max())), [])
    tracemalloc.start()
    row, which = index.lists_of(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    full = np.column_stack((x, np.sqrt(np.maximum(index.norm**2 - (x**2).sum(1), 0))))[::600]
    for r, d in zip(range(0, 6000, 600), posting_lists.distances(full, centers), strict=True):
        top = np.argsort(d, kind="stable")[: posting_lists.COPIES]
        assert which[row == r].tolist() == [t for k, t in enumerate(top) if not k or d[t] <= posting_lists.CLOSE**2 * d[top[0]] + 1e-12]
    b = pa.RecordBatch.from_pydict({"vec_id": [7, 9], "embedding": [[1.0, 2.0], [3.0, 4.0]]})
    out = list(posting_lists.copied(b, np.repeat([0, 1], 20_000), np.arange(40_000), "query_id"))
    assert max(o.num_rows for o in out) <= 1 << 13 and [v for o in out for v in o["list"].to_pylist()] == list(range(40_000))
    assert out[0]["query_id"][0].as_py() == 7 and out[-1]["embedding"][-1].as_py() == [3.0, 4.0]
