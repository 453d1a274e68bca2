"""SimHash links, near copies and components against direct computation."""

import numpy as np
import pytest
import xxhash

from lumenrel.llm import simhash
from lumenrel.llm._graph import components, forest


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


class Sets(dict):
    def find(self, a):
        while self.setdefault(a, a) != a:
            a = self[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_fingerprints_and_components(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = simhash.linked(odd_docs).collect()
    assert len(got) == len(rows)
    prints = {t: fingerprint(t) for _, t in rows}
    sets = Sets()
    ids = sorted({i for i, _ in rows if i is not None})
    text = dict(rows)
    for a in ids:
        for b in ids:
            if b < a and (prints[text[a]] ^ prints[text[b]]).bit_count() <= 4:
                sets.join(a, b)
    assert {r.fingerprint for r in got} == {f"{x:016x}" for x in prints.values()}
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[text[r.doc_id]]:016x}", sets.find(r.doc_id))


@pytest.mark.parametrize("block", [4096, 16])
def test_ring_finds_every_link(spark, monkeypatch, block):
    """Dense balls of fingerprints, also where keys are split into blocks."""
    rng = np.random.default_rng(1)
    monkeypatch.setattr(simhash, "BLOCK", block)
    centers = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = set(centers.tolist())
    for c in centers.tolist():
        for _ in range(80):
            x = c
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = simhash.fingerprint_links(spark.createDataFrame([(x, 0) for x in signed], "fp long, which int"))
    found = Sets()
    for r in edges.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4
        found.join(r.a, r.b)
    want = Sets()
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                want.join(signed[i], signed[j])
    assert [found.find(x) for x in signed] == [want.find(x) for x in signed]


def test_pigeonring_never_prunes_a_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
        assert any(simhash._near(np.array([x]), first)[0] for first in range(simhash.SEGMENTS))


def jaccard_components(rows, size=5, least=0.8):
    sets, shingles = Sets(), {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        shingles[i] = {b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    ids = sorted(shingles)
    for a in ids:
        for b in ids:
            if b < a:
                x, y = shingles[a], shingles[b]
                if (not x and not y) or (x and y and len(x & y) >= least * len(x | y)):
                    sets.join(a, b)
    return {i: sets.find(i) for i in ids}


def test_near_copies(docs, corpus, no_docs, odd_docs):
    want = jaccard_components([(r[0], r[1]) for r in corpus])
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == want
    kept = simhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 3
    assert simhash.deduplicated(no_docs).count() == 0 and simhash.linked(no_docs).count() == 0


def test_near_copies_with_passages_added_or_cut(spark):
    """Pairs just above and below the threshold whose difference is one passage."""
    rng, rows, want = np.random.default_rng(3), [], {}
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    for k in range(120):
        own = words(n := int(rng.integers(40, 400)))
        size = n - 4
        more = int(size * 0.25) + (k % 3 == 2)  # size / (size + more) is 0.8 or just more; or just less
        at = (0, n // 2, n)[k % 4 % 3]
        other = own[:at] + words(more - 4 * (0 < at < n)) + own[at:]
        a, b = (own, other) if k % 2 else (other, own)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    want = jaccard_components(rows)
    assert 50 < sum(i != x for i, x in want.items()) < 110
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


@pytest.mark.parametrize("frequent", [500_000, 0])
@pytest.mark.parametrize("cell", [1024, 4])
def test_near_copies_beside_a_head_unlike_them(spark, monkeypatch, frequent, cell):
    """Pairs that are similar to each other only, in groups whose least id is similar to neither."""
    monkeypatch.setattr(simhash, "FREQUENT", frequent)
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 9000, n)]
    rows = []
    for k in range(3):  # the same words in another order, the words, and two of them swapped
        own = words(200)
        swapped = own[:50] + [own[51], own[50]] + own[52:]
        rows += [" ".join(rng.permutation(own)), " ".join(own), " ".join(swapped)]
    for k in range(3):  # one long passage in all, then long ends of their own or short ones
        passage = words(100)
        rows += [" ".join(passage + words(60)) for _ in range(9)] + [" ".join(passage + words(5)) for _ in range(2)]
        rows += [" ".join(words(60) + passage) for _ in range(2)]
    rows = list(enumerate(rows))
    want = jaccard_components(rows)
    assert sum(i != x for i, x in want.items()) == 6
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_near_copies_come_through_fingerprints(spark, monkeypatch):
    """The ring alone finds copies with a changed word; texts that link but are not similar enough stay apart."""
    monkeypatch.setattr(simhash, "_prefixes", lambda docs, *_: spark.createDataFrame([], "key long, id long, n int, rest int"))
    rng, rows = np.random.default_rng(6), []
    for _ in range(40):
        own = [f"w{x}" for x in rng.integers(0, 9000, 600)]
        rows += [" ".join(own), " ".join([*own[:300], "changed", *own[301:]])]
    rows = [*enumerate(rows), (80, "one two three"), (81, "one two three " * 400), (82, "a " * 300 + "b"), (83, "a " * 300 + "c d")]
    want = jaccard_components(rows)
    near = [(fingerprint(a) ^ fingerprint(b)).bit_count() <= 4 for (_, a), (_, b) in zip(rows[82::2], rows[83::2], strict=True)]
    assert near == [True] and want[83] == 83
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[82] == 82 and got[83] == 83 and sum(got[i] == i - 1 for i in range(1, 80, 2)) >= 30


def test_components_of_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(0, 120)] + [(1000 + i, 2000) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(1, 121)} | {i: 1000 for i in [*range(1001, 1050), 2000]}
    hi, lo = forest(np.array([5, 9, 9]), np.array([3, 5, 1]))
    assert dict(zip(hi.tolist(), lo.tolist(), strict=True)) == {3: 1, 5: 1, 9: 1}
