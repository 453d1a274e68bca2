import collections
import math
import zlib

import numpy as np
import pytest

from lumenrel.llm import _common as c
from lumenrel.llm import katz


def adjusted(counts):
    """Simple Good-Turing from its definition: r -> r*."""
    n = collections.Counter(counts)
    rs = sorted(r for r in n if r <= katz.COUNTS)
    slope = -2.0
    if len(rs) > 1:
        xs, ys = [], []
        for i, r in enumerate(rs):
            q = rs[i - 1] if i else 0
            t = rs[i + 1] if i + 1 < len(rs) else 2 * r - q
            xs.append(math.log(r))
            ys.append(math.log(n[r] / (0.5 * (t - q))))
        mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
        slope = min(-1.05, sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs))
    line = lambda r: r * (1 + 1 / r) ** (slope + 1)
    out = {0: 0.0}
    turing = True
    for r in range(1, max(n, default=0) + 1):
        if turing and r < katz.COUNTS and n[r] and n[r + 1]:
            own = (r + 1) * n[r + 1] / n[r]
            sd = math.sqrt((r + 1) ** 2 * n[r + 1] / n[r] ** 2 * (1 + n[r + 1] / n[r]))
            turing = abs(own - line(r)) > 1.65 * sd and out[r - 1] < own < r
        else:
            turing = False
        out[r] = own if turing else line(r)
    return out


def brute(texts, learn, order):
    """Counts in dictionaries of tuples, and the recursion word by word."""
    docs = {i: [*(t or "").encode().lower().split(), "<e>"] for i, t in texts.items()}
    grams = [collections.Counter() for _ in range(order + 1)]
    for i in learn:
        x = ["<s>"] * (order - 1) + docs[i]
        for k in range(1, order + 1):
            grams[k].update(tuple(x[j - k + 1 : j + 1]) for j in range(order - 1, len(x)))
    total, types = sum(grams[1].values()), len(grams[1])
    star = [None, *(adjusted(g.values()) for g in grams[1:])]
    context = [collections.Counter() for _ in range(order + 1)]
    after = [collections.defaultdict(list) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, r in grams[k].items():
            context[k][g[:-1]] += r
            after[k][g[:-1]].append(g[-1])
    unknown = 1 - sum(star[1][r] for r in grams[1].values()) / total
    alphas = {}

    def p(h, w):
        k = len(h) + 1
        g = (*h, w)
        if k == 1:
            return star[1][grams[1][g]] / total if g in grams[1] else unknown
        if g in grams[k]:
            return star[k][grams[k][g]] / context[k][h]
        if h not in context[k]:
            return p(h[1:], w)
        if h not in alphas:
            alphas[h] = (1 - sum(p(h, v) for v in after[k][h])) / (1 - sum(p(h[1:], v) for v in after[k][h]))
        return alphas[h] * p(h[1:], w)

    out = {}
    for i, x in docs.items():
        padded = ["<s>"] * (order - 1) + x
        score = sum(math.log10(p(tuple(padded[j : j + order - 1]), padded[j + order - 1])) for j in range(len(x)))
        base = sum(math.log10((grams[1][w,] + 0.5) / (total + 0.5 * (types + 1))) for w in x)
        out[i] = len(x), sum((w,) in grams[1] for w in x), total, base, score
    return out, p, [w for w, in grams[1]], list(after[order]), list(after[2]) if order > 1 else []


@pytest.mark.parametrize(("order", "share"), [(1, katz.HOT), (2, katz.HOT), (3, katz.HOT), (3, 1e12), (4, katz.HOT)])
def test_scores_match_direct_computation(docs, corpus, order, share):
    """For several orders, and with all contexts spread."""
    texts = {r[0]: r[1] for r in corpus}
    learn = {i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1}
    want, *_ = brute(texts, learn, order)
    got = {r.doc_id: r for r in katz.score(docs, c.remainder("doc_id", 5) != 1, order, share).collect()}
    assert len(got) == len(texts)
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, i not in learn)
        assert r.base_score == pytest.approx(base, abs=1e-7) and r.score == pytest.approx(score, abs=1e-7)


def test_every_context_sums_to_one(corpus):
    texts = {r[0]: r[1] for r in corpus}
    learn = {i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1}
    _, p, words, three, two = brute(texts, learn, 3)
    for h in [*three[:25], *two[:25], ("<s>", "<s>"), ("never", "seen"), ("the", "unseen"), ()]:
        assert sum(p(h, w) for w in words) + p(h, "another unknown word") == pytest.approx(1, abs=1e-9)


def test_a_stored_model_scores_other_texts(spark, docs, corpus):
    texts = {r[0]: r[1] for r in corpus}
    learn = {i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1}
    want, *_ = brute(texts, learn, 3)
    model = katz.fit(docs.where(c.remainder("doc_id", 5) != 1))
    got = {r.doc_id: r.score for r in model.score(docs).collect()}
    assert len(got) == len(texts) and all(got[i] == pytest.approx(want[i][-1], abs=1e-7) for i in texts)
    assert all(t.count() <= model.parts for t in (*model.tables, *model.weights))


def test_odd_rows(odd_docs, no_docs, docs):
    got = katz.score(odd_docs, c.remainder("doc_id", 5) != 1).collect()
    assert len(got) == odd_docs.count() and sum(r.doc_id is None and r.held_out for r in got) == 3
    assert katz.score(no_docs, c.remainder("doc_id", 5) != 1).count() == 0
    nothing = katz.score(docs, c.remainder("doc_id", 5) > 9).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 and r.held_out for r in nothing)


def test_good_turing_discounts():
    r = np.arange(1, 200)
    for n in (np.array([0, 1000, 300, 140, 80, 50, 35, 20, 100.0]), np.zeros(8), np.array([0, 5, 0, 0, 2, 0, 7.0]), np.array([0, 3, 9, 27, 81, 243, 1.0])):
        d = katz.good_turing(n)
        kept = d.kept(r)
        assert ((kept > 0) & (kept < r)).all() and d.kept(np.zeros(1))[0] == 0
    d = katz.good_turing(np.array([0, 10_000, 2_000, 900, 500, 320, 220, 10.0]))
    assert d.kept(np.array([1]))[0] == pytest.approx(2 * 2_000 / 10_000)
