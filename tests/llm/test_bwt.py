import hashlib
import random

import numpy as np
import pytest

from lumenrel.llm import _anchors, bwt_dedup


def brute(rows, span=50):
    first = {}
    for i, t in rows:
        if i is not None and t:
            b = t.encode()
            for k in range(len(b) - span + 1):
                s = b[k : k + span]
                first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in rows:
        b = np.frombuffer((t or "").encode(), np.uint8)
        gone = np.zeros(len(b), bool)
        if i is not None:
            raw = b.tobytes()
            for k in range(len(b) - span + 1):
                if first[raw[k : k + span]] < i:
                    gone[k : k + span] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out[i, t] = (len(b), int(gone.sum()), spans, hashlib.sha256(b[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "long"), [(20_000, bwt_dedup.LONG), (1, bwt_dedup.LONG), (20_000, 300), (1, 120)])
def test_spans_match_direct_computation(odd_docs, hot, long):
    """Also with all anchors spread by string, and with texts cut into pieces."""
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    want = brute(rows)
    got = bwt_dedup.deduplicated(odd_docs.drop("n_bytes"), hot, long)
    assert {"part", "chunk", "block", "kind"} <= set(got.columns)
    plain = bwt_dedup.spans(odd_docs, hot, long).collect()
    assert len(plain) == len(rows)
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(want[i, t])
    for r in plain:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in by_id[r.doc_id]


def test_the_merge_decides(docs, monkeypatch):
    """Without what the merged transforms find, nothing goes that repeats another chunk."""
    apart = docs.repartition(40, "doc_id")
    assert sum(r.n_removed > 0 for r in bwt_dedup.spans(apart).collect()) > 5
    monkeypatch.setattr(bwt_dedup, "_merge", lambda batches: iter(()))
    monkeypatch.setattr(bwt_dedup, "CHUNK_BYTES", 4)
    rows = [r.n_removed > 0 for r in bwt_dedup.spans(apart).collect()]
    assert sum(rows) <= 5


def test_empty(no_docs):
    assert bwt_dedup.spans(no_docs).count() == 0


def test_texts_lose_what_repeats(spark):
    rng = random.Random(2)
    shared = " ".join(str(rng.random()) for _ in range(10))
    df = spark.createDataFrame([(1, "start " + shared), (2, shared + " end é"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in bwt_dedup.deduplicated(df).collect()}
    assert got == {1: "start " + shared, 2: " end é", 3: None}


def test_equal_strings_pick_equal_anchors():
    rng = random.Random(4)
    text = bytes(rng.choice(b"ab c") for _ in range(4000))
    data = np.frombuffer(text + b"##" + text[1000:1400], np.uint8)
    offsets = np.array([0, 4002, len(data)])
    at, first, last, gram = _anchors.anchors(data, offsets, _anchors.Hashes(data))
    covered = {}
    for a, f, l, g in zip(at.tolist(), first.tolist(), last.tolist(), gram.tolist(), strict=True):
        for s in range(f, l + 1):
            covered[s] = (a - s, g)
    assert set(covered) == {s for s in range(len(data) - 49) if not (4002 - 49 <= s < 4002)}
    for s in range(4002, len(data) - 49):
        assert covered[s] == covered[s - 4002 + 1000]


def test_merged_transforms_find_all_repeats():
    rng = random.Random(6)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 70))) for _ in range(30)]
    strings += [strings[0], strings[1][:55], b"xx" + strings[2][:50] + b"yy"]
    shards = []
    for part in (strings[:10], strings[10:25], strings[25:]):
        size = np.array([len(s) + 1 for s in part])
        data = np.frombuffer(b"".join(s + b"\xff" for s in part), np.uint8)
        starts = np.cumsum(size) - size
        order = bwt_dedup.rotation_order(data, starts, size)
        rotations = [(data[s:e].tobytes() * 2) for s, e in zip(starts, starts + size, strict=True)]
        owner = np.repeat(np.arange(len(part)), size)
        keys = [rotations[owner[r]][r - starts[owner[r]] :][: size[owner[r]]] for r in order]
        assert keys == sorted(keys)
        before = np.where(order == starts[owner[order]], (starts + size)[owner[order]] - 1, order - 1)
        row = np.empty(len(data), np.int64)
        row[order] = np.arange(len(order))
        shards.append((data[before], row[starts + size - 1], size - 1))
    block, string, place = bwt_dedup.merge_transforms(shards)
    got = {}
    for b, s, p in zip(block.tolist(), string.tolist(), place.tolist(), strict=True):
        got.setdefault(strings[s][p : p + 50], set()).add((s, p))
        assert got[strings[s][p : p + 50]] is not None
    want = {}
    for s, t in enumerate(strings):
        for p in range(len(t) - 49):
            want.setdefault(t[p : p + 50], set()).add((s, p))
    assert got == {k: v for k, v in want.items() if len(v) > 1}
