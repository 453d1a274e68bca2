import random

import numpy as np
import pytest

from lumenrel.llm import unigram_pieces as P

MODEL = P.DEFAULT_MODEL


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.load(MODEL)


def pieces_of(v):
    t = v.trie
    out = {}
    stack = [(0, b"")]
    while stack:
        s, key = stack.pop()
        if t.value[s] >= 0:
            out[key] = int(t.value[s])
        out_states = [(int(t.base[s]) + b, b) for b in range(256) if t.base[s] > 0 and t.check[t.base[s] + b] == s]
        stack += [(x, key + bytes([b])) for x, b in out_states]
    return out


def brute(v, own, text):
    """Plain dynamic programming over the whole marked text."""
    if not text:
        return []
    t = (b" " + text).replace(b" ", P.MARK)
    best = [(0.0, None, None)] + [None] * len(t)
    for i in range(len(t)):
        if best[i] is None or (t[i] & 0xC0) == 0x80:
            continue
        size = int(P.char_sizes(np.array([t[i]]))[0])
        single = False
        for j in range(i + 1, min(len(t), i + 60) + 1):
            k = own.get(t[i:j])
            if k is not None:
                single |= j - i == size
                s = best[i][0] + v.scores[k]
                if best[j] is None or s > best[j][0]:
                    best[j] = (s, i, k)
        if not single:
            j = min(len(t), i + size)
            s = best[i][0] + v.unknown
            if best[j] is None or s > best[j][0]:
                best[j] = (s, i, None)
    out, at = [], len(t)
    while at:
        _, i, k = best[at]
        out.append([k] if k is not None else [int(v.byte_ids[b]) for b in t[i:at]])
        at = i
    return [x for part in out[::-1] for x in part]


def test_trie_holds_the_vocabulary(vocabulary):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    assert pieces_of(vocabulary) == {p.piece.encode(): i for i, p in enumerate(proto.pieces) if p.type == 1}


def test_encoding_is_the_best_segmentation(vocabulary):
    own = pieces_of(vocabulary)
    rng = random.Random(3)
    texts = ["", "a", " ", "Hello world", "two  spaces and\nlines\n\n", "éàü ñandú 漢字 \U0001f600!", "x" * 300, "\t tab", "▁mark", "trailing "]
    texts += ["".join(rng.choice("abc den thr   \nüé") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    ids, offsets = P.Encoder(vocabulary).encode(raw)
    for i, t in enumerate(raw):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == brute(vocabulary, own, t), texts[i]
    data, ends = vocabulary.decode(ids, offsets)
    for i, t in enumerate(raw):
        assert data[ends[i] : ends[i + 1]].tobytes() == t.replace(P.MARK, b" ")


def test_no_segmentation_of_the_library_scores_higher(vocabulary):
    """The library segments by merges for this file; the search here must find a sum of scores at least as great."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    words = "hello world this is some plain text about rivers and the weather in November".split()
    ids, offsets = P.Encoder(vocabulary).encode([w.encode() for w in words])
    for i, w in enumerate(words):
        mine, theirs = ids[offsets[i] : offsets[i + 1]].tolist(), lib.encode(w)
        assert lib.decode(mine) == lib.decode(theirs) == w
        assert vocabulary.scores[mine].sum() >= vocabulary.scores[theirs].sum()


def test_operator(odd_docs, no_docs, corpus):
    got = P.encode(odd_docs).collect()
    assert len(got) == len(corpus) + 8
    text = {r[0]: r[1] for r in corpus}
    for r in got:
        assert r.round_trip == ("▁" not in (text.get(r.doc_id) or "")) and r.n_pieces == len(r.ids)
    back = {r.doc_id: r.text for r in P.decode(P.encode(odd_docs)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in text.items())
    more = P.with_pieces(odd_docs)
    assert set(odd_docs.columns) | {"n_pieces", "round_trip"} <= set(more.columns) and more.count() == len(got)
    assert P.encode(no_docs).count() == 0
