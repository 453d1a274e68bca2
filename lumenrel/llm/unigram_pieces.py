"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A vocabulary file gives pieces with log scores; one of merges gives ranks instead, which Zipf's law turns into log probabilities (nothing is trained). The pieces' bytes form a double-array trie: state s goes on byte b to
base[s] + b if check there is s. A text gets a dummy space in front, spaces become the marker U+2581, and the segmentation
with the greatest sum of scores wins; characters that no piece covers cost the least score less 10 and become byte
pieces. Ties go to the longest last piece, as from a left-to-right search that keeps the first best.

No piece has a marker after another character or holds a line break (checked when loading), so a best
segmentation never crosses those places; each distinct stretch between them is solved once per batch, all stretches of
like length together, one trie step for all at a time. Vocabularies are bounded, and sent with the tasks.

Defined cases: null and empty texts have no pieces and decode to an empty text; repeated rows are encoded each; texts of any length are
encoded whole; a literal U+2581 decodes to a space (round_trip is then false); an empty table gives an empty result; extra
columns are kept by `with_pieces`, ignored by `encode`.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenrel.llm import _common as c

MARK = "▁".encode()
UNKNOWN_COST = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2  # the kind of a vocabulary whose scores are ranks of merges
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONGEST_TOGETHER = 192
KNOWN_STRETCHES = 100_000


class DoubleArray:
    """A trie of byte strings in two arrays; value[s] is the number of the string that ends at state s, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = {}
        for key, number in keys:
            at = 0
            for b in key:
                nxt = children[at].get(b)
                if nxt is None:
                    nxt = len(children)
                    children.append({})
                    children[at][b] = nxt
                at = nxt
            ends[at] = number
        size = 2 * len(children) + 1024
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        low, queue = 1, [(0, 0)]
        for node, state in queue:  # grows while it is read
            kids = children[node]
            if node in ends:
                self.value[state] = ends[node]
            if not kids:
                continue
            while not free[low]:
                low += 1
            codes = sorted(kids)
            start = max(1, low - codes[0])
            while True:
                if start + 512 + 256 > len(free):
                    grow = len(free)
                    free = np.concatenate((free, np.ones(grow, bool)))
                    self.base, self.check, self.value = (np.concatenate((a, np.full(grow, f, np.int32))) for a, f in ((self.base, 0), (self.check, -1), (self.value, -1)))
                fits = np.ones(512, bool)
                for b in codes:
                    fits &= free[start + b : start + b + 512]
                if fits.any():
                    start += int(fits.argmax())
                    break
                start += 512
            self.base[state] = start
            for b in codes:
                free[start + b] = False
                self.check[start + b] = state
                queue.append((kids[b], start + b))
        used = int(np.flatnonzero(~free).max()) + 257
        self.base, self.check, self.value = (np.concatenate((a, np.full(257, f, np.int32)))[: used + 256] for a, f in ((self.base, 0), (self.check, -1), (self.value, -1)))


class Vocabulary:
    """Pieces, scores and kinds, with the trie of those that text can match."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int]) -> None:
        raw = [p.encode() for p in pieces]
        self.scores = np.array(scores, float)
        own = [i for i, k in enumerate(kinds) if k in (NORMAL, USER) and raw[i]]
        self.trie = DoubleArray([(raw[i], i) for i in own])
        self.least = min((scores[i] for i in own), default=0.0)
        self.unknown = self.least - UNKNOWN_COST
        self.byte_ids = np.full(256, -1, np.int32)
        for i, k in enumerate(kinds):
            if k == BYTE:
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.unk_id = next((i for i, k in enumerate(kinds) if k == UNKNOWN), -1)
        self.is_byte = np.array([k == BYTE for k in kinds])
        plain = [bytes([int(pieces[i][3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else raw[i].replace(MARK, b" ") for i, k in enumerate(kinds)]
        self.sizes = np.array([len(x) for x in plain], np.int64)
        self.firsts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.plain = np.frombuffer(b"".join(plain), np.uint8)
        safe = not any(MARK in raw[i].lstrip(MARK) or b"\n" in raw[i] or b" " in raw[i] for i in own)
        self.pattern = rb" *[^ \n]+|\n| +" if safe else rb"[\s\S]+"

    @staticmethod
    def load(path: str) -> Vocabulary:
        return _load(path)

    def solve(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all stretches (marked, non-empty), and len + 1 offsets into them."""
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        order = np.argsort(sizes, kind="stable")
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        i = 0
        while i < len(order):
            n = int(sizes[order[i]])
            if n > LONGEST_TOGETHER:
                ids = self._one(stretches[order[i]])
                parts.append((np.full(len(ids), order[i]), np.arange(len(ids)), ids))
                i += 1
                continue
            top = min(LONGEST_TOGETHER, n + max(2, n // 4))
            stop = min(int(np.searchsorted(sizes[order], top, side="right")), i + max(1, 2_000_000 // (top + 1)))
            parts.append(self._many(stretches, order[i:stop], sizes[order[i:stop]]))
            i = stop
        row, step, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = np.lexsort((step, row))
        return ids[at].astype(np.int32), np.searchsorted(row[at], np.arange(len(stretches) + 1))

    def _many(self, stretches: list[bytes], which: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, width = len(which), int(sizes.max())
        text = np.frombuffer(b"".join(stretches[k].ljust(width, b"\0") for k in which), np.uint8).reshape(n, width)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        for i in range(width):
            here = np.flatnonzero((sizes > i) & (best[:, i] > -np.inf))
            if not len(here):
                continue
            reach = char_sizes(text[here, i])
            reach = np.minimum(reach, sizes[here] - i)
            single = np.zeros(n, bool)
            single_at = np.zeros(n, np.int64)
            single_at[here] = i + reach
            rows, state, k = here, np.zeros(len(here), np.int32), i
            while len(rows) and k < width:
                to = base[state] + text[rows, k]
                ok = (check[to] == state) & (sizes[rows] > k)
                rows, state = rows[ok], to[ok]
                k += 1
                hit = value[state] >= 0
                r, v = rows[hit], value[state[hit]]
                single[r[single_at[r] == k]] = True
                score = best[r, i] + scores[v]
                better = score > best[r, k]
                r = r[better]
                best[r, k], start[r, k], piece[r, k] = score[better], i, v[better]
            lone = here[~single[here]]
            to = single_at[lone]
            score = best[lone, i] + self.unknown
            better = score > best[lone, to]
            lone, to = lone[better], to[better]
            best[lone, to], start[lone, to], piece[lone, to] = score[better], i, -1
        row, at = np.arange(n), sizes.copy()
        found = []
        while len(row):
            p, s = piece[row, at], start[row, at].astype(np.int64)
            found.append((row[p >= 0], s[p >= 0], p[p >= 0]))
            for j in range(4):  # the bytes of an unknown character
                u = (p < 0) & (s + j < at)
                found.append((row[u], s[u] + j, self._bytes(text[row[u], s[u] + j])))
            row, at = row[s > 0], s[s > 0]
        r, s, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        return which[r], s, ids

    def _bytes(self, values: np.ndarray) -> np.ndarray:
        ids = self.byte_ids[values]
        return np.where(ids < 0, self.unk_id, ids)

    def _one(self, text: bytes) -> np.ndarray:
        """Like _many, for one long stretch."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(text)
        best, start, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        sizes = char_sizes(np.frombuffer(text, np.uint8)).tolist()
        for i in range(n):
            if best[i] == -np.inf:
                continue
            one, single, state, k = min(n, i + sizes[i]), False, 0, i
            while k < n:
                to = int(base[state]) + text[k]
                if check[to] != state:
                    break
                state, k = to, k + 1
                v = int(value[state])
                if v >= 0:
                    single |= k == one
                    if (s := best[i] + scores[v]) > best[k]:
                        best[k], start[k], piece[k] = s, i, v
            if not single and (s := best[i] + self.unknown) > best[one]:
                best[one], start[one], piece[one] = s, i, -1
        out, at = [], n
        while at:
            s = start[at]
            out += [piece[at]] if piece[at] >= 0 else self._bytes(np.frombuffer(text[s:at], np.uint8)).tolist()[::-1]
            at = s
        return np.array(out[::-1], np.int32)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat bytes and offsets of the texts whose ids lie between the offsets."""
        ends = np.concatenate(([0], np.cumsum(self.sizes[ids])))
        at = np.arange(int(ends[-1])) + np.repeat(self.firsts[ids] - ends[:-1], self.sizes[ids])
        data, ends = self.plain[at], ends[offsets]
        dummy = np.flatnonzero(np.diff(ends) > 0)
        dummy = dummy[data[ends[dummy]] == 32]
        kept = np.ones(len(data), bool)
        kept[ends[dummy]] = False
        gone = np.zeros(len(ends), np.int64)
        gone[dummy + 1] = 1
        return data[kept], ends - np.cumsum(gone)


def char_sizes(lead: np.ndarray) -> np.ndarray:
    """Bytes of the UTF-8 character that starts with each byte (1 where none does)."""
    return 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)


def zipf(ranks: list[float]) -> list[float]:
    """Log probabilities of pieces by rank, the greatest score first: in proportion to 1 / place, summing to one."""
    order = np.argsort(-np.array(ranks, float), kind="stable")
    share = 1 / np.arange(1, len(order) + 1)
    out = np.empty(len(order))
    out[order] = np.log(share / share.sum())
    return out.tolist()


@functools.lru_cache(maxsize=4)
def _load(path: str) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kinds, scores = [p.type for p in proto.pieces], [p.score for p in proto.pieces]
    if proto.trainer_spec.model_type == MERGES:
        own = [i for i, k in enumerate(kinds) if k in (NORMAL, USER)]
        for i, x in zip(own, zipf([scores[i] for i in own]), strict=True):
            scores[i] = x
    return Vocabulary([p.piece for p in proto.pieces], scores, kinds)


class Encoder:
    """Encodes lists of texts; keeps the solutions of up to KNOWN_STRETCHES stretches."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.split = vocabulary, re.compile(vocabulary.pattern).findall
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and len + 1 offsets."""
        if len(self.number) > KNOWN_STRETCHES:
            self.forget()
        number = self.number
        known = len(number)
        at: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                parts = self.split(b" " + t)
                counts[i] = len(parts)
                at += [number.setdefault(x, len(number)) for x in parts]
        if len(number) > known:
            new = [x.replace(b" ", MARK) for x in list(number)[known:]]
            ids, offsets = self.v.solve(new)
            self.ids, self.offsets = np.concatenate((self.ids, ids)), np.concatenate((self.offsets, self.offsets[-1] + offsets[1:]))
        which = np.array(at, np.int64)
        sizes = self.offsets[which + 1] - self.offsets[which]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        place = np.arange(int(ends[-1])) + np.repeat(self.offsets[which] - ends[:-1], sizes)
        return self.ids[place], ends[np.concatenate(([0], np.cumsum(counts)))]


ADDED = "n_pieces long, n_byte_pieces long, ids array<int>, round_trip boolean"


def _added(texts: list[bytes], encoder: Encoder) -> list[pa.Array]:
    ids, offsets = encoder.encode(texts)
    v = encoder.v
    data, ends = v.decode(ids, offsets)
    same = pa.array([data[ends[i] : ends[i + 1]].tobytes() == t for i, t in enumerate(texts)], pa.bool_())
    n_bytes = np.diff(np.concatenate(([0], np.cumsum(v.is_byte[ids])))[offsets])
    return [pa.array(np.diff(offsets)), pa.array(n_bytes), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), same]


def with_pieces(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """docs with n_pieces, n_byte_pieces, ids, and round_trip (whether the ids decode to the text). Columns of docs with these names are replaced."""
    vocabulary = Vocabulary.load(model_path)
    names = [x.split()[0] for x in ADDED.split(", ")]
    own = docs.drop(*names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for b in c.chunks(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([*b.columns, *_added(c.texts(b.column("text")), encoder)], names=[*b.schema.names, *names])

    return c.bounded(own).mapInArrow(run, T.StructType([*own.schema.fields, *T._parse_datatype_string(ADDED).fields]))


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id with what with_pieces adds."""
    return with_pieces(docs.select("doc_id", "text"), model_path).drop("text")


def decode(encoded: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""
    vocabulary = Vocabulary.load(model_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = b.column("ids").fill_null([])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
                data, ends = vocabulary.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets)
                texts = [data[ends[i] : ends[i + 1]].tobytes().decode("utf-8", "replace") for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return c.bounded(encoded).select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
