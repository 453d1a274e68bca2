"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, ASCII characters but letters become spaces (those beyond ASCII stay as they are), and n-grams of `ORDERS` characters are hashed into
`BUCKETS` columns an order. A column's value is its share of the text's n-grams times its inverse document frequency. Document
frequencies are counted over all training documents. Weights are learnt on the driver with follow-the-regularised-leader
(per-coordinate steps, elastic net) from a bounded sample: about `most_rows` training documents, kept by
a hash of the id, evenly by language. A fifth of the sample sets the softmax temperature. Since values are linear in occurrences,
a text's logits are the mean of one table row per n-gram.

Defined cases: null texts and texts without a letter are `und` with score 0; so is everything if nothing can be learnt; null
languages aren't learnt from; repeated rows are predicted each; ties between languages go to the first by code
point; an empty table gives an empty result; extra columns are ignored. Whole texts are read at any length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrel.llm import _common as c

ORDERS = (2, 3)
BUCKETS = 1 << 15
SCALE = 100.0
UNKNOWN = "und"
_PARTS = tuple(np.uint32(x) for x in (2654435769, 2246822519, 3266489917, 668265263))
_KEEP = np.zeros(128, np.uint32)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[_KEEP == 0] = 32
TEXT_BYTES = 1 << 20


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each n-gram, the offsets of the texts in them, and which texts have a letter."""
    low = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    code = np.frombuffer("".join(t + " " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    plain = code < 128
    code[plain] = _KEEP[code[plain]]
    owner = np.repeat(np.arange(len(low)), sizes + 1)
    lettered = np.bincount(owner[plain & (code != 32)], minlength=len(low)) > 0
    for i in np.flatnonzero(~lettered):
        lettered[i] = any(ch.isalpha() for ch in low[i])
    found, owners = [], []
    for k, n in enumerate(ORDERS):
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = code[:m] * _PARTS[0]
        full = code[:m] != 32
        for j in range(1, n):
            h = h * _PARTS[3] + code[j : m + j] * _PARTS[j % 3]
            full |= code[j : m + j] != 32
        h ^= h >> np.uint32(15)
        full &= owner[:m] == owner[n - 1 : m + n - 1]
        found.append(((h * _PARTS[1]) >> np.uint32(17)).astype(np.int32)[full] + np.int32(k * BUCKETS))
        owners.append(owner[:m][full])
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(low) + 1, np.int64), lettered
    bucket, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(low) + 1)), lettered


def _texts(values: pa.Array) -> list[str]:
    return [b.decode("utf-8", "replace") for b in c.texts(values)]


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """The number of docs with each bucket, and their number, last."""
    width = len(ORDERS) * BUCKETS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, np.int64), 0
        seen = np.zeros(width, bool)
        for b in c.chunks(batches, limit=TEXT_BYTES):
            bucket, offsets, _ = grams(_texts(b.column("text")))
            n += b.num_rows
            for i in range(b.num_rows):
                own = bucket[offsets[i] : offsets[i + 1]]
                if len(own) > width // 8:
                    seen[own] = True
                    total += seen
                    seen[own] = False
                else:
                    total[np.unique(own)] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, width), pa.int32()), pa.array(np.append(total[used], n))], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width + 1)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # by bucket and language: scale * idf * weight
    bias: np.ndarray
    temperature: float


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], width: int, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights (width + 1 by classes, the last row is the bias) of a multinomial logistic regression."""
    z, n = np.zeros((width + 1, classes)), np.zeros((width + 1, classes))

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, value, y in rows:
            at, value = np.append(at, width), np.append(value, 1.0)
            w = weights(at)
            logits = value @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = value[:, None] * p
            n_new = n[at] + g * g
            z[at] += g - (np.sqrt(n_new) - np.sqrt(n[at])) / alpha * w
            n[at] = n_new
    return weights(np.arange(width + 1))


def fit(docs: DataFrame, most_rows: int = 2400, epochs: int = 3, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> Model:
    """A model of the languages of docs (doc_id, text, lang)."""
    docs = c.bounded(docs).where("lang is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(counts)
    width = len(ORDERS) * BUCKETS
    if not names:
        return Model([], np.zeros((width, 1), np.float32), np.zeros(1), 1.0)
    df = document_frequencies(docs)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    share = F.create_map(*(F.lit(x) for l in names for x in (l, min(1_000_000, int(1_000_000 * most_rows / len(names) / counts[l]) + 1))))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < share[F.col("lang")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.chunks(batches, limit=TEXT_BYTES):
            bucket, offsets, lettered = grams(_texts(b.column("text")))
            at, tf = [], []
            for i in range(b.num_rows):
                u, n = np.unique(bucket[offsets[i] : offsets[i + 1]], return_counts=True)
                at.append(u)
                tf.append((n / max(1, n.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.float32()))], names=["doc_id", "lang", "at", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    t = sample.mapInArrow(run, f"doc_id {kind}, lang string, at array<int>, tf array<float>").toArrow()
    number = {l: i for i, l in enumerate(names)}
    ids, langs = t["doc_id"].to_pylist(), t["lang"].to_pylist()
    at_all, tf_all = c.column(t, "at"), c.column(t, "tf")
    rows = []
    for i in sorted(range(len(ids)), key=lambda i: c.mix64(np.array([ids[i] or 0], np.int64).view(np.uint64))[0]):
        at = at_all[i].values.to_numpy()
        if len(at):
            rows.append((at, SCALE * idf[at] * tf_all[i].values.to_numpy(), number[langs[i]]))
    held = rows[::5] if len(rows) >= 50 else rows
    learnt = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 50 else rows
    w = ftrl(learnt, width, len(names), epochs, alpha, beta, l1, l2)

    def loss(temperature: float) -> float:
        total = 0.0
        for z, y in zip(logits, (r[2] for r in held), strict=True):
            s = z / temperature
            total += np.log(np.exp(s - s.max()).sum()) + s.max() - s[y]
        return total

    logits = [r[1] @ w[r[0]] + w[-1] for r in held]
    temperature = float(min(np.geomspace(0.1, 10, 81), key=loss)) if held else 1.0
    return Model(names, (SCALE * idf[:, None] * w[:-1]).astype(np.float32), w[-1], temperature)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.chunks(batches, limit=TEXT_BYTES):
            bucket, offsets, lettered = grams(_texts(b.column("text")))
            n = np.diff(offsets)
            logits = np.tile(model.bias, (b.num_rows, 1))
            some = n > 0
            if some.any():
                logits[some] += np.add.reduceat(model.table[bucket], offsets[:-1][some], axis=0) / n[some, None]
            logits /= model.temperature
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            known = lettered & bool(model.languages)
            best = p.argmax(axis=1)
            name = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(name, pa.string()), pa.array(np.where(known, p.max(axis=1), 0.0))], names=["doc_id", "lang_pred", "score"])

    return c.bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, held_out: Column, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score; rows that meet `held_out` (a condition on doc_id) aren't learnt from, nor are those without an id, which are held out."""
    model = fit(docs.where(~held_out), **options)
    return predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "lang_pred", "score")
