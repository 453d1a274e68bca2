"""Quality classifier: a generalised additive model with pairwise interactions.

Features are cut into at most `bins` quantile bins. Cyclic boosting visits one feature after another and
adds a shallow tree (up to `leaves` leaves over that feature's bins, fitted to logistic gradients with
a small rate) to its lookup table; then the pairs whose residual grid gains most get two-way tables the same way.
A score is the sigmoid of the intercept plus one table entry a feature and a pair, so scoring
is a few vectorised additions.

The model is fitted on a bounded sample of labelled rows: at most about `most_rows` of them, kept by a hash of the
id with the same probability for every row. Scoring covers every row.

Defined cases: a null or empty text has all features zero and a score like any other; labels other than 0 and 1
and null labels are ignored; with several labels for an id each counts; without labels of both
classes every score is the share of label 1 (0.5 without any); repeated rows are scored each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrel.llm import _common as c
from lumenrel.llm._features import NAMES, features


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total, at = np.full(len(x), self.intercept), self.bins(x)
        for j, t in enumerate(self.tables):
            total += t[at[j]]
        for (a, b), g in zip(self.pairs, self.grids, strict=True):
            total += g[at[a], at[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf values by bin of the best greedy tree over ordered bins."""
    g, h = (np.concatenate(([0.0], np.cumsum(x))) for x in (grad, hess))
    cuts = [0, len(grad)]

    def worth(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)

    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), int(k[i]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def train(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 150, rate: float = 0.15, leaves: int = 3, n_pairs: int = 6, pair_bins: int = 8, ridge: float = 2.0) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return Model(float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    m = Model(float(np.log(share / (1 - share))))
    m.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    at = m.bins(x)
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    total = np.full(len(y), m.intercept)
    for _ in range(rounds):
        for j, t in enumerate(m.tables):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(at[j], y - p, len(t)), np.bincount(at[j], p * (1 - p), len(t)), leaves, ridge)
            t += step
            total += step[at[j]]
    coarse = [np.minimum(a * pair_bins // len(t), pair_bins - 1) for a, t in zip(at, m.tables, strict=True)]
    maps = [np.minimum(np.arange(len(t)) * pair_bins // len(t), pair_bins - 1) for t in m.tables]

    def sums(a, b, v):
        return np.bincount(coarse[a] * pair_bins + coarse[b], v, pair_bins * pair_bins)

    p = 1 / (1 + np.exp(-total))
    gain = {(a, b): float((sums(a, b, y - p) ** 2 / (sums(a, b, p * (1 - p)) + ridge)).sum()) for a in range(len(at)) for b in range(a + 1, len(at))}
    m.pairs = sorted(gain, key=lambda k: (-gain[k], k))[:n_pairs]
    small = [np.zeros(pair_bins * pair_bins) for _ in m.pairs]
    for _ in range(rounds // 3):
        for (a, b), s in zip(m.pairs, small, strict=True):
            p = 1 / (1 + np.exp(-total))
            step = rate * sums(a, b, y - p) / (sums(a, b, p * (1 - p)) + ridge)
            s += step
            total += step[coarse[a] * pair_bins + coarse[b]]
    m.grids = [s.reshape(pair_bins, pair_bins)[np.ix_(maps[a], maps[b])] for (a, b), s in zip(m.pairs, small, strict=True)]
    return m


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the feature vector x of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in c.gathered(batches):
            x = features(*c.flat(c.as_bytes(c.column(t, "text"))))
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([c.column(t, "doc_id"), values], names=["doc_id", "x"])

    return c.bounded(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def fit(rows: DataFrame, labels: DataFrame, most_rows: int = 20_000, **options) -> Model:
    """A model from described rows and labels (doc_id, y); at most about most_rows labelled rows are used."""
    labelled = rows.join(labels.where("y in (0, 1)").select("doc_id", "y"), "doc_id")
    n = labels.where("y in (0, 1)").count()
    if n > most_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < F.lit(int(1_000_000 * most_rows / n)))
    found = labelled.select("doc_id", "x", "y").toArrow().to_pydict()
    order = np.argsort(np.array(found["doc_id"], dtype=object), kind="stable") if found["doc_id"] else []
    x = np.array([found["x"][i] for i in order], float).reshape(-1, len(NAMES))
    order = np.lexsort((*x.T, [found["y"][i] for i in order])) if len(x) else order  # the same fit whatever order rows come in
    y = np.array([found["y"][i] for i in np.argsort(np.array(found["doc_id"], dtype=object), kind="stable")] if len(x) else [], float)
    return train(x[order] if len(x) else x, y[order] if len(x) else y, **options)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each described row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs; `held_out` is a condition on doc_id whose rows aren't learnt from, nor are those without an id, which are held out."""
    rows = c.cut(described(docs), "features")
    model = fit(rows, labels.where(~held_out), **options)
    return score(rows, model).select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
