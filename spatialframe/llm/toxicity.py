"""Toxicity: non-negative positive-unlabelled learning in numpy.

Confirmed toxic documents are the positives; all other text is unlabelled, toxic texts among it. A linear model over the presence
of words and word beginnings is trained on the risk estimator ``pi R_p(+1) + max(0, R_u(-1) - pi R_p(-1))`` with the class prior
``pi``; where the second term falls below zero, its gradient is reversed, so the model cannot profit from fitting noise.

Null and empty texts have no feature and get the score of the bias. Equal texts get equal scores. Texts are read in whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import draw_labelled, map_arrow, seeded

#: Everything but ASCII letters and UTF-8 continuation or lead bytes separates words.
SEPARATE = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
BEGINNINGS = (4, 5, 6)


def features(text: str | None) -> set[bytes]:
    """Words of the lower-case text (marked ``=``), their first four, five and six bytes, and the beginnings that two (marked ``2``)
    or three (``3``) different words share."""
    if not text:
        return set()
    words = set(text.lower().encode("utf-8", "replace").translate(SEPARATE).split())
    out = {b"=" + w for w in words}
    for n in BEGINNINGS:
        begun = Counter([w[:n] for w in words if len(w) >= n])
        out |= begun.keys()
        out |= {b"2" + k for k, c in begun.items() if c > 1}
        out |= {b"3" + k for k, c in begun.items() if c > 2}
    return out


def _presence(df: DataFrame) -> DataFrame:
    """(feature, positive) of every training text, each feature once."""
    def run(b):
        for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            f = sorted(features(t))
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), pa.array(np.full(len(f), y), pa.int32())], ["f", "y"])
    return map_arrow(df, run, "f binary, y int")


def _coded(df: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    def run(b):
        ys = b.column(1)
        xs = [sorted(vocabulary[f] for f in features(t) & vocabulary.keys()) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), ys, pa.array(xs, pa.list_(pa.int32()))], ["id", "y", "x"])
    return map_arrow(df, run, "id long, y int, x array<int>")


def nnpu(x: list[list[int]], positive: np.ndarray, width: int, prior: float, rounds: int = 2000, rate: float = 0.05, decay: float = 5e-5) -> tuple[np.ndarray, float]:
    """Weights and bias from full-batch Adam on the non-negative risk with the logistic loss."""
    lengths = np.array([len(r) for r in x])
    cols = np.concatenate([np.array(r, np.int64) for r in x]) if lengths.sum() else np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(x)), lengths)
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    w, b = np.zeros(width), np.log(prior / (1 - prior))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        z = b + np.bincount(rows, w[cols], len(x))
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss_neg = np.logaddexp(0, z)                                  # loss of calling it clean
        r_u, r_p = loss_neg[~positive].sum() / n_u, loss_neg[positive].sum() / n_p
        d_pos = np.where(positive, (s - 1) * prior / n_p, 0.0)         # gradient of pi R_p(+1)
        d_neg = np.where(positive, -s * prior / n_p, s / n_u)          # gradient of R_u(-1) - pi R_p(-1)
        d = d_pos + d_neg if r_u - prior * r_p >= 0 else -d_neg
        g = np.concatenate([np.bincount(cols, d[rows], width) + decay * w, [d.sum()]])
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
        w -= move[:-1]
        b -= move[-1]
    return w, float(b)


class Model:
    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(features(text) & self.weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, where=None, label: str = "toxic", n_positive: int = 2000, n_unlabelled: int = 6000,
                 n_features: int = 4096, min_docs: int = 4, seed: str = "toxicity") -> Model:
    """Learn from at most ``n_positive`` confirmed toxic documents and about ``n_unlabelled`` of all documents that ``where``
    keeps (seeded draws: the documented bounds of the fit). Features are those of at least ``min_docs`` positives that are over
    three times as frequent among positives as among unlabelled text, the most telling ``n_features`` of them. The class prior is
    the share of toxic rows among the labels that ``where`` keeps."""
    keep = F.lit(True) if where is None else where
    known = labels.where(keep & F.col(label).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p")).first()
    prior = min(0.5, max(1e-3, (known["p"] or 0) / known["n"])) if known["n"] else 1e-3
    ids = draw_labelled(labels, "doc_id", label, keep & (F.col(label) == 1), n_positive, seed)
    base = docs.where(keep).select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__t"))
    total = base.select("__id").count()
    if not total:
        return Model({}, float(np.log(prior / (1 - prior))))
    draw = (seeded(seed, "u", F.col("__id")).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    positives = base.join(F.broadcast(ids.select(F.col("__id").cast("long"))), "__id").withColumn("__y", F.lit(1))
    unlabelled = base.where(draw < min(1.0, n_unlabelled / total)).withColumn("__y", F.lit(0))
    sample = positives.unionByName(unlabelled).persist()
    sizes = {r["__y"]: r["n"] for r in sample.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        sample.unpersist()
        return Model({}, float(np.log(prior / (1 - prior))))
    p, u = F.sum("y"), F.sum(1 - F.col("y"))
    counts = (_presence(sample.select("__y", "__t")).groupBy("f").agg(p.alias("p"), u.alias("u"))
              .where((F.col("p") >= min_docs) & (F.col("p") / n_p > 3 * F.col("u") / n_u)))
    vocabulary = {bytes(r["f"]): i for i, r in enumerate(counts.orderBy(F.desc(F.col("p") / n_p - F.col("u") / n_u), "f").limit(n_features).collect())}
    coded = _coded(sample.select("__id", "__y", "__t"), vocabulary).collect()
    sample.unpersist()
    coded = sorted(coded, key=lambda r: (r["y"], r["id"] if r["id"] is not None else -1, r["x"]))
    w, b = nnpu([r["x"] for r in coded], np.array([r["y"] == 1 for r in coded]), len(vocabulary), prior)
    return Model({f: float(w[i]) for f, i in vocabulary.items()}, b)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row (doc_id, score) per document, in a map over whole texts without a shuffle."""
    def run(b):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")
