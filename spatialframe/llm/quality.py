"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes. Byte pairs (stride two) meet learned filters of eight bytes; the filter responses are pooled by
maximum over chunks of 256 bytes that overlap by six, so every filter position of the whole text lies in one chunk. The mean and
the maximum over all chunks of a document enter one logistic unit.

Null, empty and repeated texts: a text without bytes (or null) gets the share of label 1 in the training sample. Equal texts get
equal scores, whatever their id. Documents of any length are read in whole, block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .words import draw_labelled, map_arrow, map_texts, slices, small_batches

WIDTH, PAIRS = 8, 4            # bytes and byte pairs under a filter
POSITIONS = 125                # filter positions of a chunk of 256 bytes
CHUNK = 2 * (POSITIONS + PAIRS - 1)
FILTERS, DEPTH = 16, 8
TILE = 32                      # chunks convolved at once


def pairs_of(data: bytes) -> np.ndarray:
    """Byte pairs, padded with zeros to an even length of at least one filter."""
    n = max(WIDTH, len(data) + (len(data) & 1))
    return np.frombuffer(data.ljust(n, b"\0"), "<u2")


def pair_tables(emb: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Response of each filter to each byte pair at each of its four places: the convolution becomes four lookups."""
    out = np.empty((PAIRS, 65536, filters.shape[2]), np.float32)
    for j in range(PAIRS):
        lo, hi = emb @ filters[2 * j], emb @ filters[2 * j + 1]
        out[j] = (hi[:, None, :] + lo[None, :, :]).reshape(65536, -1)
    return out


def chunk_maxima(pairs: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Maximum of every filter over each chunk of one text, in tiles that stay in the processor's cache."""
    n = len(pairs) - PAIRS + 1
    tile = TILE * POSITIONS
    out = np.empty((-(-n // POSITIONS), tables.shape[2]), np.float32)
    act, one = np.empty((2, min(tile, n), tables.shape[2]), np.float32)
    for at in range(0, n, tile):
        m = min(tile, n - at)
        np.take(tables[0], pairs[at:at + m], axis=0, out=act[:m], mode="clip")
        for j in range(1, PAIRS):
            np.take(tables[j], pairs[at + j:at + j + m], axis=0, out=one[:m], mode="clip")
            act[:m] += one[:m]
        whole, c = m // POSITIONS, at // POSITIONS
        if whole:
            act[:whole * POSITIONS].reshape(whole, POSITIONS, -1).max(axis=1, out=out[c:c + whole])
        if m % POSITIONS:
            act[whole * POSITIONS:m].max(axis=0, out=out[c + whole])
    return out


class Network:
    """Weights of the network; ``fit`` learns them by Adam from chunks, ``score`` runs it over whole texts."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.emb = r.normal(0, 1, (256, DEPTH)).astype(np.float32) * 0.5
        self.filters = r.normal(0, 1, (WIDTH, DEPTH, FILTERS)).astype(np.float32) * 0.2
        self.shift = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.prior = 0.5

    def fit(self, docs: list[list[bytes]], y: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 11) -> "Network":
        """``docs``: chunks of each training document."""
        if len(docs) == 0:
            return self
        self.prior = float(y.mean())
        if self.prior in (0.0, 1.0):
            return self
        self.bias[0] = np.log(self.prior / (1 - self.prior))
        params = {"emb": self.emb, "filters": self.filters, "shift": self.shift, "out": self.out, "bias": self.bias}
        m, v, step = {k: np.zeros_like(p) for k, p in params.items()}, {k: np.zeros_like(p) for k, p in params.items()}, 0
        r = np.random.default_rng(seed)
        coded = [[pairs_of(c) for c in d] for d in docs]
        for epoch in range(epochs):
            order = r.permutation(len(docs))
            for at in range(0, len(order), batch):
                grads = self._gradients([coded[i] for i in order[at:at + batch]], y[order[at:at + batch]])
                step += 1
                lr = rate * (1 - epoch / epochs * 0.8)
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    params[k] -= (lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, docs: list[list[np.ndarray]], y: np.ndarray) -> dict[str, np.ndarray]:
        chunks = [c for d in docs for c in d]
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        places = np.array([len(c) - PAIRS + 1 for c in chunks])
        raw = np.zeros((len(chunks), 2 * (places.max() + PAIRS - 1)), np.uint8)
        for i, c in enumerate(chunks):
            raw[i, :2 * len(c)] = c.view(np.uint8)
        windows = np.lib.stride_tricks.sliding_window_view(raw, WIDTH, axis=1)[:, ::2]            # chunk, place, byte
        act = (self.emb[windows].reshape(-1, WIDTH * DEPTH) @ self.filters.reshape(WIDTH * DEPTH, FILTERS)).reshape(*windows.shape[:2], FILTERS)
        act[np.arange(act.shape[1])[None, :] >= places[:, None]] = -np.inf
        top = act.argmax(axis=1)
        best = np.take_along_axis(act, top[:, None, :], axis=1)[:, 0]
        where = windows[np.arange(len(chunks))[:, None], top]                                     # chunk, filter, byte
        z = best + self.shift
        pooled = np.maximum(z, 0)
        counts = np.bincount(owner, minlength=len(docs)).astype(np.float32)
        starts = np.concatenate([[0], np.cumsum(counts[:-1])]).astype(int)
        mean = np.add.reduceat(pooled, starts, axis=0) / counts[:, None]
        high = np.maximum.reduceat(pooled, starts, axis=0)
        x = np.concatenate([mean, high], axis=1)
        p = 1 / (1 + np.exp(-(x @ self.out + self.bias[0])))
        d = ((p - y) / len(y)).astype(np.float32)
        dx = d[:, None] * self.out[None, :]
        first = np.zeros_like(pooled, bool)          # the maximum over chunks passes its gradient to one of them
        for i in range(len(docs)):
            s = slice(starts[i], starts[i] + int(counts[i]))
            first[s.start + pooled[s].argmax(axis=0), np.arange(FILTERS)] = True
        dpool = dx[owner, :FILTERS] / counts[owner, None] + dx[owner, FILTERS:] * first
        dz = dpool * (z > 0)
        g_emb, g_fil = np.zeros_like(self.emb), np.zeros_like(self.filters)
        for j in range(WIDTH):
            byte = where[:, :, j]
            e = self.emb[byte]
            g_fil[j] = np.einsum("cf,cfd->df", dz, e)
            np.add.at(g_emb, byte.ravel(), (dz[:, :, None] * self.filters[j].T[None]).reshape(-1, DEPTH))
        return {"emb": g_emb + 1e-4 * self.emb, "filters": g_fil + 1e-4 * self.filters, "shift": dz.sum(axis=0),
                "out": x.T @ d + 1e-4 * self.out, "bias": np.array([d.sum()], np.float32)}

    def score(self, texts: list[str | None], tables: np.ndarray) -> np.ndarray:
        """One probability per text, each read in whole."""
        x = np.zeros((len(texts), 2 * FILTERS))
        has = np.zeros(len(texts), bool)
        for i, t in enumerate(texts):
            data = t.encode("utf-8", "replace") if t else b""
            if data:
                top = np.maximum(chunk_maxima(pairs_of(data), tables) + self.shift, 0)
                x[i, :FILTERS], x[i, FILTERS:], has[i] = top.mean(axis=0, dtype=np.float64), top.max(axis=0), True
        p = 1 / (1 + np.exp(-((x * self.out.astype(np.float64)).sum(axis=1) + float(self.bias[0]))))      # the same for a text wherever it stands
        return np.where(has, p, self.prior)


def _training_chunks(df: DataFrame, per_doc: int) -> DataFrame:
    """Up to ``per_doc`` seeded chunks of each training text, so that the sample is bounded in bytes as well."""
    def run(b):
        ids, ys, out = [], [], []
        for i, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            data = (t or "").encode("utf-8", "replace")
            starts = np.arange(0, max(1, len(data)), 2 * POSITIONS)
            if len(starts) > per_doc:
                starts = np.sort(np.random.default_rng(i & 0x7FFFFFFF).permutation(starts)[:per_doc])
            ids.append(i)
            ys.append(y)
            out.append([data[s:s + CHUNK] for s in starts])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(out, pa.list_(pa.binary()))], ["id", "y", "chunks"])
    return map_arrow(df, run, "id long, y int, chunks array<binary>")


def fit_quality(docs: DataFrame, labels: DataFrame, where=None, label: str = "quality", n_train: int = 3000, per_doc: int = 6, seed: str = "quality") -> Network:
    """Learn from at most ``n_train`` labelled documents (seeded draw among the rows that ``where`` keeps) and at most
    ``per_doc`` chunks of each: the documented bounds of the fit. With no label, every score is 0.5."""
    ids = draw_labelled(labels, "doc_id", label, F.lit(True) if where is None else where, n_train, seed)
    text = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__t")).join(F.broadcast(ids.withColumn("__id", F.col("__id").cast("long"))), "__id")
    rows = _training_chunks(text.select("__id", F.col("__y").cast("int"), "__t"), per_doc).collect()
    rows = sorted((r for r in rows if r["chunks"] and r["chunks"][0]), key=lambda r: (r["id"], r["chunks"]))
    return Network().fit([[bytes(c) for c in r["chunks"]] for r in rows], np.array([r["y"] for r in rows], np.float32))


def score_quality(docs: DataFrame, net: Network, score: str = "score") -> DataFrame:
    """``docs`` (any columns) to one row (doc_id, score) per document, in a map over whole texts without a shuffle."""
    class Scorer:
        tables = None

        def __call__(self, b):
            if self.tables is None:
                self.tables = pair_tables(net.emb, net.filters)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.score(b.column(1).to_pylist(), self.tables), pa.float64())], ["doc_id", score])
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), Scorer(), f"doc_id long, {score} double")


def filter_quality(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """The documents that the network does not reject, with their columns unchanged. The text is scored where it is read."""
    names, kind = docs.columns, docs.schema
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    at = names.index("text")

    class Scorer:
        tables = None

        def __call__(self, batches):
            if self.tables is None:
                self.tables = pair_tables(net.emb, net.filters)
            for b in batches:
                for part in slices(b, b.column(0).field(at)):
                    row = part.column(0)
                    keep = pa.array(net.score(row.field(at).to_pylist(), self.tables) >= threshold)
                    if pc.any(keep).as_py():
                        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in row.flatten()], names)
            pa.default_memory_pool().release_unused()
    return small_batches(rows).mapInArrow(Scorer().__call__, kind)
