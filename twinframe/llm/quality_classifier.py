"""A quality classifier on random-indexing word vectors.

Each word (hashed into ``buckets``) has a sparse random index vector; its context vector is the sum of the index vectors of its
neighbours over all documents, so vectors are built in one pass of additions with partial sums of fixed size. A document is the
frequency-damped mean of its words' vectors; a two-layer numpy network learns the labels from them, and a temperature fitted on
rows kept out of training calibrates its probabilities. A word counts twice: as folded letters and as a shape (case and marks).
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, stage_table

BUCKETS, DIMS, NONZERO, REACH = 8192, 24, 4, 2
#: Bytes of remembered words (with some 120 for the objects of each), and of the longest word that is remembered.
CACHE_BYTES, LONGEST = 96_000_000, 64
#: Documents whose words are held at once.
BATCH = 1000
#: Letters, digits and other bytes by class; what is left are marks.
_CLASS = bytes(88 if 65 <= c <= 90 else 120 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else 117 if c >= 128 else c for c in range(256))
_RUN = re.compile(rb"([Xx0u])\1+")
_known: dict[bytes, int] = {}
_held, _buckets = 0, BUCKETS


def word_buckets(word: bytes, buckets: int = BUCKETS) -> tuple[int, int]:
    """The buckets of a word's folded letters (lower half) and of its shape (upper half): runs of a class count as one."""
    half = buckets // 2
    shape = _RUN.sub(rb"\1", word.translate(_CLASS))
    return zlib.crc32(word.lower().strip(b".,;:!?#*$%&|<>\"'()")) % half, half + zlib.crc32(shape) % half


def index_vectors(buckets: int = BUCKETS, dims: int = DIMS, nonzero: int = NONZERO, seed: int = 7) -> np.ndarray:
    """Sparse random signs, the same everywhere."""
    rng = np.random.default_rng(seed)
    out = np.zeros((buckets, dims), np.float32)
    for i in range(nonzero):
        out[np.arange(buckets), rng.integers(0, dims, buckets)] += rng.choice((-1, 1), buckets)
    return out


def _bucket_lists(texts: list[bytes | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and shape buckets of all words of a batch, and each text's number of words."""
    global _held, _buckets
    if buckets != _buckets:
        _known.clear()
        _held, _buckets = 0, buckets
    words = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    codes, distinct = pd.factorize(np.fromiter(chain.from_iterable(words), object, int(sizes.sum())))
    packed = np.zeros(len(distinct), np.int64)
    for i, w in enumerate(distinct):
        known = _known.get(w)
        if known is None:
            letters, shape = word_buckets(w, buckets)
            known = letters * buckets + shape
            if len(w) <= LONGEST:
                _known[w] = known
                _held += len(w) + 120
        packed[i] = known
    if _held > CACHE_BYTES:  # frequent words are in this batch and stay, unless the batch alone is large
        _known.clear()
        recent = {w: k for w, k in zip(distinct, packed.tolist()) if len(w) <= LONGEST}
        _held = sum(map(len, recent)) + 120 * len(recent)
        if _held > CACHE_BYTES // 2:
            recent, _held = {}, 0
        _known.update(recent)
    flat = packed[codes]
    return flat // buckets, flat % buckets, sizes


def context_vectors(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(counts, context sums) of every bucket over all documents: buckets x (DIMS + 1) numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors(buckets)
        counts, sums = np.zeros(buckets, np.int64), np.zeros((buckets, DIMS), np.int64)
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for lo in range(0, len(texts), BATCH):
                letters, shapes, sizes = _bucket_lists(texts[lo : lo + BATCH], buckets)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                own = index[letters] + index[shapes]
                near = np.zeros_like(own)
                for k in range(1, REACH + 1):
                    same = (doc[k:] == doc[:-k])[:, None]
                    near[k:] += own[:-k] * same
                    near[:-k] += own[k:] * same
                for ids in (letters, shapes):
                    counts += np.bincount(ids, minlength=buckets)
                    order = np.argsort(ids, kind="stable")
                    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
                    if len(first):
                        sums[ids[order][first]] += np.rint(np.add.reduceat(near[order], first, axis=0)).astype(np.int64)
        used = np.flatnonzero(counts)
        if len(used):
            values = np.concatenate((counts[used, None], sums[used]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), DIMS + 1).cast(pa.list_(pa.int64()))], names=["bucket", "v"])

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, v array<long>")
    added = parts.groupBy("bucket").agg(*[F.sum(F.element_at("v", i + 1)).alias(f"v{i}") for i in range(DIMS + 1)])
    out = np.zeros((buckets, DIMS + 1))
    for r in stage_table(added, "context-vectors").toLocalIterator():  # `buckets` rows at most
        out[r[0]] = r[1:]
    return out[:, 0], out[:, 1:]


def word_vectors(counts: np.ndarray, sums: np.ndarray, damping: float = 1e-3) -> np.ndarray:
    """Unit context vectors around their mean, joined by the bucket's own index vector, weighted down by frequency."""
    own = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    share = counts / max(counts.sum(), 1)
    own = own - (share[:, None] * own).sum(axis=0)
    shape = np.arange(len(sums)) >= len(sums) // 2
    weight = np.where(shape, 1.0, damping / (damping + share))
    own = own * weight[:, None]
    direct = index_vectors(len(sums)) / np.sqrt(NONZERO)
    return np.concatenate((own, direct * weight[:, None]), axis=1).astype(np.float32)


def with_vectors(docs: DataFrame, vectors: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, vector array<float>): the mean vectors of letters and of shapes, the share of words that repeat the one before, and the
    scaled logarithm of the number of words."""
    width, buckets = 2 * vectors.shape[1] + 2, len(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo in range(0, len(texts), BATCH):
                letters, shapes, sizes = _bucket_lists(texts[lo : lo + BATCH], buckets)
                out = np.zeros((len(sizes), width), np.float32)
                full = np.flatnonzero(sizes)
                if len(full):
                    first = (np.cumsum(sizes) - sizes)[full]
                    for i, ids in enumerate((letters, shapes)):
                        out[full, i * vectors.shape[1] : (i + 1) * vectors.shape[1]] = np.add.reduceat(vectors[ids], first, axis=0) / sizes[full, None]
                    doc = np.repeat(np.arange(len(sizes)), sizes)
                    again = (letters[1:] == letters[:-1]) & (shapes[1:] == shapes[:-1]) & (doc[1:] == doc[:-1])
                    out[full, -2] = np.bincount(doc[1:][again], minlength=len(sizes))[full] / sizes[full]
                out[:, -1] = np.log1p(sizes) / 10
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sizes)), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), width).cast(pa.list_(pa.float32()))], names=["id", "vector"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, vector array<float>")


class Network:
    """Inputs, a tanh layer, a logistic output; full-batch Adam in numpy; a temperature from kept-out rows."""

    def __init__(self, hidden: int = 24, epochs: int = 250, rate: float = 0.02, decay: float = 1e-4, seed: int = 11):
        self.hidden, self.epochs, self.rate, self.decay, self.seed, self.temperature = hidden, epochs, rate, decay, seed, 1.0

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Every fifth row calibrates, the others train. Without both classes the score is the share of label 1 (0.5 without rows)."""
        x = x.astype(np.float64)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (0.0, 1.0)
        rng, width = np.random.default_rng(self.seed), x.shape[1]
        self.weights = [rng.normal(0, width**-0.5, (width, self.hidden)), np.zeros(self.hidden), np.zeros(self.hidden), np.zeros(1)]
        if not len(y) or y.min() == y.max():
            self.weights[3][0] = 0.0 if not len(y) else np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
            return self
        self.weights[2] = rng.normal(0, self.hidden**-0.5, self.hidden)
        rest = np.arange(len(y)) % 5 == 0
        a, b = ((x - self.mean) / self.scale)[~rest], y[~rest].astype(np.float64)
        m, v = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        for step in range(1, self.epochs + 1):
            w1, b1, w2, b2 = self.weights
            h = np.tanh(a @ w1 + b1)
            g = (1 / (1 + np.exp(-(h @ w2 + b2))) - b) / len(b)
            gh = np.outer(g, w2) * (1 - h * h)
            for i, grad in enumerate((a.T @ gh + self.decay * w1, gh.sum(axis=0), h.T @ g + self.decay * w2, np.array([g.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                self.weights[i] = self.weights[i] - self.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        logits, truth = self._logits(x[rest]), y[rest]
        options = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, np.where(truth == 1, -logits, logits) / t)) for t in options]
        self.temperature = float(options[int(np.argmin(loss))])
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits(x.astype(np.float64)) / self.temperature, -60, 60)))


def held_out(id_col: str):
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 20_000, threshold: float = 0.7, buckets: int = BUCKETS) -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``docs``.

    Words share ``buckets`` vectors by hash, half for letters and half for shapes. The network learns from at most ``train_rows`` labelled ids that are not held out: all of them, or where there are more those whose
    hash lies under a cutoff that lets some 95 % of ``train_rows`` through. Word vectors and scores cover all documents. Null and empty texts
    are scored from a zero vector. Without labels every score is 0.5; of labels that repeat an id the least counts, and of documents that
    repeat a labelled id one trains. An empty table gives none. Other columns of ``docs`` are not read, so clashing names do no harm.
    """
    vectors = stage_table(with_vectors(docs, word_vectors(*context_vectors(docs, text_col, buckets)), id_col, text_col), "quality-vectors")
    known = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min("quality").cast("int").alias("y"))
    known = stage_table(known.filter(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out("id")), "quality-labels")
    n = known.count()
    if n > train_rows:
        known = known.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 31)) < int((1 << 31) * 0.95 * train_rows / n))
    # At most train_rows ids are broadcast, so no vector is shuffled but those that train.
    rows = vectors.join(F.broadcast(known), "id").groupBy("id").agg(F.min("vector").alias("vector"), F.min("y").alias("y"))

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"id": [], "vector": [], "y": []}), *frames])
        rows = rows.iloc[np.argsort([zlib.crc32(b"%d" % i) for i in rows["id"]], kind="stable")] if len(rows) else rows
        x = np.array(rows["vector"].tolist(), np.float32) if len(rows) else np.zeros((0, 4 * DIMS + 2), np.float32)
        yield pd.DataFrame({"network": [pickle.dumps(Network().fit(x, rows["y"].to_numpy(int)).__dict__)]})

    network = Network()  # trained in one task on the bounded sample; its weights are some kilobytes
    made = rows.coalesce(1).sortWithinPartitions("id").mapInPandas(train, "network binary").first()
    network.__dict__ = pickle.loads(made[0]) if made else network.fit(np.zeros((0, 4 * DIMS + 2)), np.zeros(0)).__dict__  # noqa: S301

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.scores(x))], names=["id", "score"])

    scored = vectors.mapInArrow(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
