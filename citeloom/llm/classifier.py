"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words (runs of letters and digits, or of marks, as written) fall into a fixed number of hash
buckets. Each bucket has a sparse ternary index vector; a word's vector is the sum, over all its
occurrences in all documents, of the index vectors of itself and its neighbours. Its size is
fixed, so what is broadcast does not grow with the data. A document is the weighted mean and
spread of its words' vectors (frequent words weigh less). The network is fitted on a bounded
sample of labelled rows (the parameter sample; the rows with the least hash of doc_id), a fifth
of it held out, on which the temperature of the probabilities is calibrated.

Defined results: a null, empty or blank text has a null probability and is kept. Labels that are
null count for nothing; a doc_id labelled or present more than once counts as one document with
the mean of its labels (good from one half on) and any one of its texts. Without labelled
documents of both kinds, every probability is null and every document is kept. Rows repeated are
scored each; a null doc_id is scored like any other. Texts are taken whole, however long. A probability
equal to the threshold is kept. An empty table gives no rows. ids are integers; other columns may have
any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import chunks, hashed, mixed, pick, positional, words

BUCKETS = 1 << 14
DIM = 32
WINDOW = 2
SAMPLE = 20_000
THRESHOLD = 0.5
HIDDEN = 32
BLOCKS = 16


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Two distinct places and signs for each bucket."""
    h = mixed(np.arange(BUCKETS), 17)
    first = (h % np.uint64(DIM)).astype(np.int64)
    second = (first + 1 + ((h >> np.uint64(20)) % np.uint64(DIM - 1)).astype(np.int64)) % DIM
    sign = 1.0 - 2.0 * ((h[:, None] >> np.array([40, 41], np.uint64)) & np.uint64(1)).astype(np.float64)
    return np.stack([first, second], 1), sign


def bucketed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, and words per text."""
    w = words(texts, marks=True, lower=False)
    of = (mixed(hashed(w.names), 3) % np.uint64(BUCKETS)).astype(np.int64)
    return of[w.codes], w.counts


def accumulate(buckets: np.ndarray, counts: np.ndarray, into: np.ndarray) -> None:
    """Adds the words' contexts to into (BUCKETS x (DIM + 1); the last column counts words)."""
    place, sign = index_vectors()
    doc = np.repeat(np.arange(len(counts)), counts)
    flat = into.reshape(-1)
    for k in range(-WINDOW, WINDOW + 1):
        word, near = (buckets[max(0, -k) : len(buckets) - max(0, k)], buckets[max(0, k) : len(buckets) + min(0, k)])
        same = doc[max(0, -k) : len(doc) - max(0, k)] == doc[max(0, k) : len(doc) + min(0, k)]
        word, near = word[same], near[same]
        for j in range(2):
            flat += np.bincount(word * (DIM + 1) + place[near, j], weights=sign[near, j], minlength=flat.size)
    into[:, DIM] += np.bincount(buckets, minlength=BUCKETS)


def word_vectors(rows: DataFrame, text: str) -> np.ndarray:
    """Unit vectors of the buckets and, in the last column, their weights, from all documents.

    The tasks' sums meet in two steps, lane by lane and then the lanes, so that no task adds up those of all others.
    """
    lanes = max(1, isqrt(rows.select(text).rdd.getNumPartitions()) // 4)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIM + 1))
        for rb in chunks(batches, text, 4 << 20):
            accumulate(*bucketed(rb.column(0)), total)
        parts = total.astype(np.float32).reshape(BLOCKS, -1)
        lane = np.arange(BLOCKS) * lanes + TaskContext.get().partitionId() % lanes
        yield pa.RecordBatch.from_arrays([pa.array(lane, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "sums"])

    def merge(kind: type):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for rb in batches:
                for b, s in zip(rb.column(0).to_pylist(), rb.column(1)):
                    part = np.frombuffer(s.as_buffer(), kind).astype(np.float64)
                    sums[b] = sums[b] + part if b in sums else part
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "sums"])

        return run

    schema = "block int, sums binary"
    got = rows.select(text).mapInArrow(gather, schema).repartition(BLOCKS * lanes, "block").mapInArrow(merge(np.float32), schema)
    got = got.select(F.floor(F.col("block") / lanes).cast("int").alias("block"), "sums").repartition(BLOCKS, "block").mapInArrow(merge(np.float64), schema).collect()
    m = np.zeros((BLOCKS, BUCKETS // BLOCKS * (DIM + 1)))
    for r in got:
        m[r.block] += np.frombuffer(r.sums)
    m = m.reshape(BUCKETS, DIM + 1)
    p = m[:, DIM] / max(1.0, m[:, DIM].sum())
    v = m[:, :DIM]
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return np.concatenate([v, (1e-3 / (1e-3 + p))[:, None]], 1).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean and spread of the words' vectors per text, and the words per text."""
    buckets, counts = bucketed(texts)
    out = np.zeros((len(counts), 2 * DIM))
    if len(buckets):
        starts = (np.cumsum(counts) - counts)[counts > 0]
        w = vectors[buckets, DIM].astype(np.float64)
        total = np.add.reduceat(w, starts)
        # One dimension at a time: all of them for each word would take a kilobyte a word.
        for j, column in enumerate(np.ascontiguousarray(vectors[:, :DIM].T).astype(np.float64)):
            x = column[buckets]
            xw = x * w
            mean = np.add.reduceat(xw, starts) / total
            square = np.add.reduceat(xw * x, starts) / total
            out[counts > 0, j] = mean
            out[counts > 0, DIM + j] = np.sqrt(np.maximum(0, square - mean * mean))
    return out, counts


@dataclass
class Network:
    """Two layers over standardised inputs; temperature scales the logit."""

    shift: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum((x - self.shift) / self.scale @ a + b, 0) @ c + d[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.01, decay: float = 1e-4) -> Network:
    """Full-batch Adam on four fifths; the temperature minimises the rest's log loss."""
    rng = np.random.default_rng(7)
    held = rng.permutation(len(y)) < len(y) // 5
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    tx, ty = x[~held], y[~held]
    net = Network(tx.mean(0), tx.std(0) + 1e-6, [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)])
    z = (tx - net.shift) / net.scale
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.layers]
    for step in range(1, steps + 1):
        a, b, c, d = net.layers
        h = z @ a + b
        r = np.maximum(h, 0)
        e = (1 / (1 + np.exp(-np.clip(r @ c + d[0], -50, 50))) - ty) / len(ty)
        back = np.outer(e, c) * (h > 0)
        for p, g, (m, v) in zip(net.layers, [z.T @ back + decay * a, back.sum(0), r.T @ e + decay * c, np.array([e.sum()])], moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if held.any():
        grid, s, t = np.exp(np.linspace(-2.3, 2.3, 93)), net.logit(x[held]), y[held]
        loss = [np.mean(np.logaddexp(0, -s / k) * t + np.logaddexp(0, s / k) * (1 - t)) for k in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def train(rows: DataFrame, key: str, text: str, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> Network | None:
    known = pick(labels, "doc_id", "quality").select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("double").alias("__q")).dropna()
    known = known.groupBy("__id").agg((F.avg("__q") >= 0.5).cast("int").alias("__good")).orderBy(F.xxhash64("__id"), "__id").limit(sample)

    def pool(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in chunks(batches, "__text", 2 << 20):
            x, n = pooled(rb.column(2), vectors)
            keep = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(keep)), rb.column(1).take(pa.array(keep)), pa.array([r.tobytes() for r in x[keep]], pa.binary())], names=["id", "good", "x"])

    # The sample is bounded by its parameter, so this side can be broadcast whatever the input.
    found = rows.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id").select("__id", "__good", "__text")
    got = found.mapInArrow(pool, "id long, good int, x binary").groupBy("id").agg(F.first("good").alias("good"), F.min("x").alias("x")).toPandas().sort_values("id")
    y = got.good.to_numpy().astype(np.float64)
    if len(set(y)) < 2:
        return None
    return fit(np.stack([np.frombuffer(b) for b in got.x]), y)


def _scored(rows: DataFrame, text: str, vectors: np.ndarray, net: Network | None) -> DataFrame:
    """rows with __p, the calibrated probability of good quality."""
    names, schema = rows.columns, T.StructType([*rows.schema.fields, T.StructField("__p", T.DoubleType())])
    shared = rows.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = shared.value
        for rb in chunks(batches, text, 2 << 20):
            if model is None:
                p, n = np.zeros(rb.num_rows), np.zeros(rb.num_rows)
            else:
                x, n = pooled(rb.column(names.index(text)), v)
                p = model.probability(x)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(p, pa.float64(), mask=n == 0)], names=[*names, "__p"])

    return rows.mapInArrow(run, schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, probability, keep) for every row."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors = word_vectors(rows, "text")
    out = _scored(rows, "text", vectors, train(rows, "doc_id", "text", labels, vectors, sample))
    return out.select("doc_id", F.col("__p").alias("probability"), F.coalesce(F.col("__p") >= threshold, F.lit(True)).alias("keep"))


def classifier_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows below the threshold, with all columns as they were."""
    cols = docs.columns
    rows = positional(docs)
    key, text = f"_{cols.index('doc_id')}", f"_{cols.index('text')}"
    vectors = word_vectors(rows, text)
    out = _scored(rows, text, vectors, train(rows, key, text, labels, vectors, sample))
    return out.filter(F.coalesce(F.col("__p") >= threshold, F.lit(True))).select(*rows.columns).toDF(*cols)
