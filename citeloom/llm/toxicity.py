"""Toxicity by lexicon induction: random walks from labelled seeds over a PPMI word graph.

The graph is that of all documents and all their words, common ones too, joined where they stand at
a distance of up to WINDOW, at least twice, and more often than chance: the weight is the positive
pointwise mutual information, which damps common words as they go with everything. Words lie in
stripes by their hashes; the pairs of two stripes are one block, counted, merged and kept as one file
with each edge once, so that no task holds all edges of a common word. Seeds come from a
bounded sample of labelled documents (the parameter sample; the rows with the least hash of doc_id):
words that occur in toxic documents more often than their share, by more than chance among so many
words tested, where uses in one context count once, so that copies of one document do not make
seeds; and those most frequent that never occur in toxic ones. Walks with restart from either side
give each word two masses, and their contrast is its weight, from 0 to 1. A document's score is the
chance that at least one of its words speaks for toxicity, 1 - product(1 - weight) over words of a
weight of at least CERTAIN. The cut is that of the best F1 on the sample.

Defined results: null and empty texts score 0 and are not toxic. Rows repeated count in the graph and
are scored each; a doc_id that is labelled or present more than once counts in the sample as one
document, toxic from one half of its labels on. A null doc_id is scored. In a sample so small that no
word passes the test, those of the best evidence are the seeds. If the sample lacks toxic or clean
documents, nothing tells them apart: there are no seeds and all scores are 0. Texts are taken whole,
however long. Of seeds with equal evidence those of the lesser hash come first; an empty table gives
no rows, and columns with other names are ignored, whatever they are called. ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from math import isqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import chunks, hashed, mixed, pick, scratch, staged, words
from citeloom.llm.counts import Vocabulary, by_bucket, mapped, over, put, rows_of, squeeze, summed, text_bytes, there, unsqueeze, vocabulary

WINDOW = 2
SAMPLE = 30_000
SEEDS = 300
LEVEL = 0.01
RESTART = 0.3
STEPS = 4
CERTAIN = 0.3
BLOCK_BYTES = 12 << 20


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(id, toxic, text) of the sample, one row for each doc_id."""
    known = pick(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("double").alias("toxic")).dropna()
    known = known.groupBy("id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # Bounded by the parameter, whatever the input: this side can always be broadcast.
    found = docs.select(F.col("doc_id").alias("id"), "text").dropna().join(F.broadcast(known), "id")
    return staged(found.groupBy("id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")), "sample")


def seeds(sample: DataFrame, count: int = SEEDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the toxic and of the clean seed words."""

    def terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in chunks(batches, "text"):
            w = words(rb.column(1))
            if not len(w.codes):
                continue
            h, docs = hashed(w.names)[w.codes], w.docs
            edge = np.concatenate([[True], docs[1:] != docs[:-1]])
            before = np.where(edge, np.uint64(0), np.concatenate([h[:1], h[:-1]]))
            after = np.where(np.append(edge[1:], True), np.uint64(0), np.append(h[1:], h[-1:]))
            context = (mixed(before ^ mixed(after, 1), 2) >> np.uint64(58)).astype(np.int64)
            _, at = np.unique(np.stack([docs.astype(np.uint64), h]), axis=1, return_index=True)
            toxic = rb.column(0).to_numpy()[docs[at]]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(toxic.astype(np.int32)), pa.array(np.left_shift(np.uint64(1), context[at].astype(np.uint64)).view(np.int64))], names=["word", "toxic", "context"])

    base = sample.agg(F.avg("toxic")).first()[0]
    if not base or base == 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    got = sample.select("toxic", "text").mapInArrow(terms, "word long, toxic int, context long").groupBy("word")
    got = staged(got.agg(F.count("*").alias("n"), F.sum("toxic").alias("t"), F.bit_count(F.bit_or(F.when(F.col("toxic") == 1, F.col("context")).otherwise(0))).alias("support")), "terms")
    t, n, support = F.col("t"), F.col("n"), F.col("support")
    g2 = 2 * (t * F.log(t / (n * base)) + F.when(t < n, (n - t) * F.log((n - t) / (n * (1 - base)))).otherwise(0))
    # The 64 bits fill up: so many contexts leave so many of them set.
    contexts = F.when(support < 64, -64 * F.log(1 - support / 64)).otherwise(t)
    sizes = got.groupBy("n").count().toPandas().sort_values("n")
    limit = _evidence(sizes["n"].to_numpy(), sizes["count"].to_numpy(), base)
    ranked = got.filter(t > n * base).withColumn("g2", g2 * F.least(F.lit(1.0), contexts / t)).orderBy(F.col("g2").desc(), "word")
    bad = ranked.filter((t > 0.6 * n) & (F.col("g2") >= limit)).limit(count).collect()
    if not bad:
        best = ranked.limit(count).collect()
        bad = [r for r in best if r.g2 >= best[0].g2 * (1 - 1e-9)]
    good = got.filter(t == 0).orderBy(n.desc(), "word").limit(count).collect()
    return tuple(np.array([r.word for r in x], np.int64).view(np.uint64) for x in (bad, good))


def _evidence(n: np.ndarray, times: np.ndarray, base: float) -> float:
    """The G squared that LEVEL asks for, corrected for the words tested: those of enough documents to reach it (Tarone)."""
    tested = np.cumsum(times[::-1])[::-1]
    for lowest, words_tested in zip(n, tested):
        limit = NormalDist().inv_cdf(LEVEL / float(words_tested) / 2) ** 2
        if -2 * lowest * np.log(base) >= limit:
            return float(limit)
    return float(-2 * n[-1] * np.log(base)) if len(n) else 0.0


@dataclass(frozen=True)
class Grid:
    """Every word as (stripe, place): a stripe is a range of hashes, and its commonest words come first."""

    vocab: Vocabulary
    uri: str
    bits: int
    widths: tuple[int, ...]

    @property
    def stripes(self) -> int:
        return 1 << self.bits

    @property
    def place_bits(self) -> int:
        return max(1, *self.widths).bit_length()

    def codes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """stripe << place_bits | place of each word, and which of them are known."""
        ids = self.vocab.ids(hashes)
        bucket = self.vocab.bucket_of(np.maximum(ids, 1))
        rank = self.vocab.gather("rank", ids, 0, np.int64)
        fine = self.vocab.bits - self.bits
        return (bucket >> fine << self.place_bits | rank << fine | bucket & (1 << fine) - 1).astype(np.uint64), ids > 0

    def values(self, folder: str, name: str, codes: np.ndarray) -> np.ndarray:
        stripe, place = (codes >> np.uint64(self.place_bits)).astype(np.int64), (codes & np.uint64((1 << self.place_bits) - 1)).astype(np.int64)
        out = np.zeros(len(codes))
        for s in np.unique(stripe):
            own = stripe == s
            out[own] = mapped(f"{self.uri}/{folder}/{s}")[0][name][place[own]]
        return out

    def pmi(self, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # Each word has about 2 WINDOW neighbours, so the pairs' chance is that of the words.
        return np.log(n * float(self.vocab.total) / (2.0 * WINDOW * a * b))


def _grid(rows: DataFrame, uri: str, block_bytes: int) -> Grid:
    """Counts all words and lays them out in so many stripes that their pairs' blocks fit a task."""
    blocks, bits = max(1, text_bytes(rows) // block_bytes), 0
    while (1 << bits) * ((1 << bits) + 1) < blocks:
        bits += 1
    vocab = vocabulary(rows, "text", f"{uri}/vocab", 1, least_bits=bits)
    fine = vocab.bits - bits
    sizes = np.diff([*vocab.first, vocab.size])
    widths = tuple(int(x) for x in sizes.reshape(1 << bits, -1).max(1) << fine)
    grid = Grid(vocab, uri, bits, widths)
    if 2 * (bits + grid.place_bits) > 64:
        raise ValueError(f"{vocab.size} distinct words are more than the keys of pairs can hold")

    def lay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for s in rb.column(0).to_pylist():
                count = np.ones(widths[s])
                for b in range(s << fine, (s + 1) << fine):
                    words_of = mapped(vocab.bucket_uri(b))[0]
                    count[(words_of["rank"].astype(np.int64) << fine) + (b & (1 << fine) - 1)] = words_of["count"]
                put(f"{uri}/count/{s}", {"count": count})
            yield rb

    over(rows.sparkSession, grid.stripes).mapInArrow(lay, "id int").write.format("noop").mode("overwrite").save()
    return grid


def _block(low: int, high: int) -> int:
    return high * (high + 1) // 2 + low


def _graph(rows: DataFrame, grid: Grid) -> None:
    """Writes the PPMI graph, an edge once, in a file for each two stripes (the lower one first)."""
    g, p = np.uint64(grid.bits), np.uint64(grid.place_bits)
    inner, mask = np.uint64((1 << 2 * grid.place_bits) - 1), np.uint64((1 << grid.place_bits) - 1)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            both = keys >> (p + p)
            cut = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1], [True]]))
            parts = [(_block(int(both[i]) >> grid.bits, int(both[i]) & grid.stripes - 1), squeeze(keys[i:j] & inner, n[i:j].astype(np.uint32))) for i, j in zip(cut[:-1], cut[1:])]
            return rows_of(parts)

        for rb in chunks(batches, "text", 6 << 20):
            w = words(rb.column(0))
            codes, docs = grid.codes(hashed(w.names))[0][w.codes], w.docs
            for k in range(1, WINDOW + 1):
                a, b = codes[:-k], codes[k:]
                ok = (docs[:-k] == docs[k:]) & (a != b)
                low, high = np.minimum(a, b)[ok], np.maximum(a, b)[ok]
                held.append(((low >> p << g | high >> p) << p | low & mask) << p | high & mask)
            if sum(map(len, held)) > 5_000_000:
                yield send()
                held.clear()
        if sum(map(len, held)):
            yield send()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, runs in by_bucket(batches):
            keys, n = summed(np.concatenate([r[0] for r in runs]), np.concatenate([r[1].astype(np.int64) for r in runs]))
            keys, n = keys[n >= 2], n[n >= 2]
            high = (isqrt(8 * block + 1) - 1) // 2
            a, b = (keys >> p).astype(np.int64), (keys & mask).astype(np.int64)
            keep = grid.pmi(n, mapped(f"{grid.uri}/count/{block - _block(0, high)}")[0]["count"][a], mapped(f"{grid.uri}/count/{high}")[0]["count"][b]) > 0
            put(f"{grid.uri}/graph/{block}", {"run": np.frombuffer(squeeze(keys[keep], n[keep].astype(np.uint32)), np.uint8)})
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32())], names=["bucket"])

    runs = rows.select("text").mapInArrow(count, "bucket int, run binary")
    runs = runs.repartitionById(_block(0, grid.stripes), F.col("bucket")).sortWithinPartitions("bucket")
    runs.mapInArrow(merge, "bucket int").write.format("noop").mode("overwrite").save()


def _walks(spark: SparkSession, grid: Grid, bad: np.ndarray, good: np.ndarray) -> None:
    """Writes each word's weight, stripe by stripe, under step{STEPS}."""
    uri, mask = grid.uri, np.uint64((1 << grid.place_bits) - 1)
    start = {}
    for side, seeds_of in (("bad", bad), ("good", good)):
        codes, known = grid.codes(seeds_of)
        start[side] = np.unique(codes[known])

    def edges_of(s: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(places in stripe s, other stripe, places there, weights): each edge at s, from s."""
        own = mapped(f"{uri}/count/{s}")[0]["count"]
        for i in range(grid.stripes):
            if not there(at := f"{uri}/graph/{_block(min(i, s), max(i, s))}"):
                continue
            keys, n = unsqueeze(mapped(at)[0]["run"].tobytes())
            a, b = (keys >> np.uint64(grid.place_bits)).astype(np.int64), (keys & mask).astype(np.int64)
            others = mapped(f"{uri}/count/{i}")[0]["count"]
            if s <= i:
                yield a, i, b, grid.pmi(n, own[a], others[b])
            if s >= i:
                yield b, i, a, grid.pmi(n, own[b], others[a])

    def degrees(s: int) -> None:
        degree = np.zeros(grid.widths[s])
        for a, _, _, w in edges_of(s):
            degree += np.bincount(a, weights=w, minlength=len(degree))
        put(f"{uri}/degree/{s}", {"degree": degree.astype(np.float32)})

    def step(k: int, s: int) -> None:
        n = grid.widths[s]
        out = {side: np.zeros(n) for side in start}
        for a, i, b, w in edges_of(s) if k else ():
            w = w / np.maximum(mapped(f"{uri}/degree/{i}")[0]["degree"][b], 1e-9)
            for side in out:
                out[side] += (1 - RESTART) * np.bincount(a, weights=mapped(f"{uri}/step{k - 1}/{i}")[0][side][b] * w, minlength=n)
        for side, own in start.items():
            here = (own[own >> np.uint64(grid.place_bits) == s] & mask).astype(np.int64)
            out[side][here] += (1.0 if k == 0 else RESTART) / max(1, len(own))
        if k == STEPS:
            # In units of what a seed has from its restarts alone.
            mb, mg = (out[side] * len(own) / RESTART for side, own in start.items())
            out = {"weight": np.clip((mb - mg) / (mb + mg + 1), 0, 0.999)}
        put(f"{uri}/step{k}/{s}", {name: x.astype(np.float32) for name, x in out.items()})

    def each(f):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                for s in rb.column(0).to_pylist():
                    f(s)
                yield rb

        return run

    for f in (degrees, *[partial(step, k) for k in range(STEPS + 1)]):
        over(spark, grid.stripes).mapInArrow(each(f), "id int").write.format("noop").mode("overwrite").save()


def _scores(rows: DataFrame, keep: str, grid: Grid) -> DataFrame:
    """(keep, score) of rows, 0 without a text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in chunks(batches, "text"):
            w = words(rb.column(1))
            codes, known = grid.codes(hashed(w.names))
            weight = np.zeros(len(codes))
            weight[known] = grid.values(f"step{STEPS}", "weight", codes[known])
            weight[weight < CERTAIN] = 0
            total = np.bincount(w.docs, weights=np.log1p(-weight)[w.codes], minlength=len(w.counts))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(1 - np.exp(total))], names=[keep, "score"])

    return rows.select(keep, "text").mapInArrow(run, f"{keep} long, score double")


def lexicon(rows: DataFrame, bad: np.ndarray, good: np.ndarray, block_bytes: int = BLOCK_BYTES) -> Grid:
    """The walks' weights of all words of rows, from the hashes of either side's seeds."""
    uri = scratch(rows.sparkSession, "toxicity")
    grid = _grid(rows, uri, block_bytes)
    _graph(rows, grid)
    _walks(rows.sparkSession, grid, bad, good)
    return grid


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, toxic) for every row."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = sampled(rows, labels, sample)
    bad, good = seeds(some)
    if not len(bad):
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("toxic"))
    grid = lexicon(rows, bad, good)
    truth = _scores(some.withColumn("id", F.col("id") * 2 + F.col("toxic")), "id", grid).toPandas()
    score, toxic = truth.score.to_numpy(), truth.id.to_numpy() % 2
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + toxic.sum())
    f1[np.append(np.diff(score[order]) == 0, False)] = 0  # equal scores are on one side
    f1[score[order] <= 0] = 0
    best = float(score[order][int(np.argmax(f1))])
    # Midway to the next lower score, as the sample doesn't tell where between them the cut lies.
    cut = max(CERTAIN, (best + max(score[score < best], default=0.0)) / 2)
    return _scores(rows, "doc_id", grid).select("doc_id", "score", (F.col("score") >= cut).alias("toxic"))
