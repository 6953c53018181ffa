"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its word trigrams, and its signature the least hash of the set under each
of PERMUTATIONS hash functions. A tree starts with all documents in one node. A node chooses
BRANCHES positions of the signature, by a hash of its own path, and each document goes to one child
for each of them, named by its least token there: two documents of similarity s meet in a child
with probability s for each choice. Nodes of up to SMALL documents are compared exhaustively; larger
ones branch again, up to DEPTH. Then a node holds near copies above all, and its connected groups are
searched exactly, each document against all those not reached yet. TREES independent trees bring
the recall of pairs at the threshold above 0.95 (DEPTH 3: one tree finds 0.52 of them, six 0.99).
Documents with the same signature are one set to begin with, so exact copies cost nothing.
Similarity is the share of equal signature values; groups are the connected components.

Defined results: null, empty and blank texts and texts without words are near copies of nothing; a
text of one or two words is one token. Rows with a null doc_id are in no group. Rows repeated with
one doc_id count once, and their signatures join its groups. Groups of one are not returned. Texts are
taken whole, however long; of equal candidates for a group's id there is but one, the least doc_id. An
empty table gives no rows. ids are integers; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import chunks, hashed, mixed, pick, positional, staged, words

PERMUTATIONS = 128
SHINGLE = 3
THRESHOLD = 0.45
BRANCHES = 2
TREES = 6
DEPTH = 3
SMALL = 64

_RNG = np.random.default_rng(20180607)
_MULTIPLY = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams, text after text, and their number per text."""
    w = words(texts)
    h = hashed(w.names)[w.codes]
    n = np.where(w.counts > 0, np.maximum(1, w.counts - size + 1), 0)
    start = np.repeat(np.cumsum(w.counts) - w.counts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(size, np.repeat(w.counts, n))
    out = np.zeros(len(start), np.uint64)
    for k in range(size):
        has = length > k
        out[has] = mixed(out[has] ^ h[start[has] + k], k + 1)
    return out, n


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """PERMUTATIONS least 32-bit hashes per text with words, and the positions of those texts."""
    h, n = shingles(texts)
    has = np.flatnonzero(n > 0)
    out = np.empty((len(has), PERMUTATIONS), np.uint32)
    if len(has):
        starts = (np.cumsum(n) - n)[has]
        for p in range(PERMUTATIONS):
            out[:, p] = np.minimum.reduceat(((h * _MULTIPLY[p] + _ADD[p]) >> np.uint64(32)).astype(np.uint32), starts)
    return out, has


def _signed(rows: DataFrame, trees: int) -> DataFrame:
    """(doc_id, sig, nodes): 16 bits of each value, and the children of the trees' roots by all 32."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in chunks(batches, "text", 4 << 20):
            sig, has = signatures(rb.column(1))
            roots = mixed(np.arange(trees), 9).view(np.int64)
            nodes = branch(np.tile(roots, len(sig)), np.repeat(sig, trees, axis=0)).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * trees * BRANCHES, pa.int32()), pa.array(nodes))
            yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(has)), pa.array([s.tobytes() for s in sig.astype(np.uint16)], pa.binary()), lists], names=["doc_id", "sig", "nodes"])

    return rows.mapInArrow(run, "doc_id long, sig binary, nodes array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, PERMUTATIONS)


def branch(node: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """The children (a column for each choice) of documents in nodes."""
    out = np.empty((len(node), BRANCHES), np.int64)
    for b in range(BRANCHES):
        at = (mixed(node.view(np.uint64), 100 + b) % np.uint64(PERMUTATIONS)).astype(np.int64)
        value = sig[np.arange(len(node)), at].astype(np.uint64)
        out[:, b] = mixed(mixed(node.view(np.uint64), 200 + b) ^ (value << np.uint64(8)) ^ at.astype(np.uint64), 300).view(np.int64)
    return out


def compared(node: np.ndarray, ids: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of similar documents of one node, over rows sorted by node: all pairs, block by block."""
    least, found = threshold * PERMUTATIONS, []
    for k in range(1, len(node)):
        a = np.flatnonzero(node[:-k] == node[k:])
        if not len(a):
            break
        for part in np.array_split(a, -(-len(a) // 20_000)):
            near = part[(sig[part] == sig[part + k]).sum(1) >= least]
            if len(near):
                found.append((ids[near], ids[near + k]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (ids[:0], ids[:0])


def connected(ids: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the similarity components of one node: a search over all unreached members."""
    least, left, edges = threshold * PERMUTATIONS, np.arange(len(ids)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.concatenate([(sig[part] == sig[x]).sum(1) >= least for part in np.array_split(left, -(-len(left) // 20_000))])
            reached, left = left[near], left[~near]
            edges += [(ids[x], ids[y]) for y in reached]
            todo.extend(map(int, reached))
    a = np.array(edges, dtype=np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1]


def _searched(members: DataFrame, threshold: float, small: int) -> DataFrame:
    """(a, b) of similar documents, from (node, doc_id, sig) rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def search(node, ids, sig):
            cuts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
            size = np.diff(cuts)
            pairs = []
            for i in np.flatnonzero(size > small):
                pairs.append(connected(ids[cuts[i] : cuts[i + 1]], sig[cuts[i] : cuts[i + 1]], threshold))
            few = np.repeat(size <= small, size)
            pairs.append(compared(node[few], ids[few], sig[few], threshold))
            a, b = (np.concatenate(x) for x in zip(*pairs))
            low, high = np.minimum(a, b), np.maximum(a, b)
            edge = np.unique(np.stack([low, high], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(edge[:, 0]), pa.array(edge[:, 1])], names=["a", "b"])

        for rb in batches:
            if not rb.num_rows:
                continue
            node, ids, sig = rb.column(0).to_numpy(), rb.column(1).to_numpy(), _matrix(rb.column(2))
            last = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            if last:
                held.append((node[:last], ids[:last], sig[:last]))
                yield search(*map(np.concatenate, zip(*held)))
                held = []
            held.append((node[last:], ids[last:], sig[last:]))
        if held:
            yield search(*map(np.concatenate, zip(*held)))

    return members.select("node", "doc_id", "sig").repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of each connected component, by alternating star contractions."""
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: each node's greater neighbours move to the least of its neighbourhood.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # Small star: each node joins its lesser neighbours to the least of them.
        lower = large.select(F.col("b").alias("x"), F.col("a").alias("y"))
        root = lower.groupBy("x").agg(F.min("y").alias("m"))
        joined = lower.join(root, "x")
        edges = joined.select(F.col("m").alias("a"), F.col("y").alias("b")).union(joined.select(F.col("m").alias("a"), F.col("x").alias("b"))).filter("a < b").distinct()
        edges = staged(edges, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
        before = now


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """(doc_id, group_id, group_size) of the documents with near copies; group_id is the least doc_id."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna()
    signed = staged(_signed(rows, trees), "signatures")
    sets = staged(signed.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("nodes").alias("nodes"), F.count("*").alias("n")), "sets")
    same = sets.filter("n > 1").select("sig", F.col("doc_id").alias("a"))
    copies = signed.select("sig", "doc_id").join(same, "sig").select("a", F.col("doc_id").alias("b")).filter("a < b")

    def children(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids, sig, node = rb.column(0).to_numpy(), _matrix(rb.column(1)), rb.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, BRANCHES)), pa.array(branch(node, sig).reshape(-1))], names=["doc_id", "node"])

    found = copies
    held = sets.select("doc_id", F.explode("nodes").alias("node"))
    sets = sets.select("doc_id", "sig")
    for level in range(1, depth + 1):
        sizes = held.groupBy("node").count().filter("count > 1")
        if level < depth:
            large = staged(held.join(sizes.filter(F.col("count") > small).select("node"), "node").distinct(), "large")
            sizes = sizes.filter(F.col("count") <= small)
        members = held.join(sizes.select("node"), "node").distinct().join(sets, "doc_id")
        found = found.union(staged(_searched(members, threshold, small).distinct(), "pairs"))
        if level == depth or large.isEmpty():
            break
        held = staged(large.join(sets, "doc_id").select("doc_id", "sig", "node").mapInArrow(children, "doc_id long, node long"), "nodes")
    roots = components(found)
    grouped = roots.union(roots.select("root", "root").distinct().toDF("id", "root"))
    sizes = roots.groupBy("root").agg((F.count("*") + 1).alias("group_size"))
    return grouped.join(sizes, "root").select(F.col("id").alias("doc_id"), F.col("root").alias("group_id"), "group_size")


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs with one document of each group, that of the least doc_id; all columns as they were.

    Of rows repeated with one doc_id the texts may differ; they all share its fate.
    """
    cols = docs.columns
    rows = positional(docs)
    key = f"_{cols.index('doc_id')}"
    gone = near_groups(docs, threshold, **options).filter("doc_id <> group_id").select(F.col("doc_id").alias("__gone"))
    return rows.join(gone, F.col(key).cast("long") == F.col("__gone"), "left_anti").select(*rows.columns).toDF(*cols)


