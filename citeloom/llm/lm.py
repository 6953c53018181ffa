"""Trigram language model in an Elias-Fano trie, and perplexities of documents.

All documents are counted. Trigrams go to shards by a hash of their first two words, so a shard
holds whole contexts and no word is hot. Its trie has three levels: first words, second words under
them, third words under those. A level keeps the children of all its nodes as one monotone sequence,
each range on top of the last value before it, in Elias-Fano code, and the ranges' starts in
another; a child is found by a successor search in its context's range, relative to that base.
Probabilities are quantised to 8 bits with a codebook for each level. Files lie in the shared folder
and are memory-mapped by the scorers.

Smoothing is absolute discounting by one occurrence, with the mass that is left going to the shorter
context: P(w|uv) = (c(uvw) - 1) / c(uv) + b(uv) P(w|v), b(uv) being one less the sum of the first
terms; so it sums to one. The texts scored are those counted, and the one occurrence taken off is the
text's own: an n-gram that occurs once in the corpus says nothing for the text it stands in, so it has
no mass and no place in the trie. All words count; with a least above 1, rarer ones share one id.

Defined results: null and empty texts and texts without words have 0 words, log probability 0 and a
null perplexity, and count for nothing. Rows repeated count and are scored each. A null doc_id is
scored like any other. Texts are taken whole, however long; ties cannot arise. Over an empty table
nothing is built and nothing returned. ids are integers; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import chunks, hashed, mixed, pick, scratch, words
from citeloom.llm.counts import Vocabulary, by_bucket, mapped, put, rows_of, squeeze, text_bytes, vocabulary

LEAST = 1
DISCOUNT = 1.0
SEEN = 2
SHARD_BYTES = 16 << 20
END = np.uint32(0xFFFFFFFF)
_ONE = np.uint64(1)
_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_SELECT = np.zeros((256, 8), np.int64)
for _b in range(256):
    _places = [k for k in range(8) if _b >> k & 1]
    _SELECT[_b, : len(_places)] = _places


class EliasFano:
    """A sorted sequence: low bits packed, high bits in unary, with counts of ones by word."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str, n: int, low: int) -> None:
        self.n, self.low = n, low
        self.lows, self.highs, self.ones = (arrays[f"{name}.{k}"] for k in ("low", "high", "ones"))

    @staticmethod
    def encode(values: np.ndarray, name: str) -> tuple[dict[str, np.ndarray], tuple[int, int]]:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        low = max(0, (top // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        lows = np.zeros(n * low // 64 + 2, np.uint64)
        if low and n:
            part, at = values & np.uint64((1 << low) - 1), np.arange(n, dtype=np.uint64) * np.uint64(low)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(lows, word, part << off)
            over = off + np.uint64(low) > np.uint64(64)
            np.bitwise_or.at(lows, word[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        bits = np.zeros(-(-(n + (top >> low) + 2) // 64) * 64, np.uint8)
        bits[(values >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
        highs = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(highs), dtype=np.int64)[:-1]]).astype(np.uint32)
        return {f"{name}.low": lows, f"{name}.high": highs, f"{name}.ones": ones}, (n, low)

    @staticmethod
    def _within(word: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The place of the r-th one (from 0) of each word: the byte by sums over all bytes at once, the bit by a table."""
        x = word - ((word >> _ONE) & np.uint64(0x5555555555555555))
        x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
        x = ((x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES  # ones up to and with each byte
        r = r.astype(np.uint64)
        shift = np.bitwise_count(((r * _BYTES | _TOPS) - x) & _TOPS).astype(np.uint64) << np.uint64(3)
        r -= (x << np.uint64(8)) >> shift & np.uint64(0xFF)
        return shift.astype(np.int64) + _SELECT[(word >> shift & np.uint64(0xFF)).astype(np.int64), r.astype(np.int64)]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        return ((self.lows[word] >> off) | (self.lows[word + 1] << _ONE << (np.uint64(63) - off))) & np.uint64((1 << self.low) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        at = word * 64 + self._within(self.highs[word], i - self.ones[word])
        return ((at - i).astype(np.uint64) << np.uint64(self.low)) | self._lows(i)

    def _before(self, high: np.ndarray, zeros: np.ndarray) -> np.ndarray:
        """How many values have high bits below high."""
        z = np.maximum(high - 1, 0)
        word = np.searchsorted(zeros, z, side="right") - 1
        return np.where(high > 0, word * 64 + self._within(~self.highs[word], z - zeros[word]) - z, 0)

    def successor(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first index in [start, end) whose value is at least x, or end."""
        return self._search(x, start, end)[0]

    def find(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first index in [start, end) whose value is x, or -1: its successor, if it has the same bits."""
        at, last = self._search(x, start, end)
        hit = np.flatnonzero(at < last)
        hit = hit[self._lows(at[hit]) == x[hit] & np.uint64((1 << self.low) - 1)]
        out = np.full(len(x), -1)
        out[hit] = at[hit]
        return out

    def _search(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successors, and where the values with the high bits of x end."""
        if not self.n:
            return end.copy(), end.copy()
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        high = (x >> np.uint64(self.low)).astype(np.int64)
        most = int(self.access(np.array([self.n - 1]))[0] >> np.uint64(self.low))
        low_of = x & np.uint64((1 << self.low) - 1)
        capped = np.minimum(high, most)
        lo = np.maximum(self._before(capped, zeros), start)
        hi = np.minimum(self._before(np.minimum(capped + 1, most + 1), zeros), end)
        lo = np.where(high > most, end, np.minimum(lo, end))
        hi = last = np.maximum(hi, lo)
        hi = hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < low_of[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return lo, last


def _quantised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and their codebook, by equal shares of the values."""
    if not len(p):
        return np.zeros(0, np.uint8), np.zeros(256, np.float32)
    book = np.unique(np.quantile(p, np.linspace(0, 1, 256), method="nearest").astype(np.float32))
    code = np.searchsorted((book[1:] + book[:-1]) / 2, p.astype(np.float32)).astype(np.uint8)
    return code, np.pad(book, (0, 256 - len(book)), mode="edge")


def build_shard(uri: str, first: np.ndarray, second: np.ndarray, third: np.ndarray, count: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the trie of sorted, distinct (first, second, third) with counts; third may be END.

    context has the occurrences of first for each. Returns the words that begin bigrams, and the
    probability that their bigrams take here.
    """
    new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])) if len(first) else np.zeros(0, np.int64)
    pairs = np.add.reduceat(count, new) if len(new) else count[:0]
    kept = pairs >= SEEN
    node = np.repeat(np.cumsum(kept) - 1, np.diff([*new, len(first)]))
    leaf = np.repeat(kept, np.diff([*new, len(first)])) & (count >= SEEN) & (third != END)
    a, b, c2 = first[new][kept], second[new][kept], pairs[kept]
    p2 = (c2 - DISCOUNT) / np.maximum(1, context[new][kept])
    p3, parent, leaves = (count[leaf] - DISCOUNT) / c2[node[leaf]], node[leaf], third[leaf].astype(np.uint64)
    back = 1 - np.bincount(parent, weights=p3, minlength=len(a))
    root = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    starts2 = np.append(root, len(a))
    starts3 = np.searchsorted(parent, np.arange(len(a) + 1))

    def stacked(child: np.ndarray, starts: np.ndarray) -> np.ndarray:
        last = np.where(starts[1:] > starts[:-1], child[np.maximum(starts[1:] - 1, 0)] if len(child) else np.uint64(0), np.uint64(0)).astype(np.uint64)
        base = np.cumsum(last) - last
        return child + np.repeat(base, np.diff(starts))

    arrays, sizes = {}, {}
    for name, values in (("roots", a[root]), ("start2", starts2), ("child2", stacked(b.astype(np.uint64), starts2)), ("start3", starts3), ("child3", stacked(leaves, starts3))):
        got, sizes[name] = EliasFano.encode(values, name)
        arrays |= got
    for name, p in (("p2", p2), ("back", back), ("p3", p3)):
        arrays[name], arrays[f"{name}.book"] = _quantised(p)
    put(uri, arrays, **sizes)
    return a[root], np.add.reduceat(arrays["p2.book"][arrays["p2"]].astype(np.float64), root) if len(root) else np.zeros(0)


class Trie:
    """One mapped shard."""

    def __init__(self, uri: str) -> None:
        self.arrays, sizes = mapped(uri)
        self.roots, self.start2, self.child2, self.start3, self.child3 = (EliasFano(self.arrays, k, *sizes[k]) for k in ("roots", "start2", "child2", "start3", "child3"))

    @staticmethod
    def _ranges(level: EliasFano, starts: EliasFano, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the children of each parent begin and end, and the value they stand on."""
        lo, hi = starts.access(parent).astype(np.int64), starts.access(parent + 1).astype(np.int64)
        return lo, hi, np.where(lo > 0, level.access(np.maximum(lo - 1, 0)), np.uint64(0))

    def bigrams(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair, -1 if there is none; a is sorted."""
        out, n = np.full(len(a), -1), self.roots.n
        if not n or not len(a):
            return out
        new = np.concatenate([[True], a[1:] != a[:-1]])
        each = a[new].astype(np.uint64)
        at = self.roots.find(each, np.zeros(len(each), np.int64), np.full(len(each), n))
        known = at >= 0
        place = np.cumsum(known) - 1
        lo, hi, base = self._ranges(self.child2, self.start2, at[known])
        of = np.cumsum(new) - 1
        hit = np.flatnonzero(known[of])
        k = place[of[hit]]
        out[hit] = self.child2.find(base[k] + b[hit].astype(np.uint64), lo[k], hi[k])
        return out

    def contexts(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the third words of each pair are."""
        if not self.child3.n:
            none = np.zeros(len(node), np.int64)
            return none, none, none.astype(np.uint64)
        return self._ranges(self.child3, self.start3, node)

    def trigrams(self, context: tuple[np.ndarray, np.ndarray, np.ndarray], c: np.ndarray) -> np.ndarray:
        lo, hi, base = context
        return self.child3.find(base + c.astype(np.uint64), lo, hi)

    def value(self, name: str, at: np.ndarray) -> np.ndarray:
        return self.arrays[f"{name}.book"][self.arrays[name][at]].astype(np.float64)


def _shard_of(a: np.ndarray, b: np.ndarray, shards: int) -> np.ndarray:
    return (mixed((a.astype(np.uint64) << np.uint64(32)) ^ b.astype(np.uint64), 5) % np.uint64(shards)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Where the vocabulary, the weights of unigrams and the tries are."""

    vocab: Vocabulary
    uri: str
    shards: int
    other_back: float

    def log_probabilities(self, ids: np.ndarray, counts: np.ndarray, distinct: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Natural log of P(word | up to two words before it in the text), word by word.

        distinct has the ids without repeats and each word's place among them, where these are known.
        """
        v = self.vocab
        own, codes = distinct or np.unique(ids, return_inverse=True)
        c = v.gather("count", own, v.other, np.float64)[codes]
        p = (c + DISCOUNT) / (v.total + DISCOUNT * (v.size + 1))
        doc = np.repeat(np.arange(len(counts)), counts)
        pair = np.flatnonzero(doc[1:] == doc[:-1])  # the pair (i, i + 1)
        if not len(pair):
            return np.log(p)
        often = c >= SEEN  # no n-gram with another word is in the trie
        known = pair[often[pair] & often[pair + 1]]
        key, inverse = np.unique(ids[known] << 32 | ids[known + 1], return_inverse=True)
        a, b = key >> 32, key & 0xFFFFFFFF
        shard = _shard_of(a, b, self.shards)
        node, p2, back2 = np.full(len(key), -1), np.zeros(len(key)), np.ones(len(key))
        third = np.full(len(ids) + 1, -1)  # for word i + 2, the distinct pair before it
        third[known + 2] = inverse
        third = third[:-1]
        third[1:][doc[1:] != doc[:-1]] = -1
        p3, place = np.zeros(len(ids)), np.zeros(len(key), np.int64)
        shard = shard.astype(np.min_scalar_type(self.shards))
        order = np.argsort(shard, kind="stable")
        behind = np.flatnonzero(third >= 0)
        behind = behind[np.argsort(shard[third[behind]], kind="stable")]
        cuts, cuts3 = (np.searchsorted(s, np.arange(self.shards + 1)) for s in (shard[order], shard[third[behind]]))
        for s in np.flatnonzero(np.diff(cuts)):
            own2, words3 = order[cuts[s] : cuts[s + 1]], behind[cuts3[s] : cuts3[s + 1]]
            trie = Trie(f"{self.uri}/shard-{s}")
            node[own2] = trie.bigrams(a[own2], b[own2])
            hit = own2[node[own2] >= 0]
            p2[hit], back2[hit] = trie.value("p2", node[hit]), trie.value("back", node[hit])
            place[hit] = np.arange(len(hit))
            words3 = words3[often[words3]]
            words3 = words3[node[third[words3]] >= 0]
            of = place[third[words3]]
            at = trie.trigrams(tuple(x[of] for x in trie.contexts(node[hit])), ids[words3])
            p3[words3[at >= 0]] = trie.value("p3", at[at >= 0])
        back1 = v.gather("back", own, self.other_back, np.float64, folder=f"{self.uri}/back")[codes]
        p[pair + 1] *= back1[pair]
        p[known + 1] += p2[inverse]
        p[behind] = p3[behind] + back2[third[behind]] * p[behind]
        return np.log(np.maximum(p, 1e-300))


def train(docs: DataFrame, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> Model:
    spark, rows = docs.sparkSession, pick(docs, "text").dropna()
    uri = scratch(spark, "lm")
    vocab = vocabulary(rows, "text", f"{uri}/vocab", least)
    shards = max(1, -(-text_bytes(rows) // shard_bytes))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send():
            pair, third = map(np.concatenate, zip(*held))
            order = np.lexsort((third, pair))
            pair, third = pair[order], third[order]
            new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])]))
            n = np.diff([*new, len(pair)]).astype(np.uint32)
            pair, third = pair[new], third[new]
            shard = _shard_of(pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF), shards)
            order = np.argsort(shard.astype(np.uint16) if shards < 65536 else shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            return rows_of([(s, squeeze(*(x[order[cut[s] : cut[s + 1]]] for x in (pair, third, n)))) for s in range(shards) if cut[s + 1] > cut[s]])

        for rb in chunks(batches, "text", 8 << 20):
            w = words(rb.column(0))
            own = vocab.ids(hashed(w.names))
            often = (vocab.gather("count", own, vocab.other) >= SEEN)[w.codes]
            ids, doc = own[w.codes], w.docs
            # What has a word that occurs once occurs once, and has no mass.
            at = np.flatnonzero((doc[1:] == doc[:-1]) & often[1:] & often[:-1])
            if len(at):
                after = np.append(ids, 0)[at + 2].astype(np.uint32)
                after[(np.append(doc, -1)[at + 2] != doc[at]) | ~np.append(often, False)[at + 2]] = END
                held.append((ids[at].astype(np.uint64) << np.uint64(32) | ids[at + 1].astype(np.uint64), after))
            if sum(len(p) for p, _ in held) > 3_000_000:
                yield send()
                held.clear()
        if held:
            yield send()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, runs in by_bucket(batches):
            pair, third, n = (np.concatenate([r[k] for r in runs]) for k in range(3))
            runs.clear()
            order = np.lexsort((third, pair))
            pair, third, n = pair[order], third[order], n[order].astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])]))
            n, pair, third = np.add.reduceat(n, new), pair[new], third[new]
            a, b = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
            roots, taken = build_shard(f"{uri}/shard-{s}", a, b, third, n, vocab.gather("count", a, vocab.other))
            which = np.where(roots > 0, vocab.bucket_of(roots), -1)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(roots), pa.array(taken)], names=["bucket", "word", "taken"])

    runs = rows.mapInArrow(count, "bucket int, run binary").repartitionById(shards, F.col("bucket")).sortWithinPartitions("bucket")
    taken = runs.mapInArrow(merge, "bucket long, word long, taken double").groupBy("bucket", "word").agg(F.sum("taken").alias("taken"))
    first, size = np.array(vocab.first), vocab.size

    def backs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for rb in batches:
            bucket, word, t = (c.to_numpy() for c in rb.columns)
            for b in np.unique(bucket):
                held.setdefault(int(b), []).append((word[bucket == b], t[bucket == b]))
        for b, parts in held.items():
            word, t = map(np.concatenate, zip(*parts))
            if b >= 0:
                end = first[b + 1] if b + 1 < len(first) else size
                back = np.ones(end - first[b], np.float32)
                back[word - 1 - first[b]] = np.clip(1 - t, 1e-6, 1)
                put(f"{uri}/back/words-{b}", {"back": back})
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([float(t.sum()) if b < 0 else 0.0])], names=["bucket", "other"])

    got = taken.repartition("bucket").mapInArrow(backs, "bucket long, other double").collect()
    starts = list(vocab.first)
    for b in set(range(len(starts))) - {r.bucket for r in got}:
        end = starts[b + 1] if b + 1 < len(starts) else size
        put(f"{uri}/back/words-{b}", {"back": np.ones(end - starts[b], np.float32)})
    for s in range(shards):  # a shard without n-grams still has its file
        _ensure(f"{uri}/shard-{s}")
    other = sum(r.other for r in got)
    return Model(vocab, uri, shards, float(np.clip(1 - other, 1e-6, 1)))


def _ensure(uri: str) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        none = np.zeros(0, np.int64)
        build_shard(uri, none, none, none.astype(np.uint32), none, none)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, words, log_probability, perplexity) for every row."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in chunks(batches, "text", 8 << 20):
            w = words(rb.column(1))
            own, counts = model.vocab.ids(hashed(w.names)), w.counts
            logs = model.log_probabilities(own[w.codes], counts, (own, w.codes)) if len(w.codes) else np.zeros(0)
            total = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=logs, minlength=len(counts)).astype(np.float64)
            none = counts == 0
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(counts), pa.array(total), pa.array(np.exp(-total / np.maximum(counts, 1)), mask=none)], names=["doc_id", "words", "log_probability", "perplexity"])

    return rows.mapInArrow(run, "doc_id long, words long, log_probability double, perplexity double")


def lm_scores(docs: DataFrame, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    return score(docs, train(docs, least, shard_bytes))
