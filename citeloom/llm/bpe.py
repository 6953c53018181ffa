"""Byte-level BPE by corpus-level merge replay, and its decoding.

The distinct pre-tokens of all documents are the corpus's dictionary, dealt to buckets by their hash.
In a bucket, an inverted index from each token pair to the word positions where it begins drives the
replay: merges are applied in rank order, each at all its positions in all words at once, and only the
pairs with the touched neighbours are looked up and indexed anew. So each distinct word of the corpus
is merged once. The buckets' results lie as mapped files in the shared folder, and documents then take
their words' tokens from them. Words of equal hash are left out there and replayed by who needs them.

Defined results: a null text has null tokens, an empty one none. Text is taken whole, however long,
special-token strings in it as ordinary text. Rows repeated are encoded each; a null doc_id stays
null; ties cannot arise. An empty table gives no rows. ids are integers; other columns may have any
names. Decoding ids that are not in the vocabulary is an error; bytes that are not UTF-8 decode to
U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import chunks, expand, hashed, pick, scratch, staged, strings
from citeloom.llm.counts import mapped, over, put, rows_of, text_bytes, there

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
BATCH_BYTES = 32 << 20
PIECE_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
FILE_WORDS = 4 << 20
HELD_WORDS = 400_000
MARKS = "\x1f\x1e\x1d\x1c\x02\x03" + "".join(map(chr, range(0xF0000, 0xF0100)))
_SPACE = r"[\t-\r\x85\p{Z}]"
_BEHIND = r"([\pL\pN])([^\t-\r\x{85}\pZ\pL\pN" + "MARK])"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^\t-\r\x85\p{{Z}}\p{{L}}\p{{N}}]+|{_SPACE}+(?![^\t-\r\x85\p{{Z}}])|{_SPACE}+")


class Ranks:
    """A rank file: tokens by id, and the rank of every pair of tokens whose bytes are a token."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ids.items():
            for i in range(1, len(token)):
                a, b = ids.get(token[:i]), ids.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        tokens = [b""] * (max(ids.values()) + 1)
        for token, rank in ids.items():
            tokens[rank] = token
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if its bytes are no token."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


@cache
def ranks(folder: str, name: str) -> Ranks:
    return Ranks(os.path.join(folder, name))


def replay(words: list[bytes], table: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the words, one after another, and the tokens of each."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    token = table.byte[data]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(size)[size > 0]
    after[ends - 1] = -1
    before[np.concatenate([[0], ends[:-1]])] = -1
    rank = np.full(n, -1)  # of the pair that begins at each position
    inner = np.flatnonzero(after >= 0)
    rank[inner] = table.of(token[inner], token[inner + 1])
    index: dict[int, list[np.ndarray]] = {}
    todo: list[int] = []

    def insert(at: np.ndarray, r: np.ndarray) -> None:
        known = r >= 0
        at, r = at[known], r[known]
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for k, part in zip(r[np.concatenate([[0], cuts])].tolist() if len(r) else [], np.split(at, cuts)):
            if k not in index:
                index[k] = []
                heapq.heappush(todo, k)
            index[k].append(part)

    insert(inner, rank[inner])
    while todo:
        r = heapq.heappop(todo)
        parts = index.pop(r)
        p = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        p = p[rank[p] == r]
        if not len(p):
            continue
        q = after[p]
        if len(p) > 1 and (chained := np.concatenate([[False], q[:-1] == p[1:]])).any():
            # In a run like aaaa every other pair is merged, from the left.
            place = np.arange(len(p))
            p = p[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            q = after[p]
        token[p], token[q], rank[q] = r, -1, -1
        far = after[q]
        after[p] = far
        has = far >= 0
        before[far[has]] = p[has]
        rank[p] = -1
        rank[p[has]] = table.of(token[p[has]], token[far[has]])
        left = before[p]
        left = left[left >= 0]
        rank[left] = table.of(token[left], token[after[left]])
        touched = np.concatenate([p, left])
        insert(touched, rank[touched])
    live = token >= 0
    word = np.repeat(np.arange(len(words)), size)
    return token[live], np.bincount(word[live], minlength=len(words))


def _pretokens(texts: pa.Array, ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pre-tokens text after text, and how many each text has; new ones join ids."""
    texts = texts.cast(pa.large_string()).fill_null("")
    mark = next(c for c in "\x1f\x1e\x1d\x1c\x02\x03" + "".join(map(chr, range(0xF0000, 0xF0100))) if not pc.any(pc.match_substring(texts, c)).as_py())
    # Cutting before spaces cuts no pre-token, but where a space stands inside a longer gap.
    # So does cutting between a letter or digit and a mark behind it.
    split = pc.replace_substring_regex(pc.replace_substring(texts, " ", mark + " "), _BEHIND.replace("MARK", mark), rf"\1{mark}\2")
    inside = pc.match_substring_regex(texts, r"[\s\x0b\x85\pZ] ([\s\x0b\x85\pZ]|$)")
    split = pc.if_else(inside, texts, split)
    lists = pc.split_pattern(split, mark)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    names = strings(coded.dictionary)
    # A piece that is a pre-token itself is known from the first text on; only new ones go to the pattern.
    known = list(map(ids.get, names))
    parts: dict[int, list[int]] = {}
    for i in [i for i, k in enumerate(known) if k is None]:
        s = names[i]
        if s[1:].isalpha() and s[:1] == " ":
            known[i] = ids.setdefault(s, len(ids))
        else:
            found = [ids.setdefault(w, len(ids)) for w in PATTERN.findall(s)]
            known[i] = found[0] if found else 0
            if len(found) != 1:
                parts[i] = found
    each = np.ones(len(names), np.int64)
    for i, found in parts.items():
        each[i] = len(found)
    values = np.repeat(np.array(known, np.int64), each)
    starts = np.cumsum(each) - each
    for i, found in parts.items():
        values[starts[i] : starts[i] + len(found)] = found
    out, per = expand(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts, each, values)
    return out, per


def encode_batch(texts: pa.Array, table: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Tokens text after text, and how many each has."""
    ids: dict[str, int] = {}
    codes, counts = _pretokens(texts, ids)
    tokens, each = replay([w.encode("utf-8", "surrogatepass") for w in ids], table)
    return expand(codes, counts, each, tokens)


@dataclass(frozen=True)
class Dictionary:
    """Tokens of all words of a corpus: files of sorted hashes, a file for each value of the first bits."""

    uri: str
    bits: int

    def tokens(self, words: list[str], table: Ranks) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words, one after another, and the tokens of each."""
        h = hashed(words)
        which = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        each, found = np.zeros(len(h), np.int64), []
        missing = np.ones(len(h), bool)
        for f in np.unique(which):
            own = np.flatnonzero(which == f)
            file = mapped(f"{self.uri}/words-{f}")[0]
            if not len(file["hash"]):
                continue
            at = np.minimum(np.searchsorted(file["hash"], h[own]), len(file["hash"]) - 1)
            hit = file["hash"][at] == h[own]
            own, at = own[hit], at[hit]
            each[own], missing[own] = file["each"][at], False
            found.append((own, file["start"][at], file["tokens"]))
        lost = np.flatnonzero(missing)
        if len(lost):
            values, each[lost] = replay([words[i].encode("utf-8", "surrogatepass") for i in lost], table)
            found.append((lost, np.cumsum(each[lost]) - each[lost], values))
        out, to = np.zeros(int(each.sum()), np.int64), np.cumsum(each) - each
        for own, start, values in found:
            n = each[own]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to[own], n) + step] = values[np.repeat(start, n) + step]
        return out, each


def _runs(words: list[str], bits: int) -> pa.RecordBatch:
    """The words as one compressed run for each bucket of their hashes."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    h = hashed(words)
    order = np.argsort(h)
    bucket = (h[order] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    runs = []
    for a, b in zip(cut[:-1], cut[1:]):
        own = [data[i] for i in order[a:b]]
        size = np.fromiter(map(len, own), np.uint32, len(own))
        runs.append((int(bucket[a]), np.int64(len(own)).tobytes() + zstandard.compress(size.tobytes() + b"".join(own), 1)))
    return rows_of(runs)


def _words(run: bytes) -> list[bytes]:
    n, data = int(np.frombuffer(run, np.int64, 1)[0]), zstandard.decompress(run[8:])
    ends = np.cumsum(np.frombuffer(data, np.uint32, n)) + 4 * n
    return [data[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist())]


def dictionary(rows: DataFrame, folder: str, vocabulary: str, bucket_bytes: int = BUCKET_BYTES, file_words: int = FILE_WORDS) -> Dictionary:
    """Merges each distinct word of the texts once. Buckets follow the input's bytes, files the number of words."""
    uri = scratch(rows.sparkSession, "bpe")
    bits = (text_bytes(rows) // bucket_bytes).bit_length()

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        for rb in chunks(batches, "text", PIECE_BYTES):
            _pretokens(rb.column(0), ids)
            if len(ids) > HELD_WORDS:
                yield _runs(list(ids), bits)
                ids.clear()
        if ids:
            yield _runs(list(ids), bits)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()

        def close():
            words = list(held)
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            order = np.argsort(h)
            alone = np.ones(len(h), bool)
            same = h[order[1:]] == h[order[:-1]]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            order = order[alone]
            tokens, each = replay([words[i] for i in order], ranks(folder, vocabulary))
            put(f"{uri}/parts/{last}", {"hash": h[order], "each": each.astype(np.uint32), "tokens": tokens.astype(np.int32)})
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([len(order)])], names=["bucket", "size"])

        for rb in batches:
            for b, run in zip(rb.column(0).to_pylist(), rb.column(1)):
                if held and b != last:
                    yield close()
                    held.clear()
                last = b
                held.update(_words(run.as_py()))
        if held:
            yield close()

    runs = rows.select("text").mapInArrow(gather, "bucket int, run binary").repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("bucket")
    size = staged(runs.mapInArrow(merge, "bucket int, size long"), "merged").agg(F.sum("size")).first()[0] or 0
    files = min(bits, (size // file_words).bit_length())
    each = 1 << (bits - files)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for f in rb.column(0).to_pylist():
                parts = [mapped(at)[0] for b in range(f * each, (f + 1) * each) if there(at := f"{uri}/parts/{b}")]
                sizes = np.concatenate([p["each"] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
                values = {"hash": np.concatenate([p["hash"] for p in parts]) if parts else np.zeros(0, np.uint64), "each": sizes.astype(np.uint32), "start": np.cumsum(sizes) - sizes}
                put(f"{uri}/words-{f}", values | {"tokens": np.concatenate([p["tokens"] for p in parts]) if parts else np.zeros(0, np.int32)})
            yield rb

    over(rows.sparkSession, 1 << files).mapInArrow(join, "id int").write.format("noop").mode("overwrite").save()
    return Dictionary(uri, files)


def decode_batch(tokens: np.ndarray, counts: np.ndarray, table: Ranks) -> pa.Array:
    """The bytes that each run of tokens stands for."""
    if len(tokens) and (tokens.min() < 0 or tokens.max() >= len(table.sizes)):
        raise ValueError("a token id is not in the vocabulary")
    data, size = expand(tokens, counts, table.sizes, table.data)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _batches(batches: Iterable[pa.RecordBatch], merged: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, codes, words per text, tokens of the words, tokens per word): the words of BATCH_BYTES of text together."""
    ids: dict[str, int] = {}
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

    def settled():
        tokens, each = merged(list(ids))
        for rb, codes, counts in held:
            yield rb, codes, counts, tokens, each
        ids.clear()
        held.clear()

    size = 0
    for rb in chunks(batches, "text", PIECE_BYTES):
        codes, counts = _pretokens(rb.column(1), ids)
        held.append((rb, codes.astype(np.int32), counts))
        size += rb.nbytes
        if size >= BATCH_BYTES:
            yield from settled()
            size = 0
    if held:
        yield from settled()


def bpe_encode(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, bucket_bytes: int = BUCKET_BYTES, file_words: int = FILE_WORDS) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) for every row; round_trip: decoding gives the text again."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = dictionary(rows, folder, vocabulary, bucket_bytes, file_words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(folder, vocabulary)
        for rb, codes, counts, tokens, each in _batches(batches, lambda words: known.tokens(words, table)):
            texts = rb.column(1)
            tokens, counts = expand(codes, counts, each, tokens)
            same = pc.equal(decode_batch(tokens, counts, table), texts.cast(pa.large_string()).cast(pa.large_binary()))
            offsets = np.concatenate([[0], np.cumsum(counts)])
            null = texts.is_null().to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens.astype(np.int32)), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(counts, pa.int64(), mask=null), lists, same], names=["doc_id", "n_tokens", "tokens", "round_trip"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, tokens array<int>, round_trip boolean")


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for every row, null for a null text.

    Only numbers leave a task, so each merges the words of its own texts: there is nothing to join back.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(folder, vocabulary)
        for rb, codes, counts, _, each in _batches(batches, lambda words: replay([w.encode("utf-8", "surrogatepass") for w in words], table)):
            n = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=each[codes], minlength=len(counts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(n, mask=rb.column(1).is_null().to_numpy(zero_copy_only=False))], names=["doc_id", "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def bpe_decode(encoded: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens): null tokens give a null text."""
    rows = pick(encoded, "doc_id", "tokens").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("array<int>").alias("tokens"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(folder, vocabulary)
        for rb in batches:
            lists = rb.column(1)
            counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data = decode_batch(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts, table)
            texts = [None if null else b.decode("utf-8", "replace") for b, null in zip(data.to_pylist(), lists.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")
