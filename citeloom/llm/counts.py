"""Corpus counts at scale: compressed sorted runs, a mapped vocabulary, files in the shared folder.

Tasks count what they hold, sort it, and send one compressed run for each bucket; a bucket's task
merges its runs. What moves is a few bytes for each distinct key, and every bucket fits in memory,
as their number follows the input's bytes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import chunks, hashed, staged, words

_CODEC = pa.Codec("zstd", compression_level=1)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, the first of them sorted: its gaps, and all by planes of bytes."""
    parts = []
    for i, a in enumerate(arrays):
        if i == 0 and len(a):
            a = np.concatenate([a[:1], np.diff(a)])
        raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
        packed = _CODEC.compress(raw, asbytes=True)
        parts.append(np.array([len(a), a.itemsize, len(packed)], np.int64).tobytes() + packed)
    return b"".join(parts)


def unsqueeze(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, size, length = np.frombuffer(data, np.int64, 3, at)
        raw = _CODEC.decompress(data[at + 24 : at + 24 + length], int(n * size), asbytes=True)
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(f"u{size}")
        out.append(np.cumsum(a, dtype=a.dtype) if not out else a)
        at += 24 + int(length)
    return out


def put(uri: str, arrays: dict[str, np.ndarray], **about) -> None:
    """One file with named arrays, each at a multiple of 64 bytes; it appears whole or not at all."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    at, where = 0, {}
    for k, a in arrays.items():
        where[k] = (at, len(a), a.dtype.str)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps({"arrays": where, "about": about}).encode()
    size = -(-(len(head) + 8) // 64) * 64
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(np.int64(size).tobytes() + head.ljust(size - 8))
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0"))
    store.move(part, path)


@lru_cache(maxsize=512)
def mapped(uri: str) -> tuple[dict[str, np.ndarray], dict]:
    """The arrays of a file, mapped where the folder is mounted, else read."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with store.open_input_file(path) as f:
            raw = np.frombuffer(f.readall(), np.uint8)
    size = int(raw[:8].view(np.int64)[0])
    head = json.loads(bytes(raw[8:size]))
    return {k: raw[size + at : size + at + n * np.dtype(t).itemsize].view(t) for k, (at, n, t) in head["arrays"].items()}, head["about"]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


def text_bytes(rows: DataFrame, text: str = "text") -> int:
    return rows.agg(F.sum(F.octet_length(text))).first()[0] or 0


def rows_of(runs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in runs], pa.int32()), pa.array([d for _, d in runs], pa.large_binary()).cast(pa.binary())], names=["bucket", "run"])


def by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    """Runs of each bucket, from batches sorted by bucket."""
    last, held = None, []
    for rb in batches:
        for b, run in zip(rb.column(0).to_pylist(), rb.column(1)):
            if held and b != last:
                yield last, held
                held = []
            last = b
            held.append(unsqueeze(run.as_py()))
    if held:
        yield last, held


def there(uri: str) -> bool:
    store, path = fs.FileSystem.from_uri(uri)
    return store.get_file_info(path).type == fs.FileType.File


@dataclass(frozen=True)
class Vocabulary:
    """Words of at least least occurrences, by the order of their hashes; word 0 is all others.

    Each file has the hashes, their counts, and each word's rank by count among those of the file.
    """

    uri: str
    bits: int
    first: tuple[int, ...]
    size: int
    total: int
    other: int

    def bucket_uri(self, b: int) -> str:
        return f"{self.uri}/words-{b}"

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        which = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for b in np.unique(which):
            own = np.flatnonzero(which == b)
            known = mapped(self.bucket_uri(b))[0]["hash"]
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[own]), len(known) - 1)
                out[own] = np.where(known[at] == hashes[own], at + 1 + self.first[b], 0)
        return out

    def bucket_of(self, ids: np.ndarray) -> np.ndarray:
        """The bucket of each id from 1 on."""
        return np.searchsorted(np.asarray(self.first), ids - 1, side="right") - 1

    def gather(self, name: str, ids: np.ndarray, other: float, dtype=np.float64, folder: str | None = None) -> np.ndarray:
        """Values of an array that is kept beside the words, by id."""
        out = np.full(len(ids), other, dtype)
        known = np.flatnonzero(ids > 0)
        which = self.bucket_of(ids[known])
        for b in np.unique(which):
            own = known[which == b]
            out[own] = mapped(f"{folder or self.uri}/words-{b}")[0][name][ids[own] - 1 - self.first[b]]
        return out


def vocabulary(rows: DataFrame, text: str, uri: str, least: int, bucket_bytes: int = 64 << 20, file_words: int = 4 << 20, least_bits: int = 0) -> Vocabulary:
    """Counts all words of all texts and keeps those of at least least in files under uri.

    The buckets that are counted follow the bytes of the input, the files that are searched later (at
    least 2 ** least_bits) the number of distinct words, so that a reader opens few of them.
    """
    bits = max(least_bits, (max(1, text_bytes(rows, text)) // bucket_bytes).bit_length())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send():
            keys, n = summed(*map(np.concatenate, zip(*held)))
            cut = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
            ends = [*cut[1:], len(keys)]
            return rows_of([(b, squeeze(keys[a:e], n[a:e].astype(np.uint32))) for b, (a, e) in enumerate(zip(cut, ends)) if e > a])

        for rb in chunks(batches, text):
            w = words(rb.column(0))
            held.append((hashed(w.names), np.bincount(w.codes, minlength=len(w.names)).astype(np.int64)))
            if sum(len(k) for k, _ in held) > 3_000_000:
                yield send()
                held.clear()
        if held:
            yield send()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, runs in by_bucket(batches):
            keys, n = summed(np.concatenate([r[0] for r in runs]), np.concatenate([r[1].astype(np.int64) for r in runs]))
            kept = n >= least
            put(f"{uri}/parts/{b}", {"run": np.frombuffer(squeeze(keys[kept], n[kept]), np.uint8)})
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([int(kept.sum())]), pa.array([int(n.sum())]), pa.array([int(n[~kept].sum())])], names=["bucket", "size", "total", "other"])

    runs = rows.select(text).mapInArrow(count, "bucket int, run binary")
    got = staged(runs.repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(merge, "bucket int, size long, total long, other long"), "counted")
    size, total, other = (x or 0 for x in got.agg(F.sum("size"), F.sum("total"), F.sum("other")).first())
    files = min(bits, max(least_bits, (size // file_words).bit_length()))
    each = 1 << (bits - files)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for f in rb.column(0).to_pylist():
                found = [unsqueeze(mapped(at)[0]["run"].tobytes()) for b in range(f * each, (f + 1) * each) if there(at := f"{uri}/parts/{b}")]
                found = [x for x in found if len(x[0])]
                keys = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.uint64)
                n = np.concatenate([x[1] for x in found]).view(np.int64) if found else np.zeros(0, np.int64)
                rank = np.empty(len(n), np.uint32)
                rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
                put(f"{uri}/words-{f}", {"hash": keys, "count": n, "rank": rank})
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([len(keys)])], names=["file", "size"])

    # One row a file of file_words words: their number follows the vocabulary, not the text.
    sizes = dict(over(rows.sparkSession, 1 << files).mapInArrow(join, "file int, size long").collect())
    first = tuple(int(x) for x in np.cumsum([0, *[sizes[f] for f in range((1 << files) - 1)]]))
    return Vocabulary(uri, files, first, size, total, other)


def over(spark: SparkSession, n: int) -> DataFrame:
    """The numbers below n, one in each of n partitions."""
    return spark.range(0, n, 1, n).select(F.col("id").cast("int"))


def word_ids(texts: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, text after text, and words per text."""
    w = words(texts)
    return vocab.ids(hashed(w.names))[w.codes], w.counts
