"""Best-two-fit packing of documents into training sequences.

Documents are spread over shards by a hash of their doc_id, so that many tasks pack at once and
only (doc_id, length) moves, never the text. A document's length is the number of its byte-level BPE
tokens; with bytes_per_token it is estimated as its UTF-8 bytes over that, rounded up. One longer than the capacity is cut into full pieces and a rest.

In a shard, a bin is filled greedily (always the longest unpacked piece that fits). When nothing
fits any more, its smallest piece is replaced by two unpacked pieces that fit the expanded gap
more tightly than it did, if there are such two.

Defined results: a null text and an empty one have no length and are in no bin; rows repeated
with one doc_id are packed each (copy numbers them); a null doc_id is packed like any other. Ties
of length go by doc_id (nulls first), copy and piece. However long a text is, all of it is packed. An
empty table gives no rows. ids are integers; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.bpe import TOKENIZERS, token_counts
from citeloom.llm.common import pick, staged

CAPACITY = 2048
SHARD_PIECES = 1 << 15
SCHEMA = "doc_id long, copy long, piece int, length int, bin long, slot int, start int"


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of lengths (each 1 to capacity), every one of them used once."""
    left = np.bincount(lengths, minlength=capacity + 1)
    # below[x]: the greatest length up to x of which a piece is left, 0 if none.
    below = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))

    def take(x: int) -> None:
        left[x] -= 1
        if not left[x]:
            y = below[x - 1]
            end = x + 1 + int(np.argmax(below[x + 1 :] != x)) if below[-1] != x else capacity + 1
            below[x:end] = y

    def give(x: int) -> None:
        left[x] += 1
        if left[x] == 1:
            part = below[x:]
            end = int(np.searchsorted(part, x, side="left"))
            part[:end] = x

    bins = []
    while below[capacity]:
        held, gap = [], capacity
        while gap and (x := int(below[gap])):
            take(x)
            held.append(x)
            gap -= x
        if gap and len(held) > 1:
            small = held[-1]  # pieces were taken from long to short
            room = gap + small
            a = np.flatnonzero(left[: room + 1])
            if len(a):
                b = below[np.minimum(room - a, a)].copy()
                twice = (b == a) & (left[a] < 2)
                b[twice] = below[a[twice] - 1]
                both = np.where(b > 0, a + b, 0)
                k = len(both) - 1 - int(np.argmax(both[::-1]))  # of equally tight pairs that with the least piece
                if both[k] > small:
                    held.pop()
                    take(int(a[k]))
                    take(int(b[k]))
                    give(small)
                    held += [int(a[k]), int(b[k])]
        bins.append(held)
    return bins


def pack(docs: DataFrame, capacity: int = CAPACITY, bytes_per_token: int | None = None, shard_pieces: int = SHARD_PIECES, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, copy, piece, length, bin, slot, start): where each piece of each document goes."""
    if bytes_per_token is None:
        rows = staged(token_counts(docs, folder).withColumnRenamed("n_tokens", "n"), "lengths")
    else:
        rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.ceil(F.octet_length("text") / F.lit(bytes_per_token)).cast("long").alias("n"))
    rows = rows.filter("n > 0")
    total = rows.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    # A doc_id that repeats without end, or null ones, would fill one shard: where one has more pieces than
    # a shard should, its rows are dealt one by one, and copy tells the shard too.
    hot = rows.groupBy("doc_id").agg(F.sum(F.ceil(F.col("n") / capacity)).alias("pieces"), F.count("*").alias("rows")).filter((F.col("pieces") > shard_pieces) & (F.col("rows") > 1))
    hot = staged(hot.select(F.coalesce(F.col("doc_id"), F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__null")), "hot")
    many = rows.join(hot, (F.coalesce(F.col("doc_id"), F.lit(0)) == F.col("__id")) & (F.col("doc_id").isNull() == F.col("__null")), "left")
    spread = F.col("__null").isNotNull()
    salt = F.when(spread, F.monotonically_increasing_id()).otherwise(F.lit(0))
    keyed = many.withColumn("shard", F.pmod(F.xxhash64("doc_id", salt), F.lit(shards)).cast("long")).withColumn("spread", spread)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(shard, ids, known, n, dealt):
            order = np.lexsort((n, ids, known))
            ids, known, n, dealt = ids[order], known[order], n[order], dealt[order]
            same = np.concatenate([[False], (ids[1:] == ids[:-1]) & (known[1:] == known[:-1])])
            at = np.arange(len(n))
            copy = at - np.maximum.accumulate(np.where(same, 0, at))
            copy = np.where(dealt, copy * shards + shard, copy)
            count = -(-n // capacity)
            doc = np.repeat(at, count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            length = np.minimum(capacity, n[doc] - piece * capacity)
            by = np.lexsort((piece, copy[doc], ids[doc], known[doc], length))
            first = np.searchsorted(length[by], np.arange(capacity + 2))
            used, out = np.zeros(capacity + 2, np.int64), []
            for b, held in enumerate(best_two_fit(length, capacity)):
                start = 0
                for slot, x in enumerate(held):
                    out.append((by[first[x] + used[x]], b, slot, start))
                    used[x] += 1
                    start += x
            k, b, slot, start = np.array(out, dtype=np.int64).T
            columns = [pa.array(ids[doc[k]], pa.int64(), mask=~known[doc[k]]), copy[doc[k]], piece[k], length[k], (shard << 32) + b, slot, start]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "copy", "piece", "length", "bin", "slot", "start"])

        held: list[tuple] = []
        last = None
        for rb in batches:
            shard = rb.column(0).to_numpy()
            ids = rb.column(1)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids, n, dealt = ids.fill_null(0).to_numpy(), rb.column(2).to_numpy(), rb.column(3).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and shard[a] != last:
                    yield packed(int(last), *map(np.concatenate, zip(*held)))
                    held = []
                held.append((ids[a:b], known[a:b], n[a:b], dealt[a:b]))
                last = shard[a]
        if held:
            yield packed(int(last), *map(np.concatenate, zip(*held)))

    return keyed.select("shard", "doc_id", "n", "spread").repartition("shard").sortWithinPartitions("shard").mapInArrow(run, SCHEMA)
