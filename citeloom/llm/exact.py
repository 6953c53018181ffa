"""Exact dedup by distributed most-significant-digit radix partitioning.

The first digits (byte length, then the first bytes) route every document to a task; a route
that would be too heavy for one task is split by further bytes, round after round, before
anything moves; documents of such a route that end there are equal, and are counted where they lie,
so that copies of one text without number meet in no task. The text is shuffled once. Inside a task the split goes on over successive bytes,
with digits that double in width, until each group is a singleton or its documents have ended.
Equality is decided on the bytes themselves; no digest is taken.

Defined results: a null text is never a copy (first_id is its own doc_id, copies 1); empty texts
are copies of each other; rows repeated with the same doc_id are copies and each is returned;
a null doc_id counts in copies but never is first_id unless its whole group has none. Texts are
compared whole, however long. An empty table gives no rows. ids are integers; other columns may have
any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import pick, positional, staged

FIRST_DIGITS = 64
TASK_BYTES = 256 << 20
HELD_BYTES = 32 << 20


def radix_classes(texts: list[bytes]) -> list[list[int]]:
    """Positions grouped by equal text, split by successive digits of 8, 16, 32 ... bytes."""
    done: list[list[int]] = []
    todo = [(list(range(len(texts))), 0, 8)]
    while todo:
        group, at, width = todo.pop()
        if len(group) == 1:
            done.append(group)
            continue
        digit: dict[bytes, list[int]] = {}
        for i in group:
            digit.setdefault(texts[i][at : at + width], []).append(i)
        for d, sub in digit.items():
            if len(d) < width:  # the texts end within this digit
                done.append(sub)
            else:
                todo.append((sub, at + width, width * 2))
    return done


class _Group:
    """Documents of one route, as classes of equal text; one text is held for each class."""

    def __init__(self, merge: Callable[[list], list]) -> None:
        self.texts: list[bytes] = []
        self.rows: list[list] = []
        self.merge, self.held, self.limit = merge, 0, HELD_BYTES

    def add(self, text: bytes, row) -> None:
        self.texts.append(text)
        self.rows.append([row])
        self.held += len(text) + 64
        if self.held > self.limit:
            self.settle()
            self.limit = max(HELD_BYTES, 2 * self.held)

    def settle(self) -> list[list]:
        parts = radix_classes(self.texts)
        self.rows = [self.merge([r for i in p for r in self.rows[i]]) for p in parts]
        self.texts = [self.texts[p[0]] for p in parts]
        self.held = sum(map(len, self.texts)) + 64 * len(self.texts)
        return self.rows


def _routed(rows: DataFrame, text: str, spread: str, task_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """rows with __len and __route, exchanged by them and sorted; a null text goes by spread.

    Routes that are too heavy for one task are split by further bytes. Where such a route has come to
    the end of its documents, they are all equal and need not meet: these rows are the second result.
    """
    data, names = F.col(text).cast("binary"), rows.columns
    rows = rows.withColumn("__len", F.octet_length(text).cast("long"))
    rows = rows.withColumn("__route", F.coalesce(F.substring(data, 1, FIRST_DIGITS), F.col(spread).cast("string").cast("binary"), F.lit(b"")))
    # At most (all bytes / task_bytes) routes are heavy, however large the input is; the table of them is
    # joined, so Catalyst broadcasts it only while it is small.
    hot = lambda d: d.groupBy("__len", "__route").agg(F.sum(F.col("__len") + 64).alias("__bytes")).filter(F.col("__bytes") > task_bytes).select("__len", "__route")
    width, ended = FIRST_DIGITS, []
    heavy = staged(hot(rows.filter(F.col("__len").isNotNull()).select("__len", "__route")), "routes")
    while not heavy.isEmpty():
        ended.append(heavy.filter(F.col("__len") <= width))
        width *= 8
        longer = heavy.filter(F.col("__len") > width // 8).withColumn("__split", F.lit(True))
        if longer.isEmpty():
            break
        rows = rows.join(longer, ["__len", "__route"], "left").withColumn("__route", F.when(F.col("__split"), F.substring(data, 1, width)).otherwise(F.col("__route")))
        heavy = staged(hot(rows.filter("__split").select("__len", "__route")), "routes")
        rows = rows.drop("__split")
    equal = None
    if ended:
        done = reduce(DataFrame.union, ended).withColumn("__ended", F.lit(True))
        rows = rows.join(done, ["__len", "__route"], "left")
        equal, rows = rows.filter("__ended"), rows.filter(F.col("__ended").isNull())
        equal = equal.select(*names, "__len", "__route")
    return rows.select(*names, "__len", "__route").repartition("__len", "__route").sortWithinPartitions("__len", "__route"), equal


def _runs(batches: Iterable[pa.RecordBatch], text: str, row: Callable, merge: Callable, finish: Callable, alone: Callable, flush: Callable) -> Iterator[pa.RecordBatch]:
    """Feeds the classes of each route to finish, and texts that are alone to alone(batch, row)."""
    group, last, held = None, None, None  # held: a route's first row, until a second one is seen

    def close() -> None:
        if group is not None:
            finish(group.settle())
        elif held is not None:
            alone(*held)

    for rb in batches:
        at = {n: i for i, n in enumerate(rb.schema.names)}
        lens, routes, texts = rb.column(at["__len"]).to_pylist(), rb.column(at["__route"]).to_pylist(), rb.column(at[text])
        for i, key in enumerate(zip(lens, routes)):
            if lens[i] is None:
                alone(rb, i)
            elif key == last:
                if group is None:
                    group = _Group(merge)
                    group.add(_bytes(held[0].column(at[text])[held[1]]), row(*held))
                group.add(_bytes(texts[i]), row(rb, i))
            else:
                close()
                group, held, last = None, (rb, i), key
        yield from flush()
    close()
    yield from flush()


def _bytes(x: pa.Scalar) -> bytes:
    v = x.as_py()
    return v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v


def exact_groups(docs: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(doc_id, first_id, copies) for every row: the least doc_id and the number of equal texts."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "first_id", "copies")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])

        def ids(rb, i):
            return rb.column(0)[i].as_py()

        def add(named):
            first = min((x for x in named if x is not None), default=None)
            for a, v in zip(out, (named, [first] * len(named), [len(named)] * len(named))):
                a.extend(v)

        def flush():
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in out], names=schema.names)
                for a in out:
                    a.clear()

        yield from _runs(batches, "text", ids, list, lambda classes: [add(c) for c in classes], lambda rb, i: add([ids(rb, i)]), flush)

    routed, equal = _routed(rows, "text", "doc_id", task_bytes)
    found = routed.mapInArrow(run, schema)
    if equal is None:
        return found
    # Their route is their whole text: partial sums and a join with the few such texts.
    first = staged(equal.groupBy("__len", "__route").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "equal")
    return found.union(equal.select("doc_id", "__len", "__route").join(first, ["__len", "__route"]).select("doc_id", "first_id", "copies"))


def exact_dedup(docs: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """docs with one row of each group of equal texts: the one with the least doc_id (nulls last).

    All columns are kept, whatever their names. Rows with a null text are all kept.
    """
    cols = docs.columns
    text, key = f"_{cols.index('text')}", f"_{cols.index('doc_id')}"
    rows = positional(docs)
    schema = rows.schema
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: dict[int, tuple[pa.RecordBatch, list[int]]] = {}

        def alone(rb, i):
            keep.setdefault(id(rb), (rb, []))[1].append(i)

        def row(rb, i):
            x = rb.column(names.index(key))[i].as_py()
            return (x is None, x or 0), rb.take(pa.array([i]))

        def flush():
            for rb, kept in keep.values():
                yield rb.select(names).take(pa.array(kept, pa.int64()))
            keep.clear()

        yield from _runs(batches, text, row, lambda rows: [min(rows, key=lambda r: r[0])], lambda classes: [alone(c[0][1], 0) for c in classes], alone, flush)

    routed, equal = _routed(rows, text, key, task_bytes)
    found = routed.mapInArrow(run, schema)
    if equal is not None:
        order = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"))
        found = found.union(equal.groupBy("__len", "__route").agg(F.min_by(F.struct(*names), order).alias("r")).select("r.*"))
    return found.toDF(*cols)
