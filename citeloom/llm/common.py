"""What the operators share: column picking, scratch tables and vectorised word splitting."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
_scratch: list[tuple[SparkSession, str]] = []
_fallback: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has Spark's 10,000: both sides hold a batch of whole texts.

    For the caller, who owns the session, to run once; the registered queries and the pipeline do.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def positional(df: DataFrame) -> DataFrame:
    """The same rows with the columns named _0, _1, ...: no name of the caller's can clash."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Columns by exact name, the first where a name repeats; everything else is pruned."""
    cols = df.columns
    return positional(df).select(*[F.col(f"_{cols.index(n)}").alias(n) for n in names])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the cluster's shared spark.checkpoint.dir; it goes when the driver ends.

    Only where the session names no such folder and is local (tests) is a temporary one used.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="citeloom-"))
        base = f"file://{_fallback[0]}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base:
        base = f"file://{base}" if base.startswith("/") else base
    at = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, at))
    return at


@atexit.register
def _clean() -> None:
    for spark, at in _scratch:
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may be gone already; the folder is the cluster's scratch space
            return


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and a lost executor costs nothing."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the bytes of a text column stay near limit (one row at least)."""
    for rb in batches:
        sizes = pc.binary_length(rb.column(rb.schema.get_field_index(column)))
        end = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < rb.num_rows:
            done = int(end[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(end, done + limit, side="right")))
            yield rb.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of some texts: codes into names, text after text; counts has the words per text."""

    codes: np.ndarray
    names: list[str]
    counts: np.ndarray

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def strings(texts: pa.Array) -> list[str]:
    # By way of numpy: Arrow's own list of Python strings takes eight times as long.
    return texts.to_numpy(zero_copy_only=False).tolist()


def _filled(codes: np.ndarray, names: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the empty pieces before or after white space at an end."""
    if "" not in names:
        return codes, counts
    gap = codes == names.index("")
    return codes[~gap], counts - np.bincount(np.repeat(np.arange(len(counts)), counts)[gap], minlength=len(counts))


def pieces(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """White-space-separated pieces: codes, their distinct strings, pieces per text (null: none)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    lists = pc.utf8_split_whitespace(texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), strings(coded.dictionary)
    codes, counts = _filled(codes, names, counts)
    return codes, names, counts


def expand(codes: np.ndarray, counts: np.ndarray, each: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replaces code c by its run of values (each[c] long, runs in code order); also per text."""
    starts = np.concatenate([[0], np.cumsum(each)[:-1]]) if len(each) else np.zeros(0, np.int64)
    n = each[codes] if len(codes) else np.zeros(0, np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) - np.repeat(ends - n, n) + np.repeat(starts[codes] if len(codes) else n, n)
    docs = np.repeat(np.arange(len(counts)), counts)
    return values[at] if total else values[:0], np.bincount(docs, weights=n, minlength=len(counts)).astype(np.int64)


def words(texts: pa.Array, marks: bool = False, lower: bool = True) -> Words:
    """Runs of letters, digits and _ (as regex \\w+) of each text, and with marks, runs of marks too.

    All of it is done by Arrow: Python sees the distinct words of a batch only.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if lower:
        texts = pc.utf8_lower(texts)
    texts = pc.replace_substring_regex(texts, r"([^\pL\pN_\s]+)", r" \1 " if marks else " ")
    lists = pc.utf8_split_whitespace(texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), strings(coded.dictionary)
    codes, counts = _filled(codes, names, counts)
    return Words(codes, names, counts)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-mixed 64-bit function of 64-bit values."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def hashed(names: list[str]) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
