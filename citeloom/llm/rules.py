"""Quality rules from tokeniser fertility.

Two public vocabularies measure each document: characters per byte-level BPE token, characters
per piece and the share of byte-fallback pieces of a piece vocabulary, and the entropy of the
document's tokens over the most that its length allows. Per language (the script, where lang is
null) a band is laid around the median of all documents: reach times the distance to the
quartiles, wider for short documents, whose means scatter more. Outside its band a document is
rejected. White space itself is not encoded; each word is, with one space before it.

Defined results: a null, empty or blank text is rejected as 'empty' and has null measures. A
language with fewer than least documents is judged by the band of all documents in its script, and
where these are fewer too, of all documents. Rows repeated are
measured each. A null doc_id stays null. Ties cannot arise: each row is judged on its own. Texts are
taken whole, however long. An empty table gives no rows. ids are integers; other columns may have any
names.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.common import chunks, expand, pick, pieces, positional, staged

TOKENIZERS = "/opt/tokenizers"
REACH = 4.0
LEAST = 30
SHORT = 200
MEASURES = ("chars_per_token", "chars_per_piece", "byte_fallback_share", "token_entropy")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def byte_bpe(folder: str):
    import tiktoken

    with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def piece_bpe(folder: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, "piece_bpe_32k.model"))
    return model, np.array([model.is_byte(i) for i in range(model.vocab_size())])


def script(text: str) -> str:
    """The script of most letters, by the first word of their Unicode names."""
    names = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            names[unicodedata.name(c, "UNKNOWN").split()[0].lower()] += n
    return min(names, key=lambda k: (-names[k], k)) if names else "none"


def measure(texts: pa.Array, folder: str) -> dict[str, np.ndarray]:
    """The four measures (NaN without words) and the number of tokens, per text."""
    codes, strings, counts = pieces(texts)
    docs = np.repeat(np.arange(len(counts)), counts)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    bpe, (model, is_byte) = byte_bpe(folder), piece_bpe(folder)
    tokens = [bpe.encode_ordinary(" " + s) for s in strings]
    n_tokens = np.fromiter(map(len, tokens), np.int64, len(tokens))
    split = model.encode(strings, num_threads=1) if strings else []
    n_pieces = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((i for p in split for i in p), np.int64, int(n_pieces.sum()))
    n_bytes = np.bincount(np.repeat(np.arange(len(split)), n_pieces), weights=is_byte[flat], minlength=len(split))
    per = lambda x: np.bincount(docs, weights=x[codes], minlength=len(counts))
    chars, total, whole = per(size + 1), per(n_tokens), per(n_pieces)
    ids, own = expand(codes, counts, n_tokens, np.fromiter((i for t in tokens for i in t), np.int64, int(n_tokens.sum())))
    key, times = np.unique(np.repeat(np.arange(len(counts)), own) << 20 | ids, return_counts=True)
    plogp = np.bincount(key >> 20, weights=times * np.log2(times), minlength=len(counts))
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.where(total > 1, (np.log2(total) - plogp / total) / np.log2(total), np.where(total == 1, 1.0, np.nan))
        return {"chars_per_token": chars / total, "chars_per_piece": chars / whole, "byte_fallback_share": per(n_bytes) / whole, "token_entropy": entropy, "tokens": total}


def _measured(rows: DataFrame, text: str, lang: str, folder: str) -> DataFrame:
    """rows with __group, __script, the measures and __tokens."""
    added = [T.StructField("__group", T.StringType()), T.StructField("__script", T.StringType()), *[T.StructField(f"__{m}", T.DoubleType()) for m in MEASURES], T.StructField("__tokens", T.LongType())]
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in chunks(batches, text, 3 << 20):
            got = measure(rb.column(names.index(text)), folder)
            scripts = [script(t.as_py() or "") for t in rb.column(names.index(text))]
            groups = [g if g is not None else k for g, k in zip(rb.column(names.index(lang)).to_pylist(), scripts)]
            values = [pa.array(got[m], pa.float64(), mask=np.isnan(got[m])) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(groups, pa.string()), pa.array(scripts, pa.string()), *values, pa.array(got["tokens"].astype(np.int64))], names=[*names, *[f.name for f in added]])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))


def bands(measured: DataFrame, by: str = "__group") -> DataFrame:
    """Per group the number of documents, the median and the quantiles about it of each measure, over all documents."""
    at = "array(0.25D, 0.5D, 0.75D)"
    quantiles = [F.expr(f"percentile_approx(__{m}, {at}, 2000)").alias(f"__q_{m}") for m in MEASURES]
    return measured.filter("__tokens > 0").groupBy(by).agg(F.count("*").alias("__n"), *quantiles)


def _banded(measured: DataFrame, least: int) -> DataFrame:
    """measured with __band and the quantiles of that band: the language's, else the script's, else that of all."""
    out = measured
    every = ["__tokens", *[f"__{m}" for m in MEASURES]]
    for by in ("__group", "__script"):
        limits = bands(measured.select(by, *every), by).filter(F.col("__n") >= least)
        # One row a language or script: the size doesn't follow the number of documents.
        out = out.join(F.broadcast(limits.select(by, F.struct(F.col(by).alias("band"), *[f"__q_{m}" for m in MEASURES]).alias(f"_{by}"))), by, "left")
    # The band of all documents is one row: literals, no join.
    one = bands(measured.select(F.lit("all").alias("__all"), *every), "__all").first()
    values = [F.array(*map(F.lit, one[f"__q_{m}"])) if one and one[f"__q_{m}"] else F.lit(None).cast("array<double>") for m in MEASURES]
    rest = F.struct(F.lit("all" if one else None).cast("string").alias("band"), *[v.cast("array<double>").alias(f"__q_{m}") for v, m in zip(values, MEASURES)])
    limits = F.coalesce("___group", "___script", rest)
    return out.withColumns({"__band": limits["band"], **{f"__q_{m}": limits[f"__q_{m}"] for m in MEASURES}})


def _reason(reach: float) -> Column:
    """The first rule that rejects, null if none does."""
    out = F.when(F.col("__tokens") == 0, "empty")
    wider = F.sqrt(1 + F.lit(float(SHORT)) / F.col("__tokens"))
    for m in MEASURES:
        x, q = F.col(f"__{m}"), F.col(f"__q_{m}")
        # A measure that hardly varies still gets a band: 1.5 % of its median or 0.01 count at least.
        slack = F.greatest(F.abs(q[1]) * 0.015, F.lit(0.01))
        low, high = (F.greatest(a, slack) * reach * wider for a in (q[1] - q[0], q[2] - q[1]))
        if m != "byte_fallback_share":
            out = out.when(x < q[1] - low, f"{m} low")
        if m != "token_entropy":  # every token another is no fault
            out = out.when(x > q[1] + high, f"{m} high")
    return out


def _judged(rows: DataFrame, text: str, lang: str, folder: str, reach: float, least: int) -> DataFrame:
    measured = staged(_measured(rows, text, lang, folder), "rules")
    return _banded(measured, least).withColumn("__reason", _reason(reach))


def quality_rules(docs: DataFrame, folder: str = TOKENIZERS, reach: float = REACH, least: int = LEAST) -> DataFrame:
    """(doc_id, band, tokens, the four measures, keep, reason) for every row."""
    rows = positional(pick(docs, "doc_id", "lang", "text"))
    rows = rows.select(F.col("_0").cast("long").alias("_0"), "_1", "_2")
    measured = _measured(rows, "_2", "_1", folder).drop("_2")
    measured = staged(measured, "rules")
    out = _banded(measured, least).withColumn("__reason", _reason(reach))
    return out.select(F.col("_0").alias("doc_id"), F.coalesce("__band", "__group").alias("band"), F.col("__tokens").alias("tokens"), *[F.col(f"__{m}").alias(m) for m in MEASURES], F.col("__reason").isNull().alias("keep"), F.col("__reason").alias("reason"))


def quality_filter(docs: DataFrame, folder: str = TOKENIZERS, reach: float = REACH, least: int = LEAST) -> DataFrame:
    """docs without the rows that the rules reject, with all columns as they were."""
    cols = docs.columns
    rows = positional(docs)
    kept = _judged(rows, f"_{cols.index('text')}", f"_{cols.index('lang')}", folder, reach, least).filter(F.col("__reason").isNull())
    return kept.select(*rows.columns).toDF(*cols)
