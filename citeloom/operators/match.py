"""Passage search: exact, then case-folded, then fuzzy; keyed by source or over a whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from citeloom.functions.fuzzy import fuzzy_match, search
from citeloom.functions.text import CONTEXT, col, lower, normalize, windows

MATCH = ("match_type", "norm_char_start", "norm_char_end", "matched_text", "context_before", "context_after", "similarity")
#: Characters of a source times passages up to which each passage is searched on its own.
SEARCHED = 50_000_000


def _located(df: DataFrame, source: str, passage: str) -> DataFrame:
    """With the columns of MATCH from normalised source and passage; null where neither search hits."""
    exact = F.instr(col(source), col(passage))
    folded = F.instr(lower(col(source)), lower(col(passage)))
    df = df.withColumn("__exact", exact).withColumn("__at", F.when(F.col("__exact") > 0, F.col("__exact")).otherwise(folded) - 1)
    start = F.when(F.col("__at") >= 0, F.col("__at"))
    end = start + F.char_length(passage)
    before, after = windows(source, start, end, CONTEXT)
    return df.withColumns({
        "match_type": F.when(F.col("__exact") > 0, "exact").when(start.isNotNull(), "normalized"), "norm_char_start": start.cast("int"), "norm_char_end": end.cast("int"),
        "matched_text": F.substring(col(source), start + 1, F.char_length(passage)), "context_before": before, "context_after": after, "similarity": F.when(start.isNotNull(), F.lit(1.0)),
    }).drop("__exact", "__at")


def _approximate(rows: DataFrame) -> DataFrame:
    """rows of (__s, __p) with the columns of MATCH from the approximate search."""
    rows = rows.withColumn("__f", fuzzy_match("__s", "__p"))
    start, end = F.col("__f.start"), F.col("__f.end")
    before, after = windows("__s", start, end, CONTEXT)
    return rows.withColumns({
        "match_type": F.when(start.isNotNull(), "fuzzy"), "norm_char_start": start, "norm_char_end": end, "matched_text": F.substring(F.col("__s"), start + 1, end - start),
        "context_before": before, "context_after": after, "similarity": F.col("__f.similarity"),
    }).drop("__f")


def locate(df: DataFrame, source: str, passage: str, fuzzy: bool = True) -> DataFrame:
    """Each row's passage in its own source. Python sees only rows that the two plain searches left."""
    # An empty passage is found nowhere; one of white space alone is, at the beginning.
    rows = df.withColumn("__s", normalize(source)).withColumn("__p", normalize(F.nullif(col(passage), F.lit(""))))
    rows = _located(rows, "__s", "__p")
    if not fuzzy:
        return rows.drop("__s", "__p")
    done = rows.filter(F.col("match_type").isNotNull())
    left = _approximate(rows.filter(F.col("match_type").isNull()))
    return done.unionByName(left).drop("__s", "__p")


def _fold(s: str) -> str:
    """As lower() of text does."""
    return s.replace("İ", "i").replace("Σ", "σ").lower()


def _firsts(text: str, wanted: list[str]) -> dict[str, int]:
    """Where each of the texts first stands; by an automaton, in one pass, where a search for each would cost more."""
    if len(text) * len(wanted) <= SEARCHED:
        return {p: at for p in wanted if (at := text.find(p)) >= 0}
    import ahocorasick

    out, automaton = ({"": 0} if "" in wanted else {}), ahocorasick.Automaton()
    for p in filter(None, wanted):
        automaton.add_word(p, p)
    automaton.make_automaton()
    for end, p in automaton.iter(text):
        out.setdefault(p, end + 1 - len(p))
    return out


def _found(source: str | None, passages: list[str | None], fuzzy: bool) -> Iterator[tuple]:
    """The columns of MATCH for each passage."""
    nothing = (None,) * len(MATCH)
    if source is None:
        yield from [nothing] * len(passages)
        return
    exact = _firsts(source, [p for p in dict.fromkeys(passages) if p is not None])
    left = list(dict.fromkeys(_fold(p) for p in passages if p is not None and p not in exact))
    folded = _firsts(_fold(source), left) if left else {}
    near: dict[str, tuple | None] = {}
    for p in passages:
        if p is None:
            yield nothing
            continue
        kind, start = ("exact", exact[p]) if p in exact else ("normalized", folded.get(_fold(p)))
        end, similarity = len(p) + (start or 0), 1.0
        if start is None:
            if fuzzy and p not in near:
                near[p] = search(source, p)
            if not near.get(p):
                yield nothing
                continue
            kind, (start, end, similarity) = "fuzzy", near[p]
        yield kind, start, end, source[start:end], source[max(0, start - CONTEXT) : start], source[end : end + CONTEXT], similarity


def _each(fuzzy: bool):
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64()]

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, from_arrow_type(k)) for n, k in zip(MATCH, kinds)])))
    def each(source: pa.Array, passages: pa.Array) -> pa.Array:
        rows, ends = [], [0]
        for s, ps in zip(source, passages):
            rows += _found(s.as_py(), ps.as_py() or [], fuzzy)
            ends.append(len(rows))
        cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, list(MATCH)))

    return each


def locate_each(df: DataFrame, source: str, passages: str, passage: str, fuzzy: bool = True) -> DataFrame:
    """locate() for sources with an array of structs of passages: a row for each of them, without the source.

    Each source is normalised, folded and sent to Python once, whatever the number of its passages.
    """
    rest = [n for n in df.columns if n not in (source, passages)]
    normal = F.transform(passages, lambda x: normalize(F.nullif(x[passage], F.lit(""))))
    rows = df.withColumn("__s", normalize(source)).withColumn("__p", normal)
    rows = rows.withColumn("__m", _each(fuzzy)("__s", "__p")).select(*rest, F.inline(F.arrays_zip(F.col(passages).alias("c"), F.col("__m").alias("m"))))
    return rows.select(*rest, "c.*", "m.*")


def _keys(words: Column) -> Column:
    """Hashes of each word, each two and each three words in a row."""
    # Slices side by side: looking words up one by one would split the text once for each of them.
    rest = lambda k: F.slice(words, k, F.greatest(F.size(words) - (k - 1), F.lit(0)))
    one = F.transform(words, lambda x: F.xxhash64(x))
    two = F.zip_with(words, rest(2), lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y)))
    three = F.transform(F.arrays_zip(words.alias("x"), rest(2).alias("y"), rest(3).alias("z")), lambda r: F.when(r["z"].isNotNull(), F.xxhash64(r["x"], r["y"], r["z"])))
    return F.struct(one.alias("one"), two.alias("two"), three.alias("three"))


def _inner(words: Column) -> Column:
    """The key of a passage: up to three words in its middle, as the words at its ends may be cut. None below three words."""
    n, at = F.size(words), lambda i: F.get(words, F.lit(i))
    return F.when(n >= 5, F.xxhash64(at(1), at(2), at(3))).when(n == 4, F.xxhash64(at(1), at(2))).when(n == 3, F.xxhash64(at(1)))


def _scanned(short: DataFrame, sources: DataFrame, block: int = 20_000) -> DataFrame:
    """(__pid, __sid) of passages of one or two words, block by block of them, in one pass of an automaton over all sources."""
    found = None
    blocks = -(-short.count() // block)
    for k in range(blocks):
        part = short.filter(F.pmod(F.xxhash64("__pid", "__p"), F.lit(blocks)) == k).select("__pid", lower("__p")).collect()

        def run(batches, part=part):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            ids: dict[str, list] = {}
            for pid, p in part:
                ids.setdefault(p, []).append(pid)
            for p, own in ids.items():
                automaton.add_word(p, own)
            if ids:
                automaton.make_automaton()
            for rb in batches:
                hits = [(pid, sid) for sid, s in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()) if s and ids for pid in {x for _, own in automaton.iter(s) for x in own}]
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], t) for k, t in ((0, kinds[0]), (1, kinds[1]))], names=["__pid", "__sid"])

        kinds = [to_arrow_type(short.schema["__pid"].dataType), to_arrow_type(sources.schema["__sid"].dataType)]
        hits = sources.select("__sid", lower("__s").alias("__s")).mapInArrow(run, T.StructType([T.StructField("__pid", short.schema["__pid"].dataType), T.StructField("__sid", sources.schema["__sid"].dataType)]))
        found = hits if found is None else found.unionByName(hits)
    return found


def search_corpus(passages: DataFrame, sources: DataFrame, passage_id: str, source_id: str, passage: str = "text", source: str = "text", fuzzy: bool = False) -> DataFrame:
    """(passage_id, source_id, MATCH) of every passage found in every source, exact or case-folded.

    Passages meet sources by a hash of one to three words from their middle; Catalyst broadcasts the
    passages' side only while it is small, and shuffles both by that hash beyond. Passages of one and two
    words have no whole word within, and are searched in blocks by an automaton that reads every source.
    With fuzzy, pairs that share three words at the passage's beginning or middle but have no such match
    are compared approximately; a passage of which no three such words are left is not found this way.
    """
    p = passages.select(F.col(passage_id).alias("__pid"), normalize(passage).alias("__p")).filter("__p <> ''").withColumn("__w", F.split(lower("__p"), " "))
    s = sources.select(F.col(source_id).alias("__sid"), normalize(source).alias("__s"))
    keys = s.select("__sid", _keys(F.split(lower("__s"), " ")).alias("k"))
    keys = keys.select("__sid", F.explode(F.array_distinct(F.array_compact(F.concat("k.one", "k.two", "k.three")))).alias("__g"))
    met = keys.join(p.select("__pid", _inner(F.col("__w")).alias("__g")).filter("__g is not null"), "__g").select("__pid", "__sid").distinct()
    short = _scanned(p.filter(F.size("__w") < 3).select("__pid", "__p"), s)
    if short is not None:
        met = met.unionByName(short)
    both = met.join(p.select("__pid", "__p"), "__pid").join(s, "__sid").select("__pid", "__p", "__sid", "__s")
    found = _located(both, "__s", "__p").filter("match_type is not null")
    if fuzzy:
        n, at = F.size("__w"), lambda i: F.slice("__w", i + 1, F.lit(3))
        anchor = lambda a: F.xxhash64(F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(a, F.lit(2)))
        anchors = F.array_compact(F.array(F.when(n >= 3, anchor(at(F.lit(0)))), F.when(n >= 6, anchor(at(F.floor(n / 2).cast("int"))))))
        close = keys.join(p.select("__pid", F.explode(anchors).alias("__g")), "__g").select("__pid", "__sid").distinct()
        close = close.join(found.select("__pid", "__sid"), ["__pid", "__sid"], "left_anti").join(p.select("__pid", "__p"), "__pid").join(s, "__sid")
        close = _approximate(close.select("__pid", "__p", "__sid", "__s")).filter("match_type is not null")
        found = found.select("__pid", "__sid", *MATCH).unionByName(close.select("__pid", "__sid", *MATCH))
    return found.select(F.col("__pid").alias(passage_id), F.col("__sid").alias(source_id), *MATCH)
