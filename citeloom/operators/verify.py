"""Verification of citations, with their sources or without."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.relation import badge, conformance_level
from citeloom.functions.text import blank, fingerprint
from citeloom.operators.match import locate, locate_each


def offline_status(valid: Column) -> Column:
    return F.when(F.coalesce(valid, F.lit(False)), "verified").otherwise("hash_mismatch")


def online_status(fetchable: Column, text: Column, error: Column, match_type: Column, recomputed: Column, claimed: Column, valid: Column) -> Column:
    """The first rule that applies."""
    return (
        F.when(~fetchable, "insufficient_metadata")
        .when(~blank(error) | blank(text), "source_unavailable")
        .when(match_type.isNull(), "passage_not_found")
        .when((recomputed == claimed) & valid, "verified")
        .when(valid & match_type.isin("exact", "normalized"), "passage_verified")
        .otherwise("hash_mismatch")
    )


def _warnings(fetchable: Column, level: Column, match_type: Column, status: Column, offline: bool) -> Column:
    c = F.col
    out = [F.when((c("captured_by") == "model") & blank("archive_url"), "model-captured without an archived copy")]
    if offline:
        out.append(F.when(level == 1, "level 1: context or a link is missing"))
    else:
        out += [F.when(~fetchable, "no address to fetch"), F.when(status == "passage_not_found", "passage not found in the source"), F.when(match_type == "fuzzy", "found only approximately"), F.when(match_type.isin("exact", "normalized") & ~c("source_hash_valid"), "context differs from the source")]
    return F.array_compact(F.array(*out))


def _prepared(citations: DataFrame) -> DataFrame:
    """With the columns of a citation that are missing, internal_hash_valid and conformance_level."""
    c = F.col
    has = set(citations.columns)
    missing = [n for n in ("text_before", "text_after", "doi", "url", "archive_url", "fragment_url", "captured_by", "source_text", "fetch_error") if n not in has]
    rows = citations.withColumns({n: F.lit(None).cast("string") for n in missing})
    e = lambda n: F.coalesce(c(n), F.lit(""))
    level = conformance_level("text_before", "text_after", "doi", "url", "archive_url", "fragment_url")
    return rows.withColumn("internal_hash_valid", F.coalesce(c("hash") == fingerprint("text_exact", e("text_before"), e("text_after")), F.lit(False))).withColumn("conformance_level", level)


def _judged(rows: DataFrame) -> DataFrame:
    """Prepared citations, located in their sources, with the result of verification."""
    c = F.col
    fetchable = ~(blank("url") & blank("doi") & blank("archive_url"))
    rows = rows.withColumn("source_hash_recomputed", F.when(c("match_type").isNotNull(), fingerprint("matched_text", "context_before", "context_after")))
    rows = rows.withColumn("status", online_status(fetchable, c("source_text"), c("fetch_error"), c("match_type"), c("source_hash_recomputed"), c("hash"), c("internal_hash_valid")))
    consulted = c("status").isin("verified", "passage_verified", "hash_mismatch", "passage_not_found")
    rows = rows.withColumn("source_hash_valid", F.when(consulted & c("match_type").isNotNull(), c("source_hash_recomputed") == c("hash")))
    rows = rows.withColumn("warnings", _warnings(fetchable, c("conformance_level"), c("match_type"), c("status"), False))
    return rows.withColumn("badge", badge("status", "internal_hash_valid", F.lit(True)))


def verify(citations: DataFrame, offline: bool = False, fuzzy: bool = True) -> DataFrame:
    """citations, flat (text_exact, text_before, text_after, hash, doi, url, archive_url, fragment_url,
    captured_by; and source_text, fetch_error unless offline), with the result of verification."""
    c = F.col
    rows = _prepared(citations)
    if offline:
        rows = rows.withColumn("status", offline_status(c("internal_hash_valid"))).withColumn("source_hash_valid", F.lit(None).cast("boolean"))
        return rows.withColumn("warnings", _warnings(F.lit(True), c("conformance_level"), F.lit(None).cast("string"), c("status"), True)).withColumn("badge", badge("status", "internal_hash_valid", F.lit(False)))
    return _judged(locate(rows, "source_text", "text_exact", fuzzy))


def verify_each(sources: DataFrame, citations: str = "citations", fuzzy: bool = True) -> DataFrame:
    """verify() for rows of a source_text with an array of all its citations (structs; the hash among them):
    a row for each citation, without the source's text."""
    rows = sources.withColumn("__t", F.left("source_text", F.lit(1)))
    rows = locate_each(rows, "source_text", citations, "text_exact", fuzzy).withColumnRenamed("__t", "source_text")
    return _judged(_prepared(rows)).drop("source_text")


def with_first_source(citations: DataFrame, fetched: DataFrame, urls: str = "urls", key: str = "citation_id") -> DataFrame:
    """Joins the first of each citation's addresses that was fetched well: source_url, source_text, fetch_error."""
    tries = citations.select(key, F.posexplode(urls).alias("__pos", "url"))
    got = tries.join(fetched.select("url", F.col("text").alias("__t"), F.col("error").alias("__e")), "url", "left")
    good = blank("__e") & ~blank("__t")
    said = F.concat("url", F.lit(": "), F.coalesce("__e", F.lit("not fetched")))
    first = got.groupBy(key).agg(F.min_by(F.when(good, F.struct("url", "__t")), F.when(good, F.col("__pos"))).alias("__hit"), F.array_sort(F.collect_list(F.when(~good | F.col("__t").isNull(), F.struct("__pos", said.alias("said"))))).alias("__bad"))
    error = F.when(F.col("__hit").isNull(), F.array_join(F.transform("__bad", lambda x: x["said"]), "; "))
    return citations.join(first.select(key, F.col("__hit.url").alias("source_url"), F.col("__hit.__t").alias("source_text"), error.alias("fetch_error")), key, "left")


def summary(results: DataFrame) -> DataFrame:
    """(status, n), for statuses that occur."""
    return results.groupBy("status").agg(F.count("*").alias("n"))


def all_good(results: DataFrame) -> DataFrame:
    """One row: whether every result is verified or passage_verified."""
    return results.agg(F.coalesce(F.bool_and(F.col("status").isin("verified", "passage_verified")), F.lit(True)).alias("all_good"))
