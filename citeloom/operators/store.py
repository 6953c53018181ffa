"""Stored results and fetched sources: latest rows, statistics, histories and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import content_hash


def latest(results: DataFrame, key: str = "citation_id", order: str = "id") -> DataFrame:
    """The last row of each citation, by a partial aggregate instead of a window."""
    row = F.max_by(F.struct(*results.columns), order).alias("r")
    return results.groupBy(F.col(key).alias("__k")).agg(row).select("r.*")


def recent(results: DataFrame, citation_id: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    """The newest results first; of one time, the last stored first."""
    if citation_id is not None:
        results = results.filter(F.col("citation_id") == citation_id)
    if status is not None:
        results = results.filter(F.col("status") == status)
    return results.orderBy(F.desc("verified_at"), F.desc("id")).limit(limit)


def stats(results: DataFrame, fetches: DataFrame, drift: DataFrame) -> DataFrame:
    """One row of totals over the three tables."""
    a = results.agg(F.count("*").alias("verifications"), F.max("verified_at").alias("last_verified_at"))
    b = fetches.agg(F.count_distinct("url").alias("unique_sources"))
    c = drift.agg(F.count("*").alias("drift_events"), F.count_distinct("url").alias("drifted_sources"))
    return a.crossJoin(b).crossJoin(c)


def by_status(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def hashed_fetches(fetches: DataFrame, text: str = "text") -> DataFrame:
    """With content_hash and content_length in place of the text."""
    return fetches.withColumn("content_hash", content_hash(text)).withColumn("content_length", F.char_length(text)).drop(text)


def source_history(fetches: DataFrame) -> DataFrame:
    """Per address and content: first and last seen, fetches; length as at the first."""
    at = F.struct("ts", "seq")
    return fetches.groupBy("url", "content_hash").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("fetch_count"), F.min_by("content_length", at).alias("content_length"))


def drift_events(fetches: DataFrame) -> DataFrame:
    """(url, old_hash, new_hash, old_length, new_length, detected_at): content not seen before at a known address.

    Both windows use one shuffle by address; going back to known content is no drift.
    """
    by_url = Window.partitionBy("url").orderBy("ts", "seq")
    by_content = Window.partitionBy("url", "content_hash").orderBy("ts", "seq")
    seen = fetches.select("url", "ts", "seq", "content_hash", "content_length")
    seen = seen.withColumn("old_hash", F.lag("content_hash").over(by_url)).withColumn("old_length", F.lag("content_length").over(by_url)).withColumn("nth", F.row_number().over(by_content))
    return seen.filter("nth = 1 and old_hash is not null").select("url", "old_hash", F.col("content_hash").alias("new_hash"), "old_length", F.col("content_length").alias("new_length"), F.col("ts").alias("detected_at"))


def affected(drift: DataFrame, results: DataFrame) -> DataFrame:
    """drift with the citations verified against the address up to then."""
    r = results.select(F.col("source_url").alias("url"), "citation_id", "verified_at").distinct()
    hit = drift.join(r, "url").filter(F.col("verified_at") <= F.col("detected_at"))
    ids = hit.groupBy("url", "new_hash").agg(F.array_sort(F.collect_set("citation_id")).alias("citation_ids"))
    return drift.join(ids, ["url", "new_hash"], "left").withColumn("citation_ids", F.coalesce("citation_ids", F.array().cast("array<string>")))


def drift_of(drift: DataFrame, url: str | None = None, newest_first: bool = False) -> DataFrame:
    """Drift of one address, or of all, in the order of time."""
    rows = drift if url is None else drift.filter(F.col("url") == url)
    return rows.orderBy(F.desc("detected_at") if newest_first else "detected_at", "url", "new_hash")


def history_of(history: DataFrame, url: str) -> DataFrame:
    return history.filter(F.col("url") == url).orderBy("first_seen", "content_hash")
