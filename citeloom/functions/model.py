"""The citation record: schema, construction, validation and JSON forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.links import text_fragment_url
from citeloom.functions.relation import infer_relation, valid_capture, valid_relation
from citeloom.functions.text import CONTEXT, col, filled_hash, fingerprint

SOURCE = "title string, authors array<string>, year int, doi string, url string, archive_url string, venue string, source_type string"
TARGET = "text_exact string, hash string, text_before string, text_after string, char_start int, char_end int, page_ref string, section string, fragment_url string"
CITATION = f"version string, id string, source struct<{SOURCE.replace(' ', ': ').replace(',: ', ', ')}>, target struct<{TARGET.replace(' ', ': ').replace(',: ', ', ')}>, relation string, captured_at string, captured_by string, enrichment string"
#: With the linked-data keys, which readers match on and then drop.
LINKED = f"`@type` string, {CITATION}"


def parsed(json: Column | str, schema: str = CITATION) -> Column:
    """A citation from JSON text; unknown keys are dropped, broken text gives null."""
    return F.from_json(col(json), schema)


def completed(citations: DataFrame) -> DataFrame:
    """With the fingerprint where it was blank."""
    t = F.col("target")
    full = filled_hash(t["hash"], t["text_exact"], F.coalesce(t["text_before"], F.lit("")), F.coalesce(t["text_after"], F.lit("")))
    return citations.withColumn("target", t.withField("hash", full))


def split_valid(citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): required fields are there, relation and captured_by are known."""
    c = F.col
    ok = c("id").isNotNull() & c("source.title").isNotNull() & c("target.text_exact").isNotNull() & valid_relation("relation") & valid_capture("captured_by")
    return citations.filter(ok), citations.filter(~ok)


def internal_valid(citation: str = "target") -> Column:
    t = F.col(citation)
    return F.coalesce(t["hash"] == fingerprint(t["text_exact"], F.coalesce(t["text_before"], F.lit("")), F.coalesce(t["text_after"], F.lit(""))), F.lit(False))


def build_citations(quotes: DataFrame, doc: str = "doc_id", captured_at: Column | None = None, prefix: str = "cite") -> DataFrame:
    """Citations from extracted quotes (and the columns of a resolved source, where there are any).

    Context keeps the last code points before and the first after; ids count in order of position.
    """
    has = set(quotes.columns)
    pick = lambda n, kind="string": F.col(n) if n in has else F.lit(None).cast(kind)
    n = F.row_number().over(Window.partitionBy(doc).orderBy("position", "citation_hint", "text_exact"))
    before, after = F.right("text_before", F.lit(CONTEXT)), F.left("text_after", F.lit(CONTEXT))
    source = F.struct(
        F.coalesce(pick("title"), F.lit("Unknown")).alias("title"), F.coalesce(pick("authors", "array<string>"), F.array().cast("array<string>")).alias("authors"),
        pick("year", "int").alias("year"), pick("doi").alias("doi"), pick("url").alias("url"), pick("archive_url").alias("archive_url"), pick("venue").alias("venue"),
        F.coalesce(pick("source_type"), F.lit("academic")).alias("source_type"),
    )
    null = lambda kind: F.lit(None).cast(kind)
    target = F.struct(
        F.col("text_exact"), fingerprint("text_exact", before, after).alias("hash"), before.alias("text_before"), after.alias("text_after"), null("int").alias("char_start"), null("int").alias("char_end"),
        null("string").alias("page_ref"), null("string").alias("section"), text_fragment_url(pick("url"), "text_exact", before, after).alias("fragment_url"),
    )
    at = captured_at if captured_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return quotes.select(doc, F.lit("1.0").alias("version"), F.format_string(prefix + "-%03d", n).alias("id"), source.alias("source"), target.alias("target"), infer_relation("text_exact", "text_before", "text_after").alias("relation"), at.alias("captured_at"), F.lit("model").alias("captured_by"), null("string").alias("enrichment"))


_FIELDS = ("version", "id", "source", "target", "relation", "captured_at", "captured_by", "enrichment")


def citation_json(pretty: bool = False) -> Column:
    """Nulls are left out; empty strings and empty lists stay."""
    return F.to_json(F.struct(*_FIELDS), {"pretty": str(pretty).lower()})


def citation_jsonld(context: str, kind: str) -> Column:
    """Linked data: the vocabulary's address and the type's name come from the caller."""
    return F.to_json(F.struct(F.lit(context).alias("@context"), F.lit(kind).alias("@type"), *_FIELDS))


def merged_enrichment(old: Column | str, patch: Column | str) -> Column:
    """Maps: the keys of patch win, the others stay."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(col(old), empty), F.coalesce(col(patch), empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)
