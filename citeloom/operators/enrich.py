"""Drivers: enrichment of citations by verification and strain, and the strain analysis of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import strain as S
from citeloom.functions.links import filled, source_key
from citeloom.functions.model import merged_enrichment
from citeloom.functions.relation import discipline as discipline_of
from citeloom.operators import strain, verify

_COMPONENTS = ("jaccard_overlap", "rouge_l", "idf_overlap", "bigram_divergence")


def verification_block(checked_at: Column) -> Column:
    """JSON of the columns that verify() adds; what is not known has no key."""
    c = F.col
    some = F.when(F.size("warnings") > 0, c("warnings"))
    return F.to_json(F.struct(
        c("badge").alias("status"), "internal_hash_valid", checked_at.alias("checked_at"), "source_hash_valid", filled("source_hash_recomputed").alias("source_hash_recomputed"), filled("source_url").alias("source_checked_url"),
        "match_type", F.when(c("match_type").isNotNull(), F.round("similarity", 4)).alias("match_similarity"), filled("fetch_error").alias("fetch_error"), some.alias("warnings"),
    ))


def strain_block(assessed_at: Column, calibrated: bool = True) -> Column:
    """JSON of the columns that scored() adds."""
    parts = F.struct(*[F.round(n, 4).alias(n) for n in _COMPONENTS])
    return F.to_json(F.struct(F.round("score", 4).alias("score"), "band", F.lit("lexical").alias("method"), F.lit(calibrated).alias("calibrated"), "discipline", parts.alias("components"), "claiming_context", assessed_at.alias("assessed_at")))


def enrichment_json(blocks: Column | str) -> Column:
    """A map of JSON texts as one JSON object, null for an empty map."""
    b = F.col(blocks) if isinstance(blocks, str) else blocks
    pairs = F.transform(F.array_sort(F.map_entries(b)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return F.when(F.size(b) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def with_discipline(citations: DataFrame, doc: str) -> DataFrame:
    """With the discipline of the commonest source type of each document, the default where there is none."""
    modes = strain.discipline_mode(citations.filter(filled("source_type").isNotNull()), doc).select(doc, discipline_of("source_type").alias("discipline"))
    return citations.join(modes, doc, "left").withColumn("discipline", F.coalesce("discipline", F.lit("social_science")))


def scored(citations: DataFrame, doc: str, article: str, calibrate: bool = True) -> DataFrame:
    """Citations with claiming_context, the strain components, score and band."""
    rows = citations if "discipline" in citations.columns else with_discipline(citations, doc)
    rows = rows.withColumn("claiming_context", S.claiming_context(article, "text_exact", "text_before", "text_after"))
    rows = strain.local_strain(rows, "text_exact", "claiming_context")
    if calibrate:
        rows = strain.calibrate(rows).drop("score", "discipline_band").withColumnRenamed("calibrated", "score").withColumn("band", S.band("score"))
    return rows


def enrich(citations: DataFrame, now: Column, doc: str = "doc_id", article: str | None = None, offline: bool = False, calibrate: bool = True, do_verify: bool = True) -> DataFrame:
    """Citations with their enrichment, a map of JSON blocks, renewed; blocks of other names stay.

    citations are as verify() takes them, with doc, relation and source_type, and the article's text for strain.
    """
    names = citations.columns
    rows = citations if "enrichment" in names else citations.withColumn("enrichment", F.create_map().cast("map<string,string>"))
    keep = [*names, *([] if "enrichment" in names else ["enrichment"])]
    if do_verify:
        if "source_url" not in names:
            rows = rows.withColumn("source_url", F.lit(None).cast("string"))
        rows = verify.verify(rows, offline)
        missing = [n for n in ("source_hash_recomputed", "match_type", "similarity") if n not in rows.columns]
        rows = rows.withColumns({n: F.lit(None).cast("double" if n == "similarity" else "string") for n in missing})
        rows = rows.withColumn("enrichment", merged_enrichment("enrichment", F.create_map(F.lit("verification"), verification_block(now)))).select(*keep)
    if article:
        rows = scored(rows, doc, article, calibrate)
        rows = rows.withColumn("enrichment", merged_enrichment("enrichment", F.create_map(F.lit("strain"), strain_block(now, calibrate)))).select(*keep)
    return rows


def analyze(citations: DataFrame, doc: str, order: str, article: str, calibrate: bool = True, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """The strain of documents: local (a row a citation), clusters, obstructions (counts a citation), and documents.

    All of them read local; stage can make a table of it, so that citations are scored once.
    """
    local = stage(scored(citations, doc, article, calibrate).withColumn("source_key", source_key("doi", "url", "title", "text_exact")))
    clustered = strain.clusters(local, doc, "source_key", order, title="title")
    totals = strain.global_strain(local, doc).join(strain.consistency(clustered, doc), doc)
    return {"local": local, "clusters": clustered, "obstructions": strain.obstruction_counts(local, doc, "source_key", order), "documents": totals}


def report_json(analysis: dict[str, DataFrame], doc: str, order: str) -> DataFrame:
    """(doc, report): the analysis of each document as JSON, numbers to 4 places, texts to 100 characters."""
    parts = F.struct(*[F.round(n, 4).alias(n) for n in _COMPONENTS])
    item = F.struct(F.col(order).alias("citation_id"), F.round("score", 4).alias("score"), F.col("band").alias("classification"), "relation", "discipline", parts.alias("components"), F.left("text_exact", F.lit(100)).alias("text_exact_snippet"), F.left("claiming_context", F.lit(100)).alias("claiming_context_snippet"))
    lists = analysis["local"].groupBy(doc).agg(F.array_sort(F.collect_list(item)).alias("local_strains"))  # a document's own citations
    spread = F.struct("low", "moderate", "high", "extreme").alias("strain_distribution")
    rounded = [F.round(c, 4).alias(c) for c in ("consistency_score", "max_local_strain", "mean_local_strain", "median_local_strain")]
    return analysis["documents"].join(lists, doc).select(doc, F.to_json(F.struct(F.round("mean_local_strain", 4).alias("global_score"), *rounded, "citation_count", spread, "local_strains")).alias("report"))


def report_text(analysis: dict[str, DataFrame], doc: str) -> DataFrame:
    """(doc, report): the totals of each document in lines."""
    d, bar = analysis["documents"], lambda n: F.format_string(f"    %10s: %2d/%d  %s", F.lit(n), F.col(n), F.col("citation_count"), F.repeat(F.lit("#"), F.col(n).cast("int")))
    head = F.format_string("  Citations analyzed:    %d\n  Global strain:         %.3f (%s)\n  Median strain:         %.3f\n  Max strain:            %.3f\n  Consistency:           %.2f\n", "citation_count", "mean_local_strain", S.band("mean_local_strain"), "median_local_strain", "max_local_strain", "consistency_score")
    return d.select(doc, F.concat_ws("\n", head, F.lit("  Distribution:"), *map(bar, ("low", "moderate", "high", "extreme"))).alias("report"))


def zipped(left: DataFrame, right: DataFrame, doc: str, ordinal: str) -> DataFrame:
    """Rows of equal place joined; a row without its counterpart is an error, as lists of unequal length are."""
    both = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), [doc, ordinal], "full")
    checked = F.when(F.col("__l").isNull() | F.col("__r").isNull(), F.raise_error(F.lit("the two lists differ in length")).cast("boolean")).otherwise(F.lit(True))
    return both.withColumn("__ok", checked).filter("__ok").drop("__l", "__r", "__ok")
