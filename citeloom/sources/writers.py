"""Writers: documents with their citations, stored results, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.labels import STATUSES, picked
from citeloom.functions.links import filled
from citeloom.functions.text import EDGE_SPACE, col

_RECORD = ("version", "id", "source", "target", "relation", "captured_at", "captured_by", "enrichment")
MATCH = "found boolean, matched_text string, char_start int, char_end int, context_before string, context_after string, match_type string, similarity double"
RESULT = f"citation_id string, source_title string, status string, internal_hash_valid boolean, source_hash_valid boolean, source_hash_recomputed string, passage_match struct<{MATCH.replace(' ', ': ').replace(',: ', ', ')}>, source_url string, fetch_error string, conformance_level int, relation string, page_ref string, captured_by string, warnings array<string>"
DEFAULTS = {"source_title": "", "internal_hash_valid": False, "source_hash_recomputed": "", "source_url": "", "fetch_error": "", "conformance_level": 0, "relation": "", "page_ref": "", "captured_by": ""}


def json_arrays(citations: DataFrame, doc: str = "doc_id", order: str = "id") -> DataFrame:
    """(doc, json): all citations of each document as one indented array, nulls left out."""
    record = F.struct(F.col(order).alias("__o"), F.struct(*_RECORD).alias("r"))
    rows = citations.groupBy(doc).agg(F.array_sort(F.collect_list(record)).alias("rs"))  # a document's own citations
    return rows.select(doc, F.to_json(F.transform("rs", lambda x: x["r"]), {"pretty": "true"}).alias("json"))


def _rstrip(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(EDGE_SPACE)) if hasattr(F, "rtrim") else col(c)


def markdown(text: Column | str, json: Column | str) -> Column:
    """The article with its citations in a fenced block at the end."""
    return F.concat(_rstrip(text), F.lit("\n\n\n---\n\n<!-- citation metadata -->\n\n```json\n\n"), col(json), F.lit("\n\n```\n"))


def latex(text: Column | str, json: Column | str) -> Column:
    """The article with its citations as comments at the end."""
    lines = F.regexp_replace(col(json), "(?m)^", "% ")
    return F.concat(_rstrip(text), F.lit("\n\n% ====== citation metadata ======\n"), lines, F.lit("\n% ====== end ======\n"))


def written(articles: DataFrame, citations: DataFrame, text: str, form: str, doc: str = "doc_id") -> DataFrame:
    """(doc, output) of each article in one of the forms json, markdown and latex; articles without citations have an empty array."""
    rows = articles.join(json_arrays(citations, doc), doc, "left").withColumn("json", F.coalesce("json", F.lit("[ ]")))
    out = {"json": F.concat("json", F.lit("\n")), "markdown": markdown(text, "json"), "latex": latex(text, "json")}[form]
    return rows.select(doc, out.alias("output"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored results, an object or an array of them in each file, with defaults for what is missing."""
    rows = spark.read.schema(RESULT).json(path, multiLine=True)
    rows = rows.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in DEFAULTS.items()})
    return rows.withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))


def append_results(results: DataFrame, path: str, input_file: str | None = None) -> None:
    """Adds results to the store, a folder for each day of verification; ids follow the time of storing."""
    rows = results.withColumn("verified_at", F.current_timestamp()) if "verified_at" not in results.columns else results
    rows = rows.withColumn("input_file", F.lit(input_file)).withColumn("day", F.to_date("verified_at"))
    rows.withColumn("id", F.unix_micros("verified_at") * 4096 + F.monotonically_increasing_id() % 4096).write.mode("append").partitionBy("day").parquet(path)


def stored_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("day")


def result_text() -> Column:
    """Lines on one result of verify(), those without a value left out."""
    c, line = F.col, lambda label, v: F.concat(F.lit(f"      {label}: "), v)
    status = c("status")
    head = F.concat(F.lit("  ["), picked(status, STATUSES, 0, F.lit("?")), F.lit("] "), c("citation_id").cast("string"), F.lit(": "), picked(status, STATUSES, 1, F.upper(status)))
    about = F.concat(F.lit("      Relation: "), F.coalesce("relation", F.lit("")), F.lit(" | Level: L"), c("conformance_level").cast("string"), F.lit(" | Captured by: "), F.coalesce("captured_by", F.lit("")))
    near = F.when(c("match_type") == "fuzzy", F.format_string(" (%.0f%%)", c("similarity") * 100)).otherwise("")
    snippet = F.concat(F.lit('"'), F.left("matched_text", F.lit(80)), F.when(F.char_length("matched_text") > 80, "...").otherwise(""), F.lit('"'))
    found = c("match_type").isNotNull()
    lines = F.array(
        head, line("Source", F.coalesce("source_title", F.lit(""))), line("Location", filled("page_ref")), about, line("Internal hash", F.when(c("internal_hash_valid"), "valid").otherwise("INVALID")), line("Source URL", filled("source_url")),
        F.when(found, line("Match type", F.concat("match_type", near))), F.when(found, line("Found", snippet)), line("Source hash", F.when(c("source_hash_valid"), "matches").when(~c("source_hash_valid"), "differs")), line("Fetch error", filled("fetch_error")),
    )
    return F.array_join(F.concat(F.array_compact(lines), F.transform("warnings", lambda w: F.concat(F.lit("      Warning: "), w))), "\n")


def summary_text(counts: DataFrame) -> DataFrame:
    """One row: how many were checked and came out how; what did not occur is left out. counts has (status, n)."""
    said = [F.concat(F.nullif(F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)), F.lit(0)).cast("string"), F.lit(f" {words}")) for s, (_, _, words) in STATUSES.items()]
    total = F.concat(F.coalesce(F.sum("n"), F.lit(0)).cast("string"), F.lit(" citations checked"))
    return counts.agg(F.array_join(F.array_compact(F.array(total, *said)), " | ").alias("summary"))
