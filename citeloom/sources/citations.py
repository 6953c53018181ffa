"""Readers of citations and articles, and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.html import html_to_text
from citeloom.functions.model import CITATION, LINKED, completed, parsed, split_valid
from citeloom.functions.text import col

_BLOCK = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
_FIELDS = ("version", "id", "source", "target", "relation", "captured_at", "captured_by", "enrichment")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one citation or an array of them; a blank fingerprint is filled in."""
    return completed(spark.read.schema(CITATION).json(path, multiLine=True))


def from_html(pages: DataFrame, html: str, kind: str) -> DataFrame:
    """Citations of type kind in the linked-data blocks of pages; other columns stay.

    A block holds an object or an array; broken blocks, other types, and citations without a required
    field or of an unknown relation are skipped.
    """
    keep = [c for c in pages.columns if c != html]
    blocks = pages.select(*keep, F.explode(F.regexp_extract_all(col(html), F.lit(_BLOCK), 1)).alias("__b"))
    many = F.trim("__b").startswith("[")
    listed = F.when(many, parsed("__b", _array())).otherwise(F.array(parsed("__b", LINKED)))
    rows = blocks.select(*keep, F.explode(listed).alias("__c")).filter(F.col("__c.`@type`") == kind)
    return completed(split_valid(rows.select(*keep, *[F.col(f"__c.{f}").alias(f) for f in _FIELDS]))[0])


def _array():
    return T.ArrayType(T.StructType.fromDDL(LINKED))


def read_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Citations of JSON and HTML files under path, by their suffixes."""
    texts = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    html = from_html(texts.filter(F.lower("path").rlike(r"\.html?$")), "value", kind)
    body = F.trim("value")
    # Of other names, text that begins like JSON is read so, and the rest as pages.
    other = ~F.lower("path").rlike(r"\.(html?|json)$")
    as_json = F.substring(body, 1, 1).isin("{", "[")
    html = html.unionByName(from_html(texts.filter(other & ~as_json), "value", kind))
    js = texts.filter(F.lower("path").rlike(r"\.json$") | (other & as_json))
    listed = F.when(body.startswith("["), parsed("value", _array())).otherwise(F.array(parsed("value", LINKED)))
    rows = js.select("path", F.explode(listed).alias("__c"))
    return html.unionByName(rows.select("path", *[F.col(f"__c.{f}").alias(f) for f in _FIELDS]))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of articles; HTML is reduced to its text."""
    texts = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return texts.select("path", F.when(F.lower("path").rlike(r"\.html?$"), html_to_text("value")).otherwise(F.col("value")).alias("text"))


def compact_json(*fields: str) -> Column:
    """JSON without nulls, empty strings and lists, and -1."""
    return F.to_json(F.struct(*[F.when(~F.col(f).cast("string").isin("", "[]", "-1"), F.col(f)).alias(f) for f in fields]))
