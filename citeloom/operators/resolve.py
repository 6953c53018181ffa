"""Metadata of cited sources: hints, records of registries, curated references, and the cascade over them.

Registries are tables of their records as they were fetched; looking one up is a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.labels import surname
from citeloom.functions.links import filled
from citeloom.functions.text import col

_NAME = "[A-Z][A-Za-z]+"
HINT = rf"({_NAME}(?:\s(?:&|and)\s{_NAME})*(?:\s(?:et\s+al\.?))?),?\s*(\d{{4}})[a-z]?"
DOI = r"""(10\.\d{4,}/[^\s,;)"']+)"""
_DATES = "struct<`date-parts`: array<array<int>>>"
ITEM = f"title array<string>, author array<struct<family: string, given: string>>, DOI string, URL string, type string, score double, `container-title` array<string>, `published-print` {_DATES}, `published-online` {_DATES}, issued {_DATES}"
LEAST_SCORE, YEARS = 1.0, 1
COMMON = ("The", "This", "That", "These", "Their", "They", "Data", "For", "And", "With", "From", "Into", "Have", "Been", "Were", "Also", "Such", "Which", "Both", "More", "Most", "Some", "Other")


def first_author(authors: Column) -> Column:
    one = F.trim(F.substring_index(F.substring_index(authors, "&", 1), " and ", 1))
    return F.trim(F.regexp_replace(one, r"\s+et\s+al\.?", ""))


def hint_parts(hint: Column | str) -> Column:
    """struct(doi, author, year) of a hint: a DOI, or the first author and the year."""
    h = F.btrim(F.trim(col(hint)), F.lit("()"))
    doi = filled(F.regexp_extract(h, DOI, 1))
    author, year = filled(F.regexp_extract(h, HINT, 1)), F.regexp_extract(h, HINT, 2).try_cast("int")
    return F.struct(doi.alias("doi"), F.when(doi.isNull(), first_author(author)).alias("author"), F.when(doi.isNull(), year).alias("year"))


def source_metadata(item: Column | str) -> Column:
    """A source from one record of a registry, in its JSON."""
    i = F.from_json(col(item), ITEM)
    families = F.filter(F.coalesce(i["author"], F.array().cast("array<struct<family:string,given:string>>")), lambda a: filled(a["family"]).isNotNull())
    authors = F.transform(families, lambda a: F.btrim(F.concat(a["family"], F.lit(", "), F.coalesce(a["given"], F.lit(""))), F.lit(", ")))
    year = F.coalesce(*[F.nullif(F.get(F.get(i[k]["date-parts"], F.lit(0)), F.lit(0)), F.lit(0)) for k in ("published-print", "published-online", "issued")])
    kind = F.when(i["type"].isin("report", "monograph"), "grey").otherwise("academic")
    url = F.coalesce(F.concat(F.lit("https://doi.org/"), filled(i["DOI"])), i["URL"])
    return F.struct(F.coalesce(F.get(i["title"], F.lit(0)), F.lit("Unknown")).alias("title"), authors.alias("authors"), year.alias("year"), i["DOI"].alias("doi"), url.alias("url"), F.get(i["container-title"], F.lit(0)).alias("venue"), kind.alias("source_type"), i["score"].alias("score"))


def open_access_url(location: Column) -> Column:
    """Of a best location: the document itself, its address, or its landing page."""
    return F.coalesce(filled(location["url_for_pdf"]), filled(location["url"]), filled(location["url_for_landing_page"]))


def looked_up(hints: DataFrame, sources: DataFrame, key: str, hint: str = "citation_hint", open_access: DataFrame | None = None) -> DataFrame:
    """(key, source): each hint's source, by its DOI, else the best by first author and year.

    sources has the fields of source_metadata(). Of an author's sources of that year or the ones beside
    it the one of the highest score counts, if that is LEAST_SCORE at least. Keys are author and year, a
    source standing under each year that it may be asked for.
    """
    h = hints.select(key, hint_parts(hint).alias("p")).select(key, "p.*")
    s = sources.withColumn("source", F.struct(*[n for n in sources.columns if n != "score"]))
    best = F.max_by("source", F.struct("score", F.coalesce("doi", F.lit("")), "title"))
    by_doi = h.filter("doi is not null").select(key, F.lower("doi").alias("__d")).join(s.select(F.lower("doi").alias("__d"), "source", "score", "doi", "title"), "__d").groupBy(key).agg(best.alias("source"))
    near = F.explode(F.sequence(F.col("year") - YEARS, F.col("year") + YEARS))
    named = s.filter(F.size("authors") > 0).select(F.lower(surname(F.get("authors", F.lit(0)))).alias("__a"), near.alias("__y"), "source", "score", "doi", "title")
    asked = h.filter("author is not null").select(key, F.lower("author").alias("__a"), F.col("year").alias("__y"))
    by_name = asked.join(named, ["__a", "__y"]).groupBy(key).agg(best.alias("source"), F.max("score").alias("score")).filter(F.col("score") >= LEAST_SCORE).drop("score")
    found = by_doi.unionByName(by_name)
    if open_access is None:
        return found
    free = open_access.select(F.lower("doi").alias("__d"), open_access_url(F.col("best_oa_location")).alias("oa_url"))
    return found.withColumn("__d", F.lower("source.doi")).join(free, "__d", "left").drop("__d")


def context_words(paragraph: Column | str, author: Column | str) -> Column:
    """Up to three telling capitalised words, for a search that tells one work from another."""
    found = F.regexp_extract_all(col(paragraph), F.lit(r"\b([A-Z][a-z]{3,})\b"), 1)
    return F.slice(F.filter(found, lambda w: ~w.isin(*COMMON) & (F.lower(w) != F.lower(F.coalesce(col(author), F.lit(""))))), 1, 3)


def curated(hints: DataFrame, refs: DataFrame, key: str, hint: str = "citation_hint", aliases: dict[str, str] | None = None) -> DataFrame:
    """(key, ref): the curated reference of each hint.

    refs has ref_key, ord, authors and year. The hint itself comes first, then the first reference whose
    first author's surname is in the hint and whose year is the hint's first, then aliases (words in a
    hint, and the reference that they mean). The second joins by year, so no hint meets all references.
    """
    h = hints.select(key, F.trim(F.regexp_replace(hint, r"\s+", " ")).alias("__h")).filter("__h <> ''").withColumn("__y", filled(F.regexp_extract("__h", r"\d{4}", 0)))
    ref = F.struct(*refs.columns)
    exact = h.join(refs.select(F.col("ref_key").alias("__h"), ref.alias("ref")), "__h").select(key, F.lit(0).alias("__t"), "ref")
    named = refs.filter(F.size("authors") > 0).select(F.col("year").cast("string").alias("__y"), F.lower(surname(F.element_at(F.split(F.get("authors", F.lit(0)), ","), 1))).alias("__s"), ref.alias("ref"))
    close = h.join(named, "__y").filter(F.contains(F.lower("__h"), F.col("__s"))).select(key, F.lit(1).alias("__t"), "ref")
    found = exact.unionByName(close)
    if aliases:
        meant = F
        for words, target in aliases.items():
            meant = meant.when(F.contains(F.col("__h"), F.lit(words)), target)
        found = found.unionByName(h.select(key, meant.otherwise(F.lit(None)).alias("ref_key")).join(refs.select("ref_key", ref.alias("ref")), "ref_key").select(key, F.lit(2).alias("__t"), "ref"))
    return found.groupBy(key).agg(F.min_by("ref", F.struct("__t", F.col("ref.ord"))).alias("ref"))


def resolve(quotes: DataFrame, refs: DataFrame, sources: DataFrame, own: dict, key: str, hint: str = "citation_hint", aliases: dict[str, str] | None = None) -> DataFrame:
    """quotes with title, authors, year, doi, url and resolution: matched, searched, self or unresolved.

    A quote without a hint is the article's own (own has its title, authors and year).
    """
    some = quotes.select(key, hint)
    a = curated(some, refs, key, hint, aliases)
    b = looked_up(some, sources, key, hint).withColumnRenamed("source", "found")
    rows = quotes.join(a, key, "left").join(b, key, "left")
    none = F.coalesce(F.col(hint), F.lit("")) == ""
    of = F.when(F.col("ref").isNotNull(), "matched").when(F.col("found").isNotNull(), "searched").when(none, "self").otherwise("unresolved")
    field = lambda n, kind: F.coalesce(F.col(f"ref.{n}") if n in refs.columns else F.lit(None).cast(kind), F.col(f"found.{n}") if n in sources.columns else F.lit(None).cast(kind))
    own_of = lambda n, kind: F.when(F.col("resolution") == "self", F.lit(own.get(n)).cast(kind))
    unresolved = F.when(F.col("resolution") == "unresolved", F.concat(F.lit("[UNRESOLVED: "), F.col(hint), F.lit("]")))
    rows = rows.withColumn("resolution", of)
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({"title": F.coalesce(field("title", "string"), own_of("title", "string"), unresolved), "authors": F.coalesce(field("authors", "array<string>"), F.when(F.col("resolution") == "self", F.lit(own.get("authors", []))), empty), "year": F.coalesce(field("year", "int"), own_of("year", "int")), "doi": field("doi", "string"), "url": field("url", "string")})
    return rows.drop("ref", "found")


def tally(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("resolution").agg(F.count("*").alias("n"))


def resolution_tag(title: Column | str) -> Column:
    """Of stored citations: whether their source is known."""
    return F.when(filled(title).isNotNull() & (col(title) != "Unknown"), "curated").otherwise("unresolved")


def closest_snapshots(urls: DataFrame, snapshots: DataFrame, url: str = "url", now: Column | None = None, days: int = 30) -> DataFrame:
    """urls with archive_url, the newest available snapshot by a secure address, and whether it is fresh enough to reuse."""
    from citeloom.functions.links import https, reusable_snapshot

    newest = snapshots.filter("available").groupBy(url).agg(F.max_by("archive_url", "timestamp").alias("archive_url")).withColumn("archive_url", https("archive_url"))
    return urls.join(newest, url, "left").withColumn("reusable", reusable_snapshot("archive_url", now if now is not None else F.current_timestamp(), days))
