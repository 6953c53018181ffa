"""What readers are shown of a citation: names, lines of metadata, badges and their tooltips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.html import escape
from citeloom.functions.links import filled
from citeloom.functions.text import col

#: badge -> (kind, label); what is not listed has not been checked.
VERIFICATION = {
    "verified": ("ok", "Source-verified"),
    "internal-only": ("info", "Internal hash OK"),
    "partial": ("warn", "Partial match"),
    "source-drift": ("drift", "Source drift"),
    "internal-mismatch": ("fail", "Internal hash mismatch"),
    "unreachable": ("muted", "Source unreachable"),
}
STRAIN = {"low": ("ok", "Low claim distance"), "moderate": ("warn", "Moderate claim distance"), "high": ("drift", "High claim distance"), "extreme": ("fail", "Extreme claim distance")}
#: status -> (symbol, label of a report, words of a summary), in the order of a summary.
STATUSES = {
    "verified": ("✓", "VERIFIED", "fully verified"),
    "passage_verified": ("~", "PASSAGE FOUND", "passage confirmed"),
    "hash_mismatch": ("✗", "HASH MISMATCH", "hash mismatch"),
    "passage_not_found": ("?", "PASSAGE NOT FOUND", "passage not found"),
    "source_unavailable": ("!", "SOURCE UNAVAILABLE", "source unavailable"),
    "insufficient_metadata": ("-", "INSUFFICIENT METADATA", "insufficient metadata"),
}


def picked(c: Column, table: dict, k: int, other: Column) -> Column:
    """Item k of the table's entry for c."""
    out = F
    for name, entry in table.items():
        out = out.when(c == name, entry[k])
    return out.otherwise(other)


def surname(name: Column) -> Column:
    """Of 'Last, First' or 'First Last'."""
    return F.when(F.instr(name, ",") > 0, F.trim(F.substring_index(name, ",", 1))).otherwise(F.element_at(F.split(F.trim(name), r"\s+"), -1))


def author_label(authors: Column | str, title: Column | str, year: Column | str) -> Column:
    """One or two surnames, or the first et al., or the title without any; with the year, for markup."""
    a = F.coalesce(col(authors), F.array().cast("array<string>"))
    n, of = F.size(a), lambda i: escape(surname(F.get(a, F.lit(i))))
    name = F.when(n == 0, escape(F.left(col(title), F.lit(60)))).when(n == 1, of(0)).when(n == 2, F.concat(of(0), F.lit(" &amp; "), of(1))).otherwise(F.concat(of(0), F.lit(" et al.")))
    return F.concat(name, F.when(col(year) != 0, F.concat(F.lit(" ("), col(year).cast("string"), F.lit(")"))).otherwise(""))


def meta_line(authors: Column | str, venue: Column | str, year: Column | str, source_type: Column | str) -> Column:
    """Authors, venue, year and type with dots between, null without any."""
    a = F.coalesce(col(authors), F.array().cast("array<string>"))
    who = F.when(F.size(a) == 1, escape(F.get(a, F.lit(0)))).when(F.size(a) == 2, escape(F.array_join(a, "; "))).when(F.size(a) > 2, F.concat(escape(F.get(a, F.lit(0))), F.lit(" et al.")))
    parts = F.array_compact(F.array(who, escape(filled(venue)), F.when(col(year) != 0, col(year).cast("string")), escape(filled(source_type))))
    return filled(F.array_join(parts, " &middot; "))


def short_date(iso: Column | str) -> Column:
    return F.substring_index(col(iso), "T", 1)


def verification_label(badge: Column | str) -> Column:
    return F.struct(picked(col(badge), VERIFICATION, 0, F.lit("muted")).alias("kind"), picked(col(badge), VERIFICATION, 1, F.lit("Not verified")).alias("label"))


def strain_label(band: Column | str) -> Column:
    b = F.lower(F.coalesce(col(band), F.lit("")))
    return F.struct(picked(b, STRAIN, 0, F.lit("muted")).alias("kind"), picked(b, STRAIN, 1, F.concat(F.lit("Strain: "), b)).alias("label"))


def verification_title(match_type: Column | str, similarity: Column | str, source_hash_valid: Column | str, url: Column | str, error: Column | str, warnings: Column | str) -> Column:
    """The tooltip of a badge: match, hash, source, error and warnings, for markup."""
    match = F.concat(F.lit("Match: "), filled(match_type), F.when(col(similarity) < 1, F.format_string(" (%.2f)", col(similarity))).otherwise(""))
    hashed = F.when(col(source_hash_valid), "Source hash recomputed and matched").when(~col(source_hash_valid), "Source hash recomputed — DIFFERS from captured hash")
    first = F.array_compact(F.array(match, hashed, F.concat(F.lit("Source: "), filled(url)), F.concat(F.lit("Fetch error: "), filled(error))))
    more = F.transform(F.coalesce(col(warnings), F.array().cast("array<string>")), lambda w: F.concat(F.lit("Warning: "), w))
    return escape(F.array_join(F.concat(first, more), " — "))


def locators(fragment_url: Column | str, doi: Column | str, url: Column | str, page_ref: Column | str, section: Column | str, archive_url: Column | str) -> Column:
    """(kind, value) of every way into the source, the most specific first."""
    one = lambda kind, value: F.when(filled(value).isNotNull(), F.struct(F.lit(kind).alias("kind"), filled(value).alias("value")))
    return F.array_compact(F.array(one("passage", fragment_url), F.when(filled(fragment_url).isNull(), F.coalesce(one("doi", doi), one("url", url))), one("page", page_ref), one("section", section), one("archive", archive_url)))
