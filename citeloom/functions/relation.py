"""Relations, disciplines, badges and labels of citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import blank, col

RELATIONS = ("supports", "contradicts", "defines", "quantifies", "contextualizes", "method", "cautions")
CAPTURED_BY = ("author", "tool", "model")
#: In order; the first whose pattern is found in the lower-cased text wins. "around" looks at the context alone.
RULES = (
    ("defines", "text", "defined as|refers to|means|is termed"),
    ("defines", "around", "define|definition of"),
    ("contradicts", "text", "disagree|challenge|refute|contrary to|not supported"),
    ("quantifies", "text", "percent|%|rate|proportion|number of|million"),
    ("cautions", "text", "warn|caution|risk|concern|difficult|harm"),
    ("method", "text", "method|approach|technique|framework|model|protocol"),
    ("contextualizes", "text", "history|tradition|background|context|evolution of"),
)
DISCIPLINES = {"academic": "social_science", "grey": "social_science", "journalism": "journalism", "web": "journalism", "ai_output": "ai_output"}


def infer_relation(exact: Column | str, before: Column | str | None = None, after: Column | str | None = None) -> Column:
    """By substrings, not words: a cascade in which the first hit decides."""
    text, side = F.lower(col(exact)), lambda c: F.lit("") if c is None else F.lower(F.coalesce(col(c), F.lit("")))
    around = F.concat(side(before), F.lit(" "), side(after))
    out = F.when(col(exact).isNull(), F.lit(None).cast("string"))
    for name, where, pattern in RULES:
        out = out.when((around if where == "around" else text).rlike(pattern), name)
    return out.otherwise("supports")


def discipline(source_type: Column | str) -> Column:
    out = F.when(col(source_type).isNull(), "social_science")
    for kind, name in DISCIPLINES.items():
        out = out.when(col(source_type) == kind, name)
    return out.otherwise("social_science")


def valid_relation(c: Column | str) -> Column:
    return F.coalesce(col(c).isin(*RELATIONS) | col(c).startswith("x-"), F.lit(False))


def valid_capture(c: Column | str) -> Column:
    return F.coalesce(col(c).isin(*CAPTURED_BY), F.lit(False))


def badge(status: Column | str, internal_valid: Column | str, consulted: Column | str) -> Column:
    """What a reader is shown; the internal check comes first."""
    s = col(status)
    return (
        F.when(~F.coalesce(col(internal_valid), F.lit(False)), "internal-mismatch")
        .when(~F.coalesce(col(consulted), F.lit(False)), "internal-only")
        .when(s == "verified", "verified")
        .when(s == "hash_mismatch", "source-drift")
        .when(s.isin("passage_verified", "passage_not_found"), "partial")
        .otherwise("unreachable")
    )


def conformance_level(before: Column | str, after: Column | str, doi: Column | str, url: Column | str, archive_url: Column | str, fragment_url: Column | str) -> Column:
    two = (~blank(before) | ~blank(after)) & (~blank(doi) | ~blank(url))
    return F.when(two & ~blank(archive_url) & ~blank(fragment_url), 3).when(two, 2).otherwise(1)
