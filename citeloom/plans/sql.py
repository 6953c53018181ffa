"""Pieces of SQL from which the oracles of the queries are put together."""

from __future__ import annotations

from citeloom.functions.links import FRAGMENT_STOPWORDS
from citeloom.functions.strain import STOPWORDS, TOKEN
from citeloom.functions.text import EDGE_SPACE


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words: list[str]) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def norm(x: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({x}), '[\\t\\n\\r ]+', ' ', 'g'), {quoted(EDGE_SPACE)})"


def fingerprint(exact: str, before: str, after: str) -> str:
    side = lambda x: f"rpad({norm(x)}, 50, ' ')"
    return f"'sha256:' || sha256({side(before)} || '|' || {norm(exact)} || '|' || {side(after)})"


def html_to_text(x: str) -> str:
    """For pages as simple as those of the driver's tables, written out on its own."""
    for tag in ("script", "style", "nav", "footer", "header"):
        x = f"regexp_replace({x}, '<{tag}[ >].*?</{tag}>', '', 'gis')"
    x = f"regexp_replace(regexp_replace({x}, '<!doctype[^>]*>', '', 'gi'), '<!--.*?-->', '', 'gs')"
    x = f"regexp_replace({x}, '<(p|div|br|h[1-6]|li|tr|blockquote|section|article)(\\s[^>]*)?/?>|</(p|div|li|blockquote)>', chr(10) || chr(10), 'gi')"
    x = f"regexp_replace({x}, '</?[a-zA-Z][^>]*>', '', 'g')"
    for name, char in (("nbsp", 160), ("copy", 169), ("middot", 183), ("mdash", 8212), ("ndash", 8211), ("quot", 34), ("#39", 39), ("lt", 60), ("gt", 62), ("amp", 38)):
        x = f"replace({x}, '&{name};', chr({char}))"
    x = f"array_to_string(list_transform(string_split_regex({x}, '\\n{{2,}}'), lambda p: replace(p, chr(10), ' ')), chr(10) || chr(10))"
    return f"trim(regexp_replace({x}, '  +', ' ', 'g'), {quoted(EDGE_SPACE)})"


def relation(text: str, around: str) -> str:
    """As the rules are stated, a hit of any word in the lower-cased text; not taken from the code's table."""
    said = lambda x, *words: "(" + " OR ".join(f"contains(lower({x}), {quoted(w)})" for w in words) + ")"
    return f"""CASE WHEN {text} IS NULL THEN NULL
        WHEN {said(text, "defined as", "refers to", "means", "is termed")} OR {said(around, "define", "definition of")} THEN 'defines'
        WHEN {said(text, "disagree", "challenge", "refute", "contrary to", "not supported")} THEN 'contradicts'
        WHEN {said(text, "percent", "%", "rate", "proportion", "number of", "million")} THEN 'quantifies'
        WHEN {said(text, "warn", "caution", "risk", "concern", "difficult", "harm")} THEN 'cautions'
        WHEN {said(text, "method", "approach", "technique", "framework", "model", "protocol")} THEN 'method'
        WHEN {said(text, "history", "tradition", "background", "context", "evolution of")} THEN 'contextualizes' ELSE 'supports' END"""


def tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(nfc_normalize(lower({text})), {quoted(TOKEN)}), lambda t: length(t) > 1 AND t NOT IN {listed(STOPWORDS)})"


def telling(words: str) -> str:
    bare = r"lower(regexp_replace(w, '^[^\pL\pN\pM_]+|[^\pL\pN\pM_]+$', '', 'g'))"
    return f"len(list_filter({words}, lambda w: {bare} <> '' AND {bare} NOT IN {listed(FRAGMENT_STOPWORDS)}))"


PASSAGES = """
    lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS exact, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    passages AS (
        SELECT doc_id, lang, pos, exact, right(coalesce(lag(exact) OVER w, ''), 50) AS before, left(coalesce(lead(exact) OVER w, ''), 50) AS after
        FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
    )
"""
SCORED = "scored AS (SELECT event_id, user_id, event_type, ts, least(value / 20, 1.0) AS score FROM events)"
FETCHES = "fetches AS (SELECT CAST(user_id AS VARCHAR) AS url, ts, event_id AS seq, sha256(event_type) AS content_hash, CAST(length(event_type) AS BIGINT) AS content_length FROM events)"
DRIFT = f"""
    WITH {FETCHES}, seen AS (
        SELECT *, lag(content_hash) OVER (PARTITION BY url ORDER BY ts, seq) AS old_hash, lag(content_length) OVER (PARTITION BY url ORDER BY ts, seq) AS old_length,
               row_number() OVER (PARTITION BY url, content_hash ORDER BY ts, seq) AS nth
        FROM fetches
    )
    SELECT url, old_hash, content_hash AS new_hash, old_length, content_length AS new_length, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS detected_at
    FROM seen WHERE nth = 1 AND old_hash IS NOT NULL
"""
